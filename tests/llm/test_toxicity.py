import os

import numpy as np
import pytest

from odd import odd_rows
from spendloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_thresholds_are_ordered_and_severity_grows():
    bad = [("you nasty " * n + "text here", 1 + (n > 3)) for n in range(1, 7)] * 8
    good = [(f"plain text number {i} here", 0) for i in range(80)]
    model = toxicity.fit(bad + good, toxicity.telling_words(bad + good))
    assert list(model.thresholds) == sorted(model.thresholds)
    scores = [model.expected("nasty " * n + "text") for n in range(8)]
    assert scores == sorted(scores) and scores[0] < 0.5 < scores[2] and scores[7] > 1


def test_gradient_fits_the_likelihood():
    """No small step of a weight or threshold lowers the fitted cost much."""
    data = [(("bad " * (i % 4) + "ok"), min(2, i % 4)) for i in range(200)]
    model = toxicity.fit(data, ["bad"], steps=3000, penalty=0.0)

    def cost(w, thresholds):
        above = np.array([[g > k for k in range(2)] for _, g in data], float)
        score = np.array([w * np.log1p(t.split().count("bad")) for t, _ in data])
        p = 1 / (1 + np.exp(-(score[:, None] - np.array(thresholds)[None, :])))
        loss = -(above * np.log(p + 1e-12) + (1 - above) * np.log(1 - p + 1e-12))
        share = np.where(above > 0, 1 / above.sum(0), 1 / (1 - above).sum(0)) / 2
        return (loss * share).sum()

    w, t = model.weights["bad"], model.thresholds
    here = cost(w, t)
    assert all(cost(w + dw, (t[0] + d0, t[1] + d1)) > here - 1e-3 for dw in (-0.05, 0, 0.05) for d0 in (-0.05, 0, 0.05) for d1 in (-0.05, 0, 0.05))


def test_odd_rows_are_clean(spark, docs_of):
    rows = odd_rows()
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels)
    found = toxicity.score(docs_of(rows), model).collect()
    assert len(found) == len(rows) and all(r.grade == 0 for r in found)
    assert toxicity.drop_toxic(docs_of(rows), model).count() == len(rows)
    assert toxicity.score(docs_of([]), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    model = toxicity.train(docs, train)
    found = toxicity.score(docs.join(test, "doc_id", "left_semi"), model).join(test, "doc_id").collect()
    wrong = [r for r in found if (r.severity >= 0.5) != (r.toxic > 0)]
    assert len(found) > 900 and len(wrong) <= 0.02 * len(found)
    assert len([r for r in wrong if not r.toxic]) <= 0.005 * len(found)
