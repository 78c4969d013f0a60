"""Toxicity severity by cumulative-link ordinal regression.

The grades are ordered (clean, mild, severe).  One weight vector w over sparse
text features is shared by all thresholds t1 < t2 < ...:

    P(grade > k | x) = sigmoid(w.x - t_k),    expected severity = sum over k of P(grade > k | x)

The features are the logarithmic counts of the words that tell the labels apart
(a likelihood ratio test over the labelled documents), read from the whole text.  The model is fitted on at most ``MOST_LABELLED``
labelled documents; scoring reads every word of every document.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import slices

#: At most so many labelled documents are read for a fit, those with the smallest hashed ids.
MOST_LABELLED = 6000
#: A word is a feature if its document counts tell the labels apart with at least this G² (chance: 1 in a million).
LEAST_G2 = 25.0
_WORD = re.compile(r"[^\W\d_]+")


@dataclasses.dataclass(frozen=True)
class Severity:
    """A fitted model: word weights and ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def expected(self, text: str | None) -> float:
        score = sum(self.weights[f] * math.log1p(n) for f, n in sorted(features(text, self.weights).items()))
        return sum(1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds)


def features(text: str | None, known: dict[str, float] | None = None) -> Counter:
    """Counts of the words of a text and of their beginnings; of ``known`` ones only, if given.

    Beginnings of 4 and 5 letters stand for inflected and compound forms.
    """
    found = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for feature in (word, word[:4] + "-", word[:5] + "-") if len(word) > 5 else (word, word[:4] + "-") if len(word) > 4 else (word,):
            if known is None or feature in known:
                found[feature] += n
    return found


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple[str, int]]:
    """Distinct texts and labels of at most ``most`` labelled documents, on the driver.

    Rows with a null id, label or text are left out; of labels that differ for
    an id or a text, the largest counts.
    """
    toxic = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    # The limit bounds this side to ``most`` rows of two numbers.
    rows = texts.join(F.broadcast(toxic), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found: dict[str, int] = {}
    for row in rows.orderBy("doc_id").collect():
        found[row["text"]] = max(found.get(row["text"], 0), int(row["toxic"] > 0))
    return list(found.items())


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Severity:
    """Fit a model to the labelled documents.

    Documents labelled as not toxic have grade 0.  The labels do not say how
    bad a toxic one is, so the toxic ones are divided at the median of how much
    they have of the telling words: grade 1 below, 2 above.
    """
    examples = labelled_texts(docs, labels, most)
    known = telling_words(examples)
    return fit(graded(examples, known), known)


def graded(examples: list[tuple[str, int]], known: list[str]) -> list[tuple[str, int]]:
    telling = dict.fromkeys(known, 0.0)
    much = [sum(math.log1p(n) for n in features(t, telling).values()) for t, _ in examples]
    toxic = [m for m, (_, y) in zip(much, examples) if y]
    middle = float(np.median(toxic)) if toxic else 0.0
    return [(t, 0 if not y else 1 + (m > middle)) for m, (t, y) in zip(much, examples)]


def telling_words(examples: list[tuple[str, int]]) -> list[str]:
    """Features that graded documents have more often than chance explains, by a likelihood ratio test."""
    total, bad = len(examples), sum(y > 0 for _, y in examples)
    docs, bad_docs = Counter(), Counter()
    for text, y in examples:
        found = features(text).keys()
        docs.update(found)
        if y:
            bad_docs.update(found)

    def g2(n: int, k: int) -> float:
        cells = ((k, n * bad), (n - k, n * (total - bad)), (bad - k, (total - n) * bad), (total - n - bad + k, (total - n) * (total - bad)))
        return 2 * sum(o * math.log(o * total / e) for o, e in cells if o)

    return sorted(w for w, k in bad_docs.items() if k * total > docs[w] * bad and g2(docs[w], k) >= LEAST_G2)


def fit(examples: list[tuple[str, int]], known: list[str], steps: int = 600, rate: float = 0.05, penalty: float = 1e-5) -> Severity:
    """Fit weights of the ``known`` features and thresholds to (text, grade) pairs by full-gradient Adam.

    Without examples of at least two grades the model calls everything clean.
    """
    grades = np.array([g for _, g in examples], int)
    if len(set(grades.tolist())) < 2:
        return Severity({}, (30.0,))
    counts = [features(t, dict.fromkeys(known, 0.0)) for t, _ in examples]
    at = {w: i for i, w in enumerate(known)}
    row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    col = np.array([at[w] for c in counts for w in c], int)
    val = np.array([math.log1p(n) for c in counts for n in c.values()], float)
    levels = int(grades.max())
    # Thresholds are a first one and positive steps, so that they stay ordered.
    parameters = np.zeros(len(known) + levels)
    parameters[len(known)] = 2.0
    m = v = np.zeros_like(parameters)
    above = (grades[:, None] > np.arange(levels)[None, :]).astype(float)
    for step in range(1, steps + 1):
        w, first, gaps = parameters[: len(known)], parameters[len(known)], parameters[len(known) + 1 :]
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, w[col] * val, len(counts))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -60, 60)))
        slope = (p - above) / len(examples)
        gradient = np.empty_like(parameters)
        gradient[: len(known)] = np.bincount(col, slope.sum(1)[row] * val, len(known)) + penalty * w
        gradient[len(known)] = -slope.sum()
        later = -slope.sum(0)[::-1].cumsum()[::-1]
        gradient[len(known) + 1 :] = later[1:] * np.exp(gaps)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        parameters = parameters - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = parameters[: len(known)]
    thresholds = parameters[len(known)] + np.concatenate([[0.0], np.cumsum(np.exp(parameters[len(known) + 1 :]))])
    return Severity({x: float(w[i]) for i, x in enumerate(known)}, tuple(map(float, thresholds)))


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade) and grade (rounded) of every row.

    A null or empty text is clean.  Repeated rows each give a row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), severity_udf(model)(F.col(text_col)).alias("severity"))
    return rows.withColumn("grade", F.round("severity").cast("int"))


def severity_udf(model: Severity):
    @F.arrow_udf("double")
    def severity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = []
            for part in slices(pa.record_batch([column], ["text"]), "text"):
                found += map(model.expected, part.column("text").to_pylist())
            yield pa.array(found, pa.float64())

    return severity


def drop_toxic(docs: DataFrame, model: Severity, from_severity: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose expected severity is below ``from_severity``."""
    return docs.filter(severity_udf(model)(F.col(text_col)) < from_severity)
