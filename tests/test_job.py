import os
import pathlib
import shutil
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pyspark
from pyspark.sql import functions as F

from spendloom.__main__ import main
from spendloom.operators import order
from spendloom.session import shared_dir, temporary_tables, write_shared


def test_temporary_tables(spark):
    before = write_shared(spark.range(3), "outer")
    with temporary_tables(spark):
        inside = write_shared(spark.range(4), "inner")
        folder = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inside.count() == 4 and os.path.isdir(folder)
    assert not os.path.isdir(folder)
    assert before.count() == 3
    assert "inner" not in " ".join(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_table_job(spark, tmp_path):
    rows = [("Acme", "$5"), ("ACME", "5.00"), ("Stripe", "1")]
    spark.createDataFrame(rows, "merchant string, amount string").coalesce(1).write.json(str(tmp_path / "in"))
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--format", "json", "--config", '{"enable_ai": false}'])
    out = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert sorted((r.merchant, r.amount) for r in out.collect()) == [("Acme", 5.0), ("Stripe", 1.0)]
    found = spark.read.parquet(str(tmp_path / "out" / "insights"))
    assert found.filter("name = 'total_amount'").first().value == 6.0


def test_payload_job(spark, tmp_path):
    bodies = [(1, '[{"merchant":"Stripe","amount":1}]'), (2, '[{"merchant":"Stripe","amount":1}]'), (3, "[]")]
    spark.createDataFrame(bodies, "payload_id long, body string").write.parquet(str(tmp_path / "in"))
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--payloads"])
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "rejects")).count() == 1
    found = spark.read.parquet(str(tmp_path / "out" / "insights"))
    stripe = found.filter((F.col("section") == "top_vendors") & (F.col("name") == "Stripe"))
    assert sorted((r.payload_id, r.value) for r in stripe.collect()) == [(1, 1), (2, 1)]
    assert spark.read.parquet(str(tmp_path / "out" / "usage")).count() == 2


MODEL = """
def make():
    return lambda prompts, max_tokens, temperature: [p.split("Merchant: ")[1].split(chr(10))[0].upper() for p in prompts]
"""


def test_job_with_model_and_cache(spark, tmp_path):
    (tmp_path / "loud_model.py").write_text(MODEL)
    spark.sparkContext.addPyFile(str(tmp_path / "loud_model.py"))
    rows = [("Acme", "$5"), ("Acme", "7"), ("Stripe", "1")]
    spark.createDataFrame(rows, "merchant string, amount string").coalesce(1).write.json(str(tmp_path / "in"))
    common = ["--format", "json", "--output-format", "json", "--vendor-model", "loud_model:make"]
    main([str(tmp_path / "in"), str(tmp_path / "a"), *common, "--cache", "new"])
    assert {r.merchant for r in spark.read.json(str(tmp_path / "a" / "rows")).collect()} == {"ACME", "STRIPE"}
    assert spark.read.json(str(tmp_path / "a" / "usage")).first().cache_hits == 1
    main([str(tmp_path / "in"), str(tmp_path / "b"), *common, "--cache", str(tmp_path / "a" / "cache")])
    assert spark.read.json(str(tmp_path / "b" / "usage")).first().cache_hits == 3


def test_submitted_script(tmp_path):
    """The documented command, through spark-submit in local mode."""
    home = pathlib.Path(pyspark.__file__).parent
    root = pathlib.Path(__file__).resolve().parents[1]
    table = pa.table({"merchant": ["Acme", "ACME"], "amount": ["$5", "5.00"]})
    (tmp_path / "in").mkdir()
    pq.write_table(table, tmp_path / "in" / "a.parquet")
    shutil.make_archive(str(tmp_path / "spendloom"), "zip", root, "spendloom")
    command = [str(home / "bin" / "spark-submit"), "--master", "local[2]", "--conf", "spark.ui.enabled=false"]
    command += ["--py-files", str(tmp_path / "spendloom.zip"), str(root / "job.py"), str(tmp_path / "in"), str(tmp_path / "out")]
    environment = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_HOME")}
    environment["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run(command, cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert pq.read_table(tmp_path / "out" / "rows").to_pylist()[0]["amount"] == 5.0


def test_rows_without_an_id_keep_the_order_of_their_files(spark, tmp_path):
    spark.range(0, 400).selectExpr("id AS n", "'x' AS merchant").repartition(7).sortWithinPartitions("n").write.parquet(str(tmp_path / "t"))
    found = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        numbered = order.add_txn_id(spark.read.parquet(str(tmp_path / "t")))
        found.append([r.n for r in numbered.orderBy("txn_id").collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and sorted(found[0]) == list(range(400))
