"""Command line check of all queries: python tests/check_queries.py SF_DIR [NAME ...]"""

import pathlib
import sys
import time

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1]), str(pathlib.Path(__file__).resolve().parent)]

import __spark_entry__ as entry
from oracle import compare, connect
from spendloom.session import local_session

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    wrong = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        wrong += problem is not None
        print(f"{name:26s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("different:", wrong)
