"""Every engine query against its SQL, or for rows where it has none."""

import math
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import SMALL

from granary.plans import queries
from granary.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    assert len(df.columns) == len(set(df.columns))
    if name in queries.SQL:
        want = db.execute(queries.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_counts_every_document(spark, tmp_path):
    docs = [(i, f"d{i} a short text", "en", "hot", 10) for i in range(1100)] + [(2000, "d2000 b text", "de", "hot", 10), (2001, "d2001 text", "en", "cold", 7), (2002, "d2002 text", "en", "hot", 10)]
    for name, df in {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(2002, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "another passage that no document holds, of more than eight words")], "item_id long, text string"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["source"]: (r["documents"], r["chars"], r["languages"]) for r in queries.flagship(spark, str(tmp_path)).collect()}
    assert got == {"hot": (1101, 11010, 2), "cold": (1, 7, 1)}


def test_length_histogram_has_no_end(spark, tmp_path):
    lengths = [0, 19_999, 20_000, 3_980_000, 3_980_001, 9_000_000]
    spark.createDataFrame([(i, "en", n) for i, n in enumerate(lengths)], "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["bin"]: r["n"] for r in queries.QUERIES["length_histogram"](spark, str(tmp_path)).collect()}
    assert got == {0: 2, 1: 1, 199: 2, 450: 1}


def test_database_is_read_by_other_processes(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from granary.plans import queries
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print("rows:", queries.QUERIES["database_rows"](spark, "{SMALL}").count())
"""
    env = {**os.environ, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "rows: 25" in out.stdout, out.stderr[-2000:]


def test_database_keeps_every_row_and_null(spark, tmp_path):
    rows = [(i, 2**40 + i, None if i % 3 == 0 else "é'\\" * (i % 7), None if i % 5 == 0 else i / 3, i % 2 == 0) for i in range(2500)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b long, c string, d double, e boolean")
    url = sinks.write_database(df, f"file://{tmp_path}/some.jar", "kept")
    back = readers.read_database(spark, url, "kept")
    assert back.columns == df.columns and sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
