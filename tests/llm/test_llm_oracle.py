"""The queries of this subpackage that SQL can express, against DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_oracle import DATA, TABLES, normal  # noqa: E402

from millrace.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), columns)


def test_quality_scores_on_held_out_rows(spark):
    scored = queries.QUERIES["op5_pairwise_quality"](spark, DATA.replace("0.001", "0.01"))
    labels = spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.9
