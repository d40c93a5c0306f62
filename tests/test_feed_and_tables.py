"""Versioned tables and the stateful feed: crashes, restarts, repeated ids."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import sinks
from millrace.streaming import feed


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(10), path)
    before = sinks.read_table(spark, path)
    sinks.replace_table(spark.range(10, 30), path)
    assert before.count() == 10 and sinks.read_table(spark, path).count() == 20  # a reader that has begun keeps its version
    for k in range(3):
        sinks.replace_table(spark.range(k), path)
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 2 and sinks.read_table(spark, path).count() == 2


@pytest.mark.parametrize("step", ["write", "point"])
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(10), path)
    if step == "write":
        broken = spark.range(100).select(F.raise_error(F.lit("died")).alias("id"))
        with pytest.raises(Exception, match="died"):
            sinks.replace_table(broken, path)
    else:
        monkeypatch.setattr(sinks, "_point", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            sinks.replace_table(spark.range(99), path)
        monkeypatch.undo()
    assert sinks.read_table(spark, path).count() == 10
    sinks.replace_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 5


def test_plain_folders_become_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.insert_rows(spark.range(4).withColumn("user_id", F.lit("u")), path)
    assert sinks.current_version(spark, path) is None and sinks.read_table(spark, path).count() == 4
    sinks.delete_owned(spark, path, "u", "2")
    sinks.insert_rows(spark.range(9, 10).withColumn("user_id", F.lit("v")), path)
    assert sorted(r["id"] for r in sinks.read_table(spark, path).collect()) == [0, 1, 3, 9]


def record(k, price=1e9, date="2024-01-01T00:00:00Z", province="P"):
    return json.dumps({"listing_id": k, "transaction_type": "SALE", "currency": "VND", "area_unit": "m2", "total_price_vnd": price, "area_m2": 50, "province": province, "area_name": "A", "property_type": "house", "date": date})


def run(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "records", "stats", "cp")]
    feed.publish_stream(spark, *paths).awaitTermination(40)
    records = {r["listing_id"]: r["total_price_vnd"] for r in spark.read.parquet(paths[1]).collect()}
    return records, sorted((r["province"], r["area_name"], r["property_type"], r["n"], r["median"]) for r in sinks.read_table(spark, paths[2]).collect())


def test_feed_over_several_batches_and_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([record(f"p{i}", 1e9 * (i + 1)) for i in range(6)] + [record("p0", 7e9, "2024-02-01T00:00:00Z"), record("p0", 0.5e9, "2024-01-01T00:00:00Z"), record("bad", -1)]))
    records, stats = run(spark, tmp_path)
    assert records["p0"] == 0.5e9 and len(records) == 6 and {s[3] for s in stats} == {6}  # the earliest, then the cheapest

    (tmp_path / "in" / "b.json").write_text("\n".join([record("p1", 99e9)] + [record(f"q{i}", 2e9, province="Q") for i in range(5)]))
    records, stats = run(spark, tmp_path)
    assert records["p1"] == 2e9 and len(records) == 11 and {(s[0], s[3]) for s in stats} == {("P", 6), ("Q", 5)}

    # the last micro-batch is run again as after a crash before it was committed
    (last,) = [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name == "1"]
    last.unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run(spark, tmp_path) == (records, stats)


def test_one_record_of_an_id_whatever_the_order(spark):
    rows = [json.loads(record("a", p, d)) for p, d in ((3e9, "2024-01-02T00:00:00Z"), (2e9, "2024-01-02T00:00:00Z"), (1e9, "2024-01-03T00:00:00Z"))]
    for order in (rows, rows[::-1]):
        df = spark.read.schema(feed.FEED).json(spark.sparkContext.parallelize([json.dumps(r) for r in order]))
        assert [r["total_price_vnd"] for r in feed.valid_records(df, now="2025-01-01").collect()] == [2e9]
