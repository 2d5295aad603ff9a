"""Operators and formats on hand-made rows: nulls, ties, empty tables, late events."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import groups, joins
from tessera.sources import formats
from tessera.streaming import windows


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", 10, "w"), (None, 1, "n")], "k string, t int, v string")
    got = joins.asof_join(left, right, ["k"], "t", "t", ["v"])
    assert {r.id: r.r_v for r in got.collect()} == {1: "y", 2: None, 3: None, 4: "n"}
    assert joins.asof_join(left.limit(0), right, ["k"], "t", "t", ["v"]).collect() == []


def test_asof_ties_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", 5, "l")], "id int, k string, t int, _left string")
    right = spark.createDataFrame([("a", 5, "x", 2), ("a", 5, "y", 1), ("a", None, "z", 9)], "k string, t int, v string, _at int")
    assert [(r._left, r.r_v) for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()] == [("l", "y")]
    assert [r.r_v for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"], ties=[F.col("_at")]).collect()] == ["x"]


def test_interval_join_and_gaps(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    left = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(50)), ("b", 3, at(0)), (None, 4, at(0))], "k string, i int, t timestamp")
    right = spark.createDataFrame([("a", 10, at(0)), ("a", 11, at(30)), ("a", 12, at(60)), ("b", 13, None), (None, 14, at(0))], "k string, j int, u timestamp")
    got = sorted((r.i, r.j) for r in joins.interval_join(left, right, ["k"], "t", "u", 1800).collect())
    assert got == [(1, 10), (1, 11), (2, 12)]
    days = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5), ("a", dt.date(2024, 1, 4), 7), (None, dt.date(2024, 1, 2), 1)], "k string, d date, n long")
    got = {(r.k, r.d.day): r.n for r in groups.fill_gaps(days, ["k"], "d", "1 day", "n", 0).collect()}
    assert got == {("a", 1): 5, ("a", 2): 0, ("a", 3): 0, ("a", 4): 7, (None, 2): 1}


def test_range_join_equals_the_nested_loop(spark):
    left = spark.createDataFrame([(i, float(i) * 0.7 - 3) for i in range(40)], "i int, x double")
    right = spark.createDataFrame([(j, float(j) - 4, float(j) - 4 + j % 5) for j in range(20)], "j int, low double, high double")
    got = {(r.i, r.j) for r in joins.range_join(left, right, [], "x", "low", "high", 2.0).collect()}
    assert got == {(a.i, b.j) for a in left.collect() for b in right.collect() if b.low <= a.x <= b.high}


def test_salted_join_and_counts_equal_the_plain_ones(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(200)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k long, w string")
    assert sorted(joins.salted_join(left, right, ["k"], 5).collect()) == sorted(left.join(right, "k").select("k", "v", "w").collect())
    same = spark.createDataFrame([(1, 7, 0)] * 50, "k long, v long, _salt int")
    assert joins.salted_join(same, right, ["k"], 5).count() == 100 and "_salt" in joins.salted_join(same, right, ["k"], 5).columns
    nulls = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "k string, v long")
    assert {r.k: r.n_distinct for r in groups.salted_counts(nulls, ["k"], "v").collect()} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        groups.top_per_group(left.withColumn("rank", F.lit(1)), ["k"], [F.col("v")], 1)
    got = {r.k: r.n_distinct for r in groups.salted_counts(left, ["k"], "v").collect()}
    assert got == {r.k: r.n for r in left.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}


def test_top_rows_and_sessions(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("a", at(0)), ("a", at(5)), ("a", at(30)), ("b", at(1)), (None, at(2))], "k string, ts timestamp")
    got = {(r.k, r.session_start.minute): r.n for r in groups.sessions(df, ["k"], "ts", "10 minutes").collect()}
    assert got == {("a", 0): 2, ("a", 30): 1, ("b", 1): 1, (None, 2): 1}
    top = groups.top_per_group(df, ["k"], [F.desc("ts")], 1).collect()
    assert {(r.k, r.ts.minute, r.rank) for r in top} == {("a", 30, 1), ("b", 1, 1), (None, 2, 1)}


@pytest.mark.parametrize("fmt", sorted({*formats.OPTIONS} - {"text"}))
def test_formats_give_back_what_was_written(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "b",\nc', 1.5), (2, None, None), (3, "", 0.0), (None, "é", -1.0)], "i long, s string, d double")
    formats.write(df, f"{tmp_path}/x", fmt)
    assert sorted(map(str, formats.read(spark, f"{tmp_path}/x", fmt, df.schema).collect())) == sorted(map(str, df.collect()))


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r.c if r.c is None else round(r.c, 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.96, None, None, None]


def test_stream_drops_late_events_in_append_mode(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    shape = "event_id long, ts timestamp_ntz, event_type string, value double"
    for i, rows in enumerate([[(1, at(0, 10), "c", 1.0), (2, at(0, 50), "c", 2.0)], [(3, at(3), "c", 1.0)], [(6, at(3, 30), "c", 1.0)], [(4, at(0, 20), "c", 9.0)], [(5, at(6), "c", 1.0)]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/s/{i}")
        for file in (tmp_path / "s" / str(i)).iterdir():
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)
    schema = spark.createDataFrame([], shape).schema
    read = lambda: windows.replay(spark, f"{tmp_path}/s/*", schema, lambda s: windows.counts(s, "1 hour", late="10 minutes"), output="append")
    got = {r.window_start.hour: (r.n, r.total) for r in read().collect()}
    assert got[0] == (2, 3.0) and 6 not in got


def test_not_in(spark):
    """As SQL has it with nulls and empty tables, and without sending the table to every task."""
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, "e")], "x int, w string")
    for keys in ([2, 2, 3], [2, None], [], [None], [1, 2, 4]):
        right = spark.createDataFrame([(k,) for k in keys], "y int")
        want = spark.sql("SELECT * FROM {l} WHERE x NOT IN (SELECT y FROM {r})", l=left, r=right)
        assert sorted(joins.not_in(left, right, "x", "y").collect(), key=str) == sorted(want.collect(), key=str)
    from tessera.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["not_in_subquery"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
