"""The ledger of batches: repeats, restarts between the two writes, and streams read to their end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import upserts, windows

SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def files(spark, path, parts):
    for i, rows in enumerate(parts):
        made = [(e, dt.datetime(2024, 1, 1, h), u, "c", v) for e, h, u, v in rows]
        spark.createDataFrame(made, SHAPE).coalesce(1).write.mode("append").parquet(f"{path}/{i}")


def test_repeated_batches_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batch = lambda rows: spark.createDataFrame(rows, "k string, n long")
    read = lambda: sorted((tuple(r) for r in upserts.latest(spark, path, batch([]).schema, ["k"]).collect()), key=repr)
    assert read() == []
    upserts.put(batch([("a", 1), ("b", 1)]), 0, path, ["k"])
    upserts.put(batch([("b", 2), (None, 5)]), 1, path, ["k"])
    want = [("a", 1), ("b", 2)]
    assert [r for r in read() if r[0]] == want and (None, 5) in upserts.latest(spark, path, batch([]).schema, ["k"]).collect()
    upserts.put(batch([("b", 99)]), 1, path, ["k"])  # in the ledger already
    assert [r for r in read() if r[0]] == want
    with pytest.raises(ValueError):
        upserts.put(batch([("x", 1), ("x", 2)]), 2, path, ["k"])
    assert [r for r in read() if r[0]] == want  # written, not in the ledger
    upserts.put(batch([("x", 3)]), 2, path, ["k"])
    assert ("x", 3) in read() and len([r for r in read() if r[0] == "x"]) == 1


def test_restart_between_write_and_ledger(spark, tmp_path, monkeypatch):
    files(spark, f"{tmp_path}/in", [[(1, 0, 1, 1.0), (2, 1, 2, 2.0)], [(3, 2, 1, 4.0)], [(4, 3, 2, 8.0), (5, 4, 3, 16.0)]])
    source = lambda: windows.totals(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    path, progress = f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    enter, calls = upserts.enter, []

    def broken(session, number, n, at):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost between the two writes")
        enter(session, number, n, at)

    monkeypatch.setattr(upserts, "enter", broken)
    query = upserts.upsert(source(), path, ["user_id"], progress)
    with pytest.raises(Exception, match="between"):
        query.awaitTermination()
    query = upserts.upsert(source(), path, ["user_id"], progress)
    query.awaitTermination()
    assert calls[1] == calls[2]  # the same batch again
    got = {r.user_id: (r.n, r.total) for r in upserts.latest(spark, path, source().schema, ["user_id"]).collect()}
    assert got == {1: (2, 5.0), 2: (2, 10.0), 3: (1, 16.0)}
    assert upserts.committed(spark, path).select(F.count_distinct("batch")).first()[0] == 3


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    files(spark, f"{tmp_path}/in", [[(1, 0, 1, 1.0)], [(2, 0, 1, 2.0), (3, 5, 1, 1.0)]])
    schema = spark.createDataFrame([], SHAPE).schema
    got = windows.replay(spark, f"{tmp_path}/in/*", schema, lambda s: windows.counts(s, "1 hour", late="10 minutes"))
    assert {r.window_start.hour: r.n for r in got.collect()} == {0: 2, 5: 1}
