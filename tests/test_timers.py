"""Timers on events out of order, over several files, against a plain version."""

import datetime as dt
import os
import random

import pandas as pd
import pytest

from tessera.streaming import timers, windows

SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name, kind = timers.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    yield spark
    spark.conf.set(name, before)


def test_unanswered_views_out_of_order(store, tmp_path):
    rng = random.Random(3)
    events = [(i, BEGIN + dt.timedelta(minutes=20 * i + rng.randrange(-60, 60), microseconds=rng.randrange(10**6)), rng.choice([1, 2, None]), rng.choice(["view", "purchase", "click"]), 0.0, "") for i in range(120)]
    events.insert(3, (500, events[0][1], 1, "view", 0.0, ""))
    events += [(501, BEGIN + dt.timedelta(days=9), 1, "view", 0.0, ""), (502, BEGIN + dt.timedelta(days=9, hours=2), 1, "purchase", 0.0, "")]
    for k in range(0, len(events), 25):
        store.createDataFrame(events[k : k + 25], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for file in (tmp_path / "in" / str(k)).iterdir():
            os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    within, late = dt.timedelta(hours=2), dt.timedelta(hours=4)
    schema = store.createDataFrame([], SHAPE).schema
    out = windows.replay(store, f"{tmp_path}/in/*", schema, lambda s: timers.unanswered(s, "view", "purchase", within, late), "append")
    got = sorted((r.user_id, r.event_id, r.ts) for r in out.collect())
    mine = [e for e in events if e[2] is not None and e[3] != "click"]
    over = max(e[1] for e in mine) - late
    want = sorted((e[2], e[0], e[1]) for e in mine if e[3] == "view" and e[1] + within <= over and not any(o[3] == "purchase" and o[2] == e[2] and e[1] <= o[1] <= e[1] + within for o in mine))
    assert got == want and 5 < len(want) < 40


class Counting:
    """A handle that keeps lists and timers of one user, and counts the calls."""

    def __init__(self):
        self.calls, self.lists, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return Listed(self, self.lists.setdefault(name, []))

    getMapState = None  # a call for each event

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Listed:
    def __init__(self, handle, rows):
        self.handle, self.rows = handle, rows

    def called(self):
        self.handle.calls += 1
        return self.rows

    def get(self):
        return iter(list(self.called()))

    def appendList(self, rows):
        self.called().extend(rows)

    def put(self, rows):
        self.called()[:] = rows

    def clear(self):
        self.called().clear()


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_calls_to_the_state_do_not_grow_with_a_users_events():
    rng, within = random.Random(4), 7_200_000_000
    at = [rng.randrange(10**13) for _ in range(4000)]
    batch = pd.DataFrame({"event_id": range(4000), "event_type": [rng.choice(["view", "purchase"]) for _ in at], "at": at})
    handle, own = Counting(), timers.Unanswered("view", "purchase", dt.timedelta(hours=2))
    own.init(handle)
    list(own.handleInputRows((1,), iter([batch]), Now(0)))
    got, marks = [], [4 * 10**9, 7 * 10**9, 10**10 + 10**8]
    for mark in marks:  # as the watermark rises
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            for out in own.handleExpiredTimer((1,), Now(mark), Now(t)):
                got += out["event_id"].tolist()
    buys = [a for a, kind in zip(at, batch["event_type"], strict=True) if kind == "purchase"]
    assert sorted(got) == [i for i, kind in enumerate(batch["event_type"]) if kind == "view" and not any(at[i] <= b <= at[i] + within for b in buys)]
    assert handle.calls < 30 and not handle.timers and not any(handle.lists.values())
