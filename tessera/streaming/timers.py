"""Keyed state with event-time timers and expiry: what did not happen in time."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and time to live need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Unanswered(StatefulProcessor):
    """First events of a user that no second one followed within a time, when that time is over by the watermark.

    Open first events are a list of ids and times, the second ones a list of
    times; a batch of a user's events is appended to both at once. A user has one
    timer for a batch, at the earliest end of what it has. When the watermark
    passes it, all events up to the watermark are in, in whatever order they
    came, so the answers up to there are final: the events are given out unless a
    second one lies in their time, and leave the state. Second events stay while
    an event that is open or still to come may need them. What is left sets the
    next timer. So calls to the state grow with users and batches, not with
    events, and no event is looked at again for each other one.
    """

    def __init__(self, first: str, second: str, within: dt.timedelta):
        self.first, self.second, self.within = first, second, within // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "event_id long, at long")
        self.answers = handle.getListState("answers", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = []
        for batch in rows:
            first, second = batch[batch["event_type"] == self.first], batch[batch["event_type"] == self.second]
            if len(first):
                self.open.appendList(list(zip(first["event_id"].tolist(), first["at"].tolist(), strict=True)))
                ends.append(self.ends(int(first["at"].min())))
            if len(second):
                self.answers.appendList([(a,) for a in second["at"].tolist()])
                ends.append(int(second["at"].min()) // 1000 + 1)
        if ends:
            self.handle.registerTimer(min(ends))
        return iter(())

    def ends(self, at: int) -> int:
        """The first millisecond after an event's time is over."""
        return (at + self.within) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        answers = sorted(a for (a,) in self.answers.get())
        had = list(self.open.get())
        events = dict(had)  # the last time of an event that came twice
        over = [(e, at) for e, at in events.items() if self.ends(at) <= now]
        still = [(e, at) for e, at in events.items() if self.ends(at) > now]
        if len(still) < len(had):
            self.open.put(still) if still else self.open.clear()
        # an event that is still to come isn't older than the watermark
        least = min([*[at for _, at in still], now * 1000])
        needed = answers[bisect_left(answers, least) :]
        if len(needed) < len(answers):
            self.answers.put([(a,) for a in needed]) if needed else self.answers.clear()
        following = [self.ends(at) for _, at in still] + [a // 1000 + 1 for a in needed if a // 1000 >= now]
        if following:
            self.handle.registerTimer(min(following))
        lost = [(key[0], e, at) for e, at in over if (i := bisect_left(answers, at)) == len(answers) or answers[i] > at + self.within]
        if lost:
            users, ids, times = zip(*lost, strict=True)
            yield pd.DataFrame({"user_id": users, "event_id": ids, "at": times})

    def close(self) -> None:
        pass


def unanswered(events: DataFrame, first: str, second: str, within: dt.timedelta, late: dt.timedelta) -> DataFrame:
    """(user_id, event_id, ts) of a stream's `first` events (event_id, ts, user_id, event_type) without a `second` one of the user from then to `within` after.

    late: the watermark's delay; later events are dropped. An event is given out
    once, in append mode, when its time is over by the watermark; those whose
    time isn't when the stream ends are not. Events at one time count as in
    order. The session needs the state store STORE.
    """
    seconds = int(late.total_seconds())
    rows = events.filter(F.col("event_type").isin(first, second) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").withColumn("at", F.unix_micros("ts")).withWatermark("ts", f"{seconds} seconds")
    found = rows.groupBy("user_id").transformWithStateInPandas(Unanswered(first, second, within), "user_id long, event_id long, at long", "append", "EventTime")
    return found.select("user_id", "event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))
