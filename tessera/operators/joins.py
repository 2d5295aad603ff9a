"""Joins that Spark has no single operator for, as compositions of public ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import free


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], prefix: str = "r_", ties: list[Column] | None = None) -> DataFrame:
    """Each left row with the columns `take` of the last right row of its key at or before it, nulls where there is none.

    Both sides are dealt by key once and one ordered pass carries the last
    right row forward; at equal times right rows come first, in the order of
    `ties` (columns of right; by default of `take`), so the last of them is
    taken. Null keys meet each other, as in grouping; a left row without a time
    has no right row, and right rows without one are never taken. A key's rows
    are in one task.
    """
    at, side, tie, own, other, last = free(["_at", "_side", "_tie", "_left", "_right", "_last"], left, right)
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    two = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias(at), F.lit(0).alias(side), F.struct(*(ties or [F.col(c) for c in take])).alias(tie), payload.alias(other))
    one = left.select(*by, F.col(left_on).alias(at), F.lit(1).alias(side), F.struct(*left.columns).alias(own))
    order = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), side, tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = one.unionByName(two, allowMissingColumns=True).withColumn(last, F.last(other, ignorenulls=True).over(order))
    return carried.filter(F.col(side) == 1).select(f"{own}.*", *[F.col(f"{last}.{c}").alias(f"{prefix}{c}") for c in take])


def range_join(left: DataFrame, right: DataFrame, by: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left whose `at` is within [low, high] of rows of right, by equal keys, for right ranges of about `width` or less.

    Both sides are cut into buckets of that width, so the join has an equality
    on the bucket also where `by` is empty; a range is repeated in each bucket
    that it meets. Ranges that end before they begin, or lack an end, meet nothing.
    """
    (cut,) = free(["_bucket"], left, right)
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = right.filter(F.col(low) <= F.col(high)).withColumn(cut, F.explode(F.sequence(bucket(low), bucket(high))))
    joined = left.withColumn(cut, bucket(at)).join(spread, [*by, cut])
    return joined.filter(F.col(at).between(F.col(low), F.col(high))).drop(cut)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, seconds: float) -> DataFrame:
    """Pairs of a left row and a right row of its key that comes at most so many seconds after it (times are timestamps), by range_join()."""
    begin, end, place = free(["_begin", "_end", "_place"], left, right)
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    spans = left.withColumns({begin: time(left_at), end: time(left_at) + F.lit(float(seconds))})
    return range_join(right.withColumn(place, time(right_at)), spans, by, place, begin, end, float(seconds) or 1.0).drop(begin, end, place)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int) -> DataFrame:
    """An inner equi-join whose left keys may be hot: left rows of a key, equal ones too, are dealt to `salts` parts by their place, right rows are repeated for each."""
    (salt,) = free(["_salt"], left, right)
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts).cast("long"))).join(spread, [*on, salt]).drop(salt)


def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Left rows of which `left_col NOT IN (SELECT right_col FROM right)` is true, by a shuffled anti join.

    Spark's own plan of NOT IN sends the whole of right to every task, because of
    nulls. Here they are counted first: any null in right leaves no row, a null
    of left stays only where right is empty.
    """
    key, n, known = free(["_key", "_n", "_known"], left, right)
    counted = right.agg(F.count("*").alias(n), F.count(right_col).alias(known))  # one row
    others = right.filter(F.col(right_col).isNotNull()).select(F.col(right_col).alias(key))
    rest = left.join(others, F.col(left_col) == F.col(key), "left_anti").crossJoin(F.broadcast(counted))
    return rest.filter((F.col(n) == 0) | ((F.col(n) == F.col(known)) & F.col(left_col).isNotNull())).drop(n, known)
