"""As-of joins and sessions whose keys may hold any share of the rows: hot keys are cut into time slices.

Keys are counted first, which a partial aggregation does before its shuffle. A
key with more than `slice_rows` rows gets bounds at quantiles of its times, and
its rows their slice by bisection of those bounds. Rows are then dealt by key
and slice, once, and each slice is one ordered pass. What must cross from slice
to slice is a small table, with a row or two for each: the last right row, or
the sessions that touch a slice's ends. Without a hot key nothing of this is
planned. Rows of one key with one time are in one slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.saved import broadcast_if_small, saved

from . import groups, joins
from .columns import free

#: Rows of a key from which it is cut, and slices of one key at most.
SLICE_ROWS, SLICES = 1_000_000, 1024


def number(df: DataFrame, at: str) -> Column:
    """A number that rises with a time or numeric column."""
    kind = df.schema[at].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(at).cast("timestamp"))
    return F.unix_date(at).cast("long") if isinstance(kind, T.DateType) else F.col(at)


def same(by: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(by, other, strict=True)], F.lit(True))


def bounds(frames: list[tuple[DataFrame, str]], by: list[str], rows: int, names: list[str]) -> DataFrame | None:
    """(names, cuts) of the keys that have more than so many rows in all frames: the times at which their slices end. None if there is no such key."""
    keys = [F.col(b).alias(n) for b, n in zip(by, names, strict=True)]
    times = reduce(DataFrame.unionAll, [df.filter(F.col(at).isNotNull()).select(*keys, number(df, at).alias("v")) for df, at in frames])
    hot = saved(times.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > rows), "hot-keys")  # at most all rows / slice_rows
    if hot.isEmpty():
        return None
    other = [f"_{n}" for n in names]
    few = broadcast_if_small(hot.withColumnsRenamed(dict(zip(names, other, strict=True))))
    every = F.percentile_approx("v", [k / SLICES for k in range(1, SLICES)], 10 * SLICES)
    found = times.join(few, same(names, other)).groupBy(*names).agg(every.alias("q"), F.first("n").alias("n"))
    parts = F.least(F.ceil(F.col("n") / rows), F.lit(SLICES)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get("q", (k * SLICES / parts).cast("int") - 1))
    return saved(found.select(*names, F.array_distinct(cuts).alias("cuts")), "slice-bounds")


def sliced(df: DataFrame, at: str, by: list[str], cuts: DataFrame, names: list[str], out: str) -> DataFrame:
    """df with the number of each row's slice: how many of its key's cuts lie below its time. 0 without any, or without a time."""
    value, held = free([f"_value{out}", f"_cuts{out}"], df, cuts)
    rows = df.withColumn(value, number(df, at)).join(broadcast_if_small(cuts.withColumnRenamed("cuts", held)), same(by, names), "left").withColumn(out, F.lit(0))
    step = SLICES // 2
    while step:
        # a step for each power of two: the expressions stay small, and no array is walked
        rows = rows.withColumn(out, F.col(out) + F.when((F.col(out) + step <= F.size(held)) & (F.get(held, F.col(out) + (step - 1)) < F.col(value)), step).otherwise(0))
        step //= 2
    return rows.drop(value, held, *names)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], prefix: str = "r_", ties: list[Column] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """joins.asof_join(), with keys of more than slice_rows rows cut into slices.

    The last right row of each slice goes to the later slices up to the next one
    with right rows, where it stands before all of that slice's own.
    """
    part, *names = free(["_slice", *[f"_by{i}" for i in range(len(by))]], left, right)
    cuts = bounds([(left, left_on), (right, right_on)], by, slice_rows, names)
    if cuts is None:
        return joins.asof_join(left, right, by, left_on, right_on, take, prefix, ties)
    tie = F.struct(*(ties or [F.col(c) for c in take]))
    (order,) = free(["_tie"], left, right)
    slim = right.filter(F.col(right_on).isNotNull()).select(*dict.fromkeys([*by, right_on, *take]), tie.alias(order))
    two = sliced(slim, right_on, by, cuts, names, part)
    (row,) = free(["_row"], two)
    ends = saved(two.groupBy(*by, part).agg(F.max_by(F.struct(*slim.columns), F.struct(right_on, order)).alias(row)).join(broadcast_if_small(cuts), same(by, names), "left_semi"), "slice-ends")
    every = cuts.select(*names, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice_"))
    before = Window.partitionBy(*names).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows a key
    carried = every.join(ends, same(by, names) & (F.col("slice_") == F.col(part)), "left").select(*names, "slice_", F.last(row, ignorenulls=True).over(before).alias(row))
    carried = carried.filter(F.col(row).isNotNull()).select(*[F.col(f"{row}.{c}").alias(c) for c in slim.columns], F.col("slice_").alias(part))
    one = sliced(left, left_on, by, cuts, names, part)
    return joins.asof_join(one, two.unionByName(carried), [*by, part], left_on, right_on, take, prefix, [F.col(order)]).drop(part)


def sessions(df: DataFrame, by: list[str], at: str, gap: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """groups.sessions(), with keys of more than slice_rows rows cut into slices: the sessions at slices' ends, two for each at most, are joined afterwards."""
    part, *names = free(["_slice", *[f"_by{i}" for i in range(len(by))]], df)
    cuts = bounds([(df, at)], by, slice_rows, names)
    if cuts is None:
        return groups.sessions(df, by, at, gap)
    rows = sliced(df.filter(F.col(at).isNotNull()).select(*by, at), at, by, cuts, names, part)
    found = saved(groups.sessions(rows, [*by, part], at, gap), "slice-sessions")
    is_hot = found.join(broadcast_if_small(cuts), same(by, names), "left_semi")
    cold = found.join(broadcast_if_small(cuts), same(by, names), "left_anti").drop(part)
    place, last, fresh, run = free(["_place", "_last", "_fresh", "_run"], found)
    ends = is_hot.groupBy(*by, part).agg(F.min("session_start").alias(place), F.max("session_start").alias(last))
    other = [f"_{n}" for n in names]
    own = is_hot.join(ends.withColumnsRenamed(dict(zip([*by, part], [*other, f"{part}_"], strict=True))), same([*by, part], [*other, f"{part}_"])).drop(*other, f"{part}_")
    outer = (F.col("session_start") == F.col(place)) | (F.col("session_start") == F.col(last))
    order = Window.partitionBy(*by).orderBy("session_start")  # two rows a slice at most
    apart = F.coalesce((F.col("session_start") > F.lag("session_end").over(order) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    joined = own.filter(outer).withColumn(fresh, apart).withColumn(run, F.sum(fresh).over(order))
    joined = joined.groupBy(*by, run).agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n")).drop(run)
    return cold.unionByName(own.filter(~outer).select(*cold.columns)).unionByName(joined)
