"""Exact quantiles of groups of any size, by narrowing a histogram.

The plain aggregate keeps a group's distinct values in one buffer. Here a pass
over the rows counts, for each wanted rank, the values in BINS equal bins between
that rank's present bounds, and takes the bin with the rank and its own smallest
and largest value as the next bounds. Tasks combine the counts, so a pass
shuffles at most BINS rows for each rank of each group and task, and no value.
A rank is found when its bounds are one value. Evenly spread values take three
or four passes; each pass leaves at most one of BINS parts of the range, and at
least an outlier's distance, so values over d powers of BINS take about d.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.saved import broadcast_if_small, saved

#: Bins of a pass.
BINS = 1024


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "quantiles") -> DataFrame:
    """(by, out): an array of the quantiles of each group's values, interpolated as the percentile aggregate does.

    Nulls and not-a-numbers are left out; a group without other values has null
    elements. Values are taken as doubles; an infinite one is an error.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares are from 0 to 1")
    keys = [f"g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.when(~F.isnan(v), v).alias("v"))
    ends = saved(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "ends")
    if not ends.filter(F.lit(float("inf")).isin(F.abs("low"), F.abs("high"))).isEmpty():
        raise ValueError("infinite values have no quantiles")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])
    places = ends.select(*keys, "n", "low", "high", F.explode(wanted).alias("w")).withColumn("at", F.col("w.share") * (F.col("n") - 1))
    ranks = places.filter("n > 0").select(*keys, "low", "high", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # a rank's values lie within [low, high], and `below` values lie under them
    open_ = ranks.select(*keys, "rank", F.lit(0).cast("long").alias("below"), "low", "high")
    done = []
    rows = rows.filter("v is not null")
    while True:
        open_ = saved(open_, "ranks")
        done.append(open_.filter("low = high").select(*keys, "rank", F.col("low").alias("v")))
        left = saved(open_.filter("low < high"), "open-ranks")
        if left.isEmpty():
            break
        open_ = narrowed(rows, left, keys)
    found = reduce(DataFrame.unionAll, done)
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two a share
    at = F.transform(wanted, lambda w: w["share"] * (F.col("n") - 1))
    element = lambda x: F.when(F.floor(x) == F.ceil(x), F.try_element_at("m", F.floor(x))).otherwise((F.ceil(x) - x) * F.try_element_at("m", F.floor(x)) + (x - F.floor(x)) * F.try_element_at("m", F.ceil(x)))
    joined = matched(ends, values, keys, "left")
    return joined.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.transform(at, element).alias(out))


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = [f"o{k}" for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)], F.lit(True))
    return a.join(b.withColumnsRenamed(dict(zip(keys, other, strict=True))), same, how).drop(*other)


def narrowed(rows: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """left (keys, rank, below, low, high) with closer bounds."""
    spread = F.col("high") / 2 - F.col("low") / 2  # halves: the difference of two doubles may be none
    share = (F.col("v") / 2 - F.col("low") / 2) / spread
    bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
    spans = left.groupBy(*keys, "low", "high", "below").agg(F.collect_list("rank").alias("ranks"))  # ranks that share bounds share a histogram
    inside = matched(rows, broadcast_if_small(saved(spans, "spans")), keys).filter("v between low and high")
    bins = inside.groupBy(*keys, "low", "high", "below", "ranks", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = Window.partitionBy(*keys, "low", "high", "below").orderBy("bin")  # BINS rows at most
    upto = bins.withColumn("upto", F.col("below") + F.sum("n").over(before))
    hit = upto.select("*", F.explode("ranks").alias("rank")).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.select(*keys, "rank", (F.col("upto") - F.col("n")).alias("below"), F.col("least").alias("low"), F.col("most").alias("high"))
