"""Sketches kept at a fine grain and rolled up: distinct counts, quantiles and frequencies of any coarser group, without the rows.

A table of sketches has a row for each fine group: a HyperLogLog state of what
is to be counted, a KLL state of what is to be ranked, and a count-min state of
what is to be looked up. All three are merged by group, so the table can be
written once and rolled up to any of its keys, or to new rows added later.

The count-min state is an array of `depth` rows of `width` counts, end to end,
and the number of rows it has seen. It is made from one count for each cell,
which tasks combine first, and merged cell by cell; a state never has more than
depth * width numbers.
"""

from __future__ import annotations

from math import ceil, e, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free

#: Binary logarithm of the registers of the distinct counts, and size of the quantiles' state.
LG_K, KLL_K = 12, 200


def cell_sizes(share: float, chance: float) -> tuple[int, int]:
    """(depth, width) of a count-min state whose estimates are too high by more than `share` of all rows with at most that chance."""
    return ceil(log(1 / chance)), ceil(e / share)


def cells(item: Column, depth: int, width: int) -> list[Column]:
    """The places of an item's counts in the state, one in each row."""
    return [(F.pmod(F.xxhash64(F.lit(d), item.cast("string")), F.lit(width)) + d * width).cast("int") for d in range(depth)]


def count_min(df: DataFrame, by: list[str], item: str, depth: int, width: int, out: str) -> DataFrame:
    """(by, out): a count-min state (cells, n) of each group; null items count in n only."""
    place, n, all_ = free(["_place", "_n", "_all"], df)
    spread = df.withColumn(place, F.explode(F.when(F.col(item).isNotNull(), F.array(*cells(F.col(item), depth, width))).otherwise(F.array().cast("array<int>"))))
    counts = spread.groupBy(*by, place).agg(F.count("*").alias(n))  # at most depth * width rows a group
    return packed(counts, by, place, n, depth * width, out, df.groupBy(*by).agg(F.count("*").alias(all_)), all_)


def packed(counts: DataFrame, by: list[str], place: str, n: str, size: int, out: str, totals: DataFrame, total: str) -> DataFrame:
    (found,) = free(["_found"], counts, totals)
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(place, n))).alias(found))
    other = [f"_of{i}" for i in range(len(by))]
    same = F.lit(True)
    for b, o in zip(by, other, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(o))
    both = totals.join(held.withColumnsRenamed(dict(zip(by, other, strict=True))), same, "left")
    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col(found), i), F.lit(0).cast("long")))
    return both.select(*by, F.struct(F.coalesce(full, F.array_repeat(F.lit(0).cast("long"), size)).alias("cells"), F.col(total).alias("n")).alias(out))


def merge_count_min(df: DataFrame, by: list[str], state: str, size: int, out: str) -> DataFrame:
    """(by, out): the sums of the states of each group; they must be of one size."""
    place, n, all_ = free(["_place", "_n", "_all"], df)
    rows = df.select(*by, F.posexplode(F.col(state)["cells"]).alias(place, n))
    counts = rows.groupBy(*by, place).agg(F.sum(n).alias(n))
    return packed(counts, by, place, n, size, out, df.groupBy(*by).agg(F.sum(F.col(state)["n"]).alias(all_)), all_)


def frequency(state: Column, item: Column, depth: int, width: int) -> Column:
    """At least how often an item occurs, and at most share * n more (but for the chance given to cell_sizes)."""
    return F.array_min(F.array(*[F.get(state["cells"], c) for c in cells(item, depth, width)]))


def sketches(df: DataFrame, by: list[str], distinct: str, ranked: str, item: str, share: float = 0.005, chance: float = 0.001, lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """(by, hll, kll, cm): the states of each fine group; nulls are left out of each."""
    depth, width = cell_sizes(share, chance)
    states = df.groupBy(*by).agg(F.hll_sketch_agg(distinct, F.lit(lg_k)).alias("hll"), F.kll_sketch_agg_double(F.col(ranked).cast("double"), F.lit(kll_k)).alias("kll"))
    return beside(states, count_min(df, by, item, depth, width, "cm"), by)


def rolled_up(fine: DataFrame, by: list[str], share: float = 0.005, chance: float = 0.001) -> DataFrame:
    """(by, hll, kll, cm): the states of coarser groups; by: some of the fine table's keys, or none."""
    depth, width = cell_sizes(share, chance)
    states = fine.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))
    return beside(states, merge_count_min(fine, by, "cm", depth * width, "cm"), by)


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Both tables' columns; each has one row for each group, nulls included."""
    other = [f"_by{i}" for i in range(len(by))]
    same = F.lit(True)
    for x, o in zip(by, other, strict=True):
        same = same & F.col(x).eqNullSafe(F.col(o))
    return a.join(b.withColumnsRenamed(dict(zip(by, other, strict=True))), same).drop(*other)
