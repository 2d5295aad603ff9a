"""Join of two tables of intervals that overlap, whatever their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.saved import broadcast_if_small, saved

from .columns import free

#: Rows of a key on one side up to which all its rows are compared.
LIGHT = 64

#: Widths of buckets rise by this factor from scale to scale.
FACTOR = 4


def scale(low: Column, high: Column, base: float) -> Column:
    """The smallest scale whose buckets are as wide as the interval, or about so."""
    return F.greatest(F.ceil(F.log(F.greatest((high - low).cast("double"), F.lit(base)) / base) / F.log(F.lit(float(FACTOR)))).cast("int"), F.lit(0))


def width(of: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(float(FACTOR)), of.cast("double"))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], base: float = 1.0) -> DataFrame:
    """Pairs of a left and a right row of equal `by` whose closed intervals meet; each pair once. Ends are numbers.

    Keys that have at most LIGHT rows on one of the sides are joined by `by`
    alone, no row repeated: a row meets LIGHT others at most, on the average.
    Keys with more on both sides, and all rows where `by` is empty, are joined in
    buckets (see in_buckets). Rows of each key are counted first, so both sides
    are read several times: save those that are costly.

    base: the width of the smallest buckets; about the shortest common length.
    Intervals that end before they begin, or lack an end, meet nothing, and null
    keys meet nothing. No two columns but `by` may share a name.
    """
    clash = ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - {b.lower() for b in by}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    left, right = (df.filter(F.col(low) <= F.col(high)) for df, (low, high) in ((left, left_ends), (right, right_ends)))
    if not by:
        return in_buckets(left, right, by, left_ends, right_ends, base)
    many = lambda df: df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > LIGHT).select(*by)
    # of n rows, n / LIGHT keys at most
    heavy = saved(many(left).join(many(right), by), "heavy-keys")
    meets = (F.col(left_ends[0]) <= F.col(right_ends[1])) & (F.col(right_ends[0]) <= F.col(left_ends[1]))
    columns = [*left.columns, *[c for c in right.columns if c not in by]]
    if heavy.isEmpty():
        return left.join(right, by).filter(meets).select(*columns)
    keys = broadcast_if_small(heavy)
    light = left.join(keys, by, "left_anti").join(right, by).filter(meets).select(*columns)
    hot = in_buckets(left.join(keys, by, "left_semi"), right.join(keys, by, "left_semi"), by, left_ends, right_ends, base)
    return light.unionByName(hot.select(*columns))


def in_buckets(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], base: float) -> DataFrame:
    """overlap_join() of rows with whole intervals, through buckets of several scales, however many rows a key has.

    Each interval has a home in the buckets of its own scale, about as wide as
    itself: two at most, or three where rounding has it. Two intervals meet in a
    bucket of the longer one's scale. So the rows of one side visit, at each
    scale that the other side has from their own up, the buckets they touch, and
    meet what is at home there; a second join has the pairs whose longer one is on
    the first side. A row becomes at most 3 rows for each scale of the other
    side (from lengths of 1 to 10**12 there are 21) and 3 more, however long it
    is; none is exploded into the small buckets of the other side's short ones.
    A pair that shares several buckets is kept in the one in which the later of
    the two begins. Hot buckets are ordinary join keys, which Spark splits.
    """
    own, at, bucket = free(["_own", "_scale", "_bucket"], left, right)

    def ready(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return df.withColumn(own, scale(F.col(ends[0]), F.col(ends[1]), base))

    def cells(df: DataFrame, ends: tuple[str, str], scales: Column, s: str, b: str) -> DataFrame:
        touched = lambda k: F.sequence(*[F.floor(F.col(e) / width(k, base)) for e in ends])
        return df.withColumn(s, F.explode(scales)).withColumn(b, F.explode(touched(F.col(s))))

    sides = [(ready(left, left_ends), left_ends), (ready(right, right_ends), right_ends)]
    out = None
    for k in (0, 1):
        (guests, guest_ends), (hosts, host_ends) = sides[k], sides[1 - k]
        present = sorted(r[0] for r in hosts.select(own).distinct().collect())  # a few dozen numbers
        wide = F.filter(F.array(*[F.lit(p) for p in present]).cast("array<int>"), lambda s: s >= F.col(own) + k)  # equal scales meet in the first join only
        visiting = cells(guests, guest_ends, wide, at, bucket).drop(own)
        home = cells(hosts, host_ends, F.array(own), at, bucket).drop(own)
        joined = visiting.join(home, [*by, at, bucket])
        later = F.greatest(F.col(guest_ends[0]), F.col(host_ends[0]))
        meets = (F.col(guest_ends[0]) <= F.col(host_ends[1])) & (F.col(host_ends[0]) <= F.col(guest_ends[1])) & (F.floor(later / width(F.col(at), base)) == F.col(bucket))
        pairs = joined.filter(meets).select(*[F.col(c) for c in left.columns], *[F.col(c) for c in right.columns if c not in by])
        out = pairs if out is None else out.unionByName(pairs)
    return out
