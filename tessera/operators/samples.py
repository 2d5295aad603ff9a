"""Samples of exact size from strata, the same ones on every run and any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import free

#: Parts into which a stratum's rows are dealt before its best meet.
PARTS = 64


def sampled(df: DataFrame, strata: list[str], keys: list[str], size: int, seed: int = 0, weight: str = "weight") -> DataFrame:
    """`size` rows of each stratum (all, if it has fewer), and a column `weight`: how many rows of the stratum each stands for.

    Rows are ordered by the MD5 digest of the seed and the keys, joined by
    bars, and the first are taken: a bottom-k sketch of the rows, so samples of
    parts of the data can be united and cut again to that of the whole. keys
    should tell rows apart; those with equal keys are ordered by their other
    columns, so equal rows are all that is left to chance. Null keys are their
    own value, null strata one of their own.

    A stratum is dealt to parts by digest, and each part keeps its first `size`,
    so that at most PARTS * size rows of one meet, however many it has; its
    number of rows is counted apart.
    """
    if size < 1:
        raise ValueError("a sample has a row at least")
    if weight.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {weight!r} already")
    digest, part, place, all_ = free(["_digest", "_part", "_place", "_all"], df)
    other = [f"_{all_}{i}" for i in range(len(strata))]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    rest = [F.col(c) for c in df.columns if not df.schema[c].dataType.typeName() in ("map", "variant")]
    rows = df.withColumn(digest, F.md5(text.cast("binary")))
    rows = rows.withColumn(part, F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(PARTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(digest, *rest))
    few = rows.withColumn(place, first(*strata, part)).filter(F.col(place) <= size)
    kept = few.withColumn(place, first(*strata)).filter(F.col(place) <= size)
    counts = df.groupBy(*strata).agg(F.count("*").alias(all_)).withColumnsRenamed(dict(zip(strata, other, strict=True)))
    same = F.lit(True)
    for s, o in zip(strata, other, strict=True):
        same = same & F.col(s).eqNullSafe(F.col(o))
    return kept.join(counts, same).withColumn(weight, F.col(all_) / F.least(F.col(all_), F.lit(size))).select(*df.columns, weight)
