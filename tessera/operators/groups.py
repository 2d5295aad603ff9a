"""Operators on groups of rows: top rows, sessions, gap filling and two-step aggregation of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import free


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group with their place in a column `out`; Spark limits each task's rows before the shuffle."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out!r} already")
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(out) <= n)


def sessions(df: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """(by, session_start, session_end, n): runs of rows at most `gap` apart. A row without a time is in no session."""
    fresh_, session = free(["_fresh", "_session"], df)
    order = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce((F.col(at) > F.lag(at).over(order) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    marked = df.filter(F.col(at).isNotNull()).select(*by, at, fresh.alias(fresh_)).withColumn(session, F.sum(fresh_).over(order))
    return marked.groupBy(*by, session).agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count("*").alias("n")).drop(session)


def salted_counts(df: DataFrame, by: list[str], distinct: str, salts: int = 16) -> DataFrame:
    """Exact distinct counts of a column by keys that may be hot: values are dealt to parts, parts are summed. A key with nulls only counts 0."""
    (part,) = free(["_part"], df)
    parts = df.groupBy(*by, F.pmod(F.xxhash64(distinct), F.lit(salts)).alias(part)).agg(F.count_distinct(distinct).alias("n"))
    return parts.groupBy(*by).agg(F.sum("n").alias("n_distinct"))


def fill_gaps(df: DataFrame, by: list[str], at: str, step: str, value: str, fill) -> DataFrame:
    """A row for each step of each group from its first to its last, with the group's value there or `fill`. df has at most one row for a group and step."""
    low, high, step_ = free(["_low", "_high", "_at"], df)
    ends = df.groupBy(*by).agg(F.min(at).alias(low), F.max(at).alias(high))
    every = ends.select(*by, F.explode(F.sequence(low, high, F.expr(f"interval {step}"))).alias(step_))
    names = free([f"_{c}" for c in (*by, at, value)], df, every)
    held = df.select(*[F.col(c).alias(n) for c, n in zip((*by, at, value), names, strict=True)])
    keys = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((*by, step_), names, strict=False)]
    joined = every.join(held, keys, "left")
    return joined.select(*by, F.col(step_).alias(at), F.coalesce(names[-1], F.lit(fill)).alias(value))
