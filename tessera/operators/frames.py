"""Operators in vectorised Python: grouped and cogrouped maps, Arrow batches, table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centred(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, key, value less the group's mean), a group at a time; groups must fit a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(**{value: group[value] - group[value].mean()})

    rows = df.select(by, key, value)
    return rows.groupBy(by).applyInPandas(run, rows.schema)


def share_of_other(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """(by, share): the left sum of a column over the right one, for keys of either side; null without a right sum."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        above, below = (x[value].sum() if len(x) else 0.0 for x in (a, b))
        return pd.DataFrame({by: [(a if len(a) else b)[by].iloc[0]], "share": [above / below if below else None]})

    # aliases: sides of one origin would share their columns' identities
    sides = [df.select(F.col(by).alias(by), F.col(value).alias(value)).groupBy(by) for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, f"{by} long, share double")


def arrow_filter(df: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose column is at least so much, filtered as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(batch.column(batch.schema.get_field_index(column)), least))

    return df.mapInArrow(run, df.schema)


@F.udtf(returnType="place int, word string")
class Split:
    """A row for each word of a text."""

    def eval(self, text: str):
        for i, word in enumerate((text or "").split(" ")):
            yield i, word
