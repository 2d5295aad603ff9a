"""File formats by name, with schemas given rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options that make a format's files read back what was written.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "text": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
}


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.format(fmt).mode(mode).options(**OPTIONS[fmt])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format: {fmt}")
    return spark.read.format(fmt).schema(schema).options(**OPTIONS[fmt]).load(path)
