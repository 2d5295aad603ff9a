"""Parquet tables of a data directory, reachable through any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; an unknown name is an error before any file is touched."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
