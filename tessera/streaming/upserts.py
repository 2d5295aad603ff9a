"""A stream's results as a table of the last row of each key, which a repeated batch doesn't change.

Every micro-batch writes its rows to a folder of its own number, over whatever a
broken attempt left there, and then its number to a ledger. Readers take only
batches that the ledger has, and each key's row of the highest. So a batch that
is repeated because the stream was restarted between the two writes ends as the
same table, and one that is in the ledger already is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

LEDGER = "batch long, n long"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n): the batches of the ledger, with their rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger/*")


def put(batch: DataFrame, number: int, path: str, keys: list[str]) -> None:
    """Writes a batch, which has one row for a key (no keys: any rows), and enters it in the ledger; does nothing if it is there."""
    spark = batch.sparkSession
    if committed(spark, path).filter(F.col("batch") == number).isEmpty():
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}")
        if keys and written.count() != written.select(*keys).distinct().count():
            raise ValueError(f"batch {number} has several rows for a key")
        enter(spark, number, written.count(), path)


def enter(spark: SparkSession, number: int, n: int, path: str) -> None:
    spark.createDataFrame([(number, n)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{number}")


def upsert(stream: DataFrame, path: str, keys: list[str], progress: str, mode: str = "update") -> StreamingQuery:
    """Starts a stream whose batches go to the table at path, to the end of what its source has now; progress: the folder of its own checkpoint."""
    write = lambda batch, number: put(batch, number, path, keys)
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", progress).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, schema: StructType, keys: list[str], whole: bool = False) -> DataFrame:
    """The table: each key's row of the last batch that has it. whole: every batch was a whole result (complete mode), so the last one's rows."""
    done = committed(spark, path)
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{path}/rows") if not done.isEmpty() else spark.createDataFrame([], StructType([*schema.fields]).add("batch", "long"))
    if whole:
        last = done.agg(F.max("batch")).first()[0]
        return rows.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")
    sure = rows.join(F.broadcast(done.select("batch")), "batch", "left_semi")  # a number for each batch
    names = [f.name for f in schema.fields]
    kept = sure.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("row"))
    return kept.select(*[F.col(f"row.{n}").alias(n) for n in names])
