"""The connector: round trips, files left out by filters, failed writes, streams of commits."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.segments import Folder, register


@pytest.fixture(scope="module")
def source(spark):
    register(spark)
    return spark


def save(df, path, key="id"):
    df.write.format("segments").mode("append").option("path", path).option("key", key).save()


def load(spark, path):
    return spark.read.format("segments").option("path", path).load()


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_round_trip_and_filters(source, tmp_path):
    path = f"file://{tmp_path}/t"
    df = source.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"), F.timestamp_seconds("id").alias("at"), F.array("id").alias("a"))
    save(df.repartitionByRange(8, "id"), path)
    assert sorted(map(repr, load(source, path).collect())) == sorted(map(repr, df.collect())) and load(source, path).schema == df.schema
    few = load(source, path).filter("id >= 100 and id < 130 and s is not null")
    assert sorted(r.id for r in few.collect()) == [i for i in range(100, 130) if i % 7]
    assert few.rdd.getNumPartitions() <= 2
    ran = plan(few)
    assert "Filter isnotnull" in ran and "130" not in ran  # the connector has taken the others
    assert load(source, path).filter(F.col("id").isin(5, 999, 5000)).count() == 2
    assert load(source, path).filter("id > 5000").collect() == [] and load(source, path).filter("id = 7").count() == 1
    save(df.limit(0), path)
    save(df.filter("id < 3"), path)
    assert load(source, path).count() == 1003


def test_a_failed_task_leaves_nothing(source, tmp_path):
    path = f"{tmp_path}/t"
    save(source.range(10), path)
    before = sorted(os.listdir(path))

    @F.udf("long")
    def broken(x):
        if x == 77:
            raise ValueError("broken row")
        return x

    with pytest.raises(Exception, match="broken row"):
        save(source.range(100).repartition(4).select(broken("id").alias("id")), path)
    assert sorted(os.listdir(path)) == before and load(source, path).count() == 10
    with pytest.raises(Exception, match="numbers or strings"):
        save(source.range(3).select(F.array("id").alias("id")), path)


def test_stream_of_commits(source, tmp_path):
    path, out, progress = f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/progress"
    save(source.range(10), path)

    def run():
        stream = source.readStream.format("segments").option("path", path).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r.id for r in source.read.parquet(out).collect())

    assert run() == list(range(10))
    save(source.range(10, 25), path)
    assert run() == list(range(25)) and run() == list(range(25))


def test_two_writers_take_two_numbers(source, tmp_path):
    folder = Folder({"path": f"{tmp_path}/t"})
    schema = source.range(1).schema
    first = Folder.numbers
    folder.numbers = lambda: []  # as a writer sees it that looked before the other's commit
    assert [folder.add([], "id", schema) for _ in range(3)] == [1, 2, 3] and first(folder) == [1, 2, 3]
