"""A connector for folders of Arrow files on a file system that driver and executors share: format("segments").

    register(spark)
    df.write.format("segments").mode("append").option("path", path).option("key", "id").save()
    spark.read.format("segments").option("path", path).load().filter("id < 100")
    spark.readStream.format("segments").option("path", path).load()

A write has a folder, in which each task writes one file, and notes the smallest
and largest `key` in it. A file is part of the table once a commit lists it: commits are
numbered, and appear whole, as a new link to a finished file. A write that fails
takes its folder away and has no commit. A file is a partition of a read, and those
whose keys can't meet the filters aren't opened. A stream's offsets are commits.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Filters that a file's keys decide: whether it may have such rows, and which they are.
TESTS = {
    EqualTo: (lambda low, high, v: low <= v <= high, pc.equal),
    LessThan: (lambda low, high, v: low < v, pc.less),
    LessThanOrEqual: (lambda low, high, v: low <= v, pc.less_equal),
    GreaterThan: (lambda low, high, v: high > v, pc.greater),
    GreaterThanOrEqual: (lambda low, high, v: high >= v, pc.greater_equal),
    In: (lambda low, high, v: any(low <= x <= high for x in v), lambda column, v: pc.is_in(column, pa.array(list(v), column.type))),
}


@dataclass
class Segment(InputPartition):
    file: str
    rows: int
    low: object
    high: object


@dataclass
class Written(WriterCommitMessage):
    segments: list[Segment]


class Folder:
    """Commits of a table."""

    def __init__(self, options: dict):
        path = options.get("path", "")
        if "://" in path and not path.startswith("file://"):
            raise ValueError("segments are on a file system that driver and executors share")
        self.path, self.log = path.removeprefix("file://").rstrip("/"), f"{path.removeprefix('file://').rstrip('/')}/_log"

    def numbers(self) -> list[int]:
        return sorted(int(f.removesuffix(".json")) for f in os.listdir(self.log) if f.endswith(".json")) if os.path.isdir(self.log) else []

    def commit(self, number: int) -> dict:
        with open(f"{self.log}/{number:020d}.json", encoding="utf-8") as f:
            return json.load(f)

    def segments(self, after: int, upto: int) -> list[Segment]:
        return [Segment(**s) for n in self.numbers() if after < n <= upto for s in self.commit(n)["segments"]]

    def add(self, segments: list[Segment], key: str | None, schema: StructType) -> int:
        """A new commit; of two writers that want one number the second takes the next."""
        os.makedirs(self.log, exist_ok=True)
        made = f"{self.log}/{uuid.uuid4().hex}.tmp"
        with open(made, "w", encoding="utf-8") as f:
            json.dump({"segments": [vars(s) for s in segments], "key": key, "schema": schema.jsonValue()}, f)
        number = max(self.numbers(), default=0) + 1
        while True:
            try:
                os.link(made, f"{self.log}/{number:020d}.json")
                os.unlink(made)
                return number
            except FileExistsError:
                number += 1


def batches(folder: Folder, segment: Segment, schema: StructType, tests: list[tuple[str, Filter]]) -> Iterator[pa.RecordBatch]:
    shape = to_arrow_schema(schema)
    with pa.OSFile(f"{folder.path}/{segment.file}") as f, pa.ipc.open_file(f) as reader:
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            for column, test in tests:
                batch = batch.filter(TESTS[type(test)][1](batch.column(column), test.value))
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(shape.names, shape.types, strict=True)], schema=shape)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.schema, self.tests = Folder(options), schema, []
        numbers = self.folder.numbers()
        self.upto = numbers[-1] if numbers else 0
        self.key = self.folder.commit(self.upto)["key"] if numbers else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == (self.key,):
                self.tests.append((self.key, f))
            else:
                yield f

    def may_have(self, s: Segment) -> bool:
        return not self.tests or (s.low is not None and all(TESTS[type(f)][0](s.low, s.high, f.value) for _, f in self.tests))

    def partitions(self) -> list[Segment]:
        return [s for s in self.folder.segments(0, self.upto) if self.may_have(s)] or [Segment("", 0, None, None)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition, self.schema, self.tests) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.schema = Folder(options), schema

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(self.folder.numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.folder.segments(start["commit"], end["commit"])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return batches(self.folder, partition, self.schema, [])


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.key, self.schema, self.run = Folder(options), options.get("key"), schema, uuid.uuid4().hex
        if self.key is not None and schema[self.key].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "string"):
            raise ValueError("keys are numbers or strings")
        os.makedirs(f"{self.folder.path}/{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, rows, ends = f"{self.run}/{uuid.uuid4().hex}.arrow", 0, []
        writer = None
        with pa.OSFile(f"{self.folder.path}/{file}", "wb") as f:
            for batch in iterator:
                writer = writer or pa.ipc.new_file(f, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writer.write_batch(batch)
                rows += batch.num_rows
                if self.key is not None:
                    ends += [x for x in pc.min_max(batch.column(self.key)).as_py().values() if x is not None]
            if writer:
                writer.close()
        if not rows:
            os.unlink(f"{self.folder.path}/{file}")
            return Written([])
        return Written([Segment(file, rows, min(ends, default=None), max(ends, default=None))])

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.add([s for m in messages if m for s in m.segments], self.key, self.schema)

    def abort(self, messages: list[Written | None]) -> None:
        """Takes the write's folder away, so that tasks that still run can't make files in it either."""
        gone = f"{self.folder.path}/.{self.run}"
        os.rename(f"{self.folder.path}/{self.run}", gone)
        shutil.rmtree(gone)


class Segments(DataSource):
    """See the module. Options: path; key, the column whose ends are kept (a number without not-a-numbers, or a string)."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> StructType:
        folder = Folder(self.options)
        numbers = folder.numbers()
        if not numbers:
            raise ValueError(f"no table at {folder.path}")
        return StructType.fromJson(folder.commit(numbers[-1])["schema"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("segments are appended")
        return Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to connectors in Python."""
    spark.dataSource.register(Segments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
