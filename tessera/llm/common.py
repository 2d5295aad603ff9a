"""What the operators share: the shared folder, cutting lineage, size-checked broadcasts and batching."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be broadcast; beyond it the join is left to shuffle.
BROADCAST_ROWS = 1_000_000

#: Characters that a Python worker handles at once, so that its memory doesn't depend on the texts.
BATCH_CHARS = 1_000_000

#: Upper and lower case of the contract's folding: A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What separates the words of the contracts on whole words, after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_own: dict[str, str] = {}
_shipped: set[str] = set()

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local run gets a temporary folder of its own; on a
    cluster that is an error. The folder goes when the driver's Python ends, or
    with forget().
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
        _own[app] = f"{at.rstrip('/')}/tessera/{app}"
        atexit.register(forget, spark)
    return _own[app]


def forget(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables; results that haven't been written yet can't be read afterwards."""
    try:
        at = _own.get(spark.sparkContext.applicationId)
        if at:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended before: its folder stays for whoever owns the shared one
        return


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need not have it on their path."""
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped or not package.is_dir():
        return
    _shipped.add(app)
    folder = Path(os.path.realpath(tempfile.mkdtemp(prefix="tessera-")))  # the driver serves it to executors as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    kept = sys.path[:]
    spark.sparkContext.addPyFile(str(archive))
    sys.path[:] = kept


def save(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; a distributed count, which for a saved table reads no column."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size has been checked, else as it is (a shuffle join)."""
    return F.broadcast(df) if small(df, rows) else df


def native_words(text) -> F.Column:
    """Array of the words of a text column, A-Z lower-cased; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.array_remove(parts, "")


def chunks(texts: Iterable[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about so many characters (one long text can be more), with the place of the first; null counts as empty."""
    run: list[str] = []
    start = size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield start, run
            start, run, size = start + len(run), [], 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run
    release()


def release() -> None:
    """Hands freed memory back to the system, Arrow's too: idle workers stay beside the executor's heap and would keep it."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df's columns don't have, so that no column of the caller is hidden."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
