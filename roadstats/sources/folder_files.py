"""Trees of very many small files in a local folder, listed and read by tasks.

Spark's file sources list every file on the driver, which keeps 1 to 2 KB of each, and open each one through Hadoop, about
a ms a file.  Here a task lists a folder, others list what that holds, and those that read walk the rest, so that the
driver knows the root alone.  Names that begin with ``.`` or ``_`` are left out, as by Spark (``_x=`` is a folder's column).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.session import ship_package

#: Bytes of whole lines in a row, and rows and bytes in what a task hands over at once.
PIECE_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 20, 10_000, 4 << 20
#: What Hadoop writes as %XX in the URI of a path.
_URI_UNSAFE = re.compile(r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]")

Batches = Iterator[pa.RecordBatch]


def local_root(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it; None if it is not a local folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(file, length) of every file under the local folder ``root``; no file is opened."""
    return _found(spark, root).mapInArrow(_sizes, "file string, length long")


def file_texts(spark: SparkSession, root: str) -> DataFrame:
    """(file, start, text) of the files under the local folder ``root``: whole lines without the last one's end, in rows
    of a MB or a single line; ``start`` is how many lines of the file come before."""
    texts = _found(spark, root).mapInArrow(_texts, "file string, start long, text binary")
    return texts.withColumn("text", texts["text"].cast("string"))


def _found(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder): what lies two levels under ``root``, and files above that, dealt to the tasks that go on with it."""
    ship_package(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"), F.lit(True).alias("folder"))
    for _ in range(2):
        found = found.mapInArrow(_children, _FOUND).repartition(tasks, "path")
    return found


_FOUND = "path string, folder boolean"


def _entries(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as entries:
        for e in entries:
            if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name):
                yield e


def _children(batches: Batches) -> Batches:
    """What each folder of the rows holds; files stay."""
    def rows() -> Iterator[tuple]:
        for path, folder in _rows(batches):
            if folder:
                yield from ((e.path, e.is_dir()) for e in _entries(path))
            else:
                yield path, False
    return _batches(rows(), pa.schema([("path", pa.string()), ("folder", pa.bool_())]), lambda row: len(row[0]))


def _sizes(batches: Batches) -> Batches:
    rows = ((_uri(f), os.stat(f).st_size) for f in _files(batches))
    return _batches(rows, pa.schema([("file", pa.string()), ("length", pa.int64())]), lambda row: len(row[0]))


def _texts(batches: Batches) -> Batches:
    def rows() -> Iterator[tuple]:
        for path in _files(batches):
            uri, start = _uri(path), 0
            with open(path, "rb") as f:
                while lines := f.readlines(PIECE_BYTES):
                    yield uri, start, b"".join(lines).removesuffix(b"\n")
                    start += len(lines)
    return _batches(rows(), pa.schema([("file", pa.string()), ("start", pa.int64()), ("text", pa.binary())]),
                    lambda row: len(row[0]) + len(row[2]))


def _rows(batches: Batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _files(batches: Batches) -> Iterator[str]:
    def walk(folder: str) -> Iterator[str]:
        for e in _entries(folder):
            if e.is_dir():
                yield from walk(e.path)
            else:
                yield e.path
    for path, folder in _rows(batches):
        if folder:
            yield from walk(path)
        else:
            yield path


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Batches:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if len(held) >= BATCH_ROWS or held_bytes >= BATCH_BYTES:
            yield pa.record_batch([*map(list, zip(*held))], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.record_batch([*map(list, zip(*held))], schema=schema)


def _uri(path: str) -> str:
    return "file:" + _URI_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", path)
