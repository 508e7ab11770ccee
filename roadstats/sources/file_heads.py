"""First records of files, read in tasks.

Headers decide how a file's columns are named, and no header says what the next file's
is, so each file's first line must be seen before the files can be scanned.  The driver
opens no file: a text scan hands each file's blocks to tasks of their own, which stop
after the first batch of lines.  Only one short row per file reaches the driver, which needs
the list of files in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.session import ship_package


def plain_path(path: str) -> str:
    """One spelling of a file's path, for listings and ``_metadata`` alike."""
    return re.sub(r"^([a-z0-9+.-]+):/+(?=[^/])", r"\1:/", unquote(path)) if path.startswith("file:") else unquote(path)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            if batch.column(1)[0].as_py() == 0:
                yield batch.slice(0, 1)
            return  # one block a partition: what follows is no first record


def first_records(spark: SparkSession, paths: Sequence[str], line_sep: str | None = None) -> dict[str, str]:
    """{path (see ``plain_path``): first record} of the files of ``paths`` that have one."""
    if not paths:
        return {}
    ship_package(spark)
    own = spark.newSession()  # blocks are packed singly for this scan alone
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    reader = own.read if line_sep is None else own.read.option("lineSep", line_sep)
    lines = reader.text(list(paths)).select(F.col("_metadata.file_path").alias("path"),
                                            F.col("_metadata.file_block_start").alias("block"), "value")
    heads = lines.mapInArrow(_first, "path string, block bigint, value string")
    return {plain_path(r["path"]): r["value"].lstrip("﻿") for r in heads.select("path", "value").collect()}  # a row a file


def group_by_head(paths: Sequence[str], heads: dict[str, str]) -> dict[str, list[str]]:
    """{first record: its files}, files without any record left out."""
    out: dict[str, list[str]] = {}
    for p in paths:
        head = heads.get(plain_path(p))
        if head is not None:
            out.setdefault(head, []).append(p)
    return out


def array_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the files under ``path``, each one JSON array of arrays whose first is the header.

    A file is read by as many tasks as it has blocks: records end at a quote and a bracket, so a record is a row (or
    several, where rows end in something other than a string), and the file's header is joined to them.  Returns
    source_file, ``columns`` and load_order; a record that isn't JSON is one row of nulls.
    """
    sep = '"]'
    text = (spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value",
                    F.monotonically_increasing_id().alias("record")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    heads = first_records(spark, [r["path"] for r in files.collect()], sep)  # a row a file
    named = [(p, [str(c) for c in _row(h)]) for p, h in heads.items()]
    header = spark.createDataFrame(named, "plain string, header array<string>")
    body = F.regexp_replace("value", r"^[\s,\[]*", "[")
    whole = F.from_json(F.concat(F.lit("["), body, F.lit('"]]')), "array<array<string>>")
    last = F.from_json(F.concat(F.lit("["), F.regexp_replace(body, r"\]\s*$", ""), F.lit("]")), "array<array<string>>")
    rows = F.coalesce(whole, last, F.array(F.lit(None).cast("array<string>")))
    text = text.where(~F.col("value").rlike(r"^[\s,\[\]]*$")).select(
        "source_file", "block", "record", F.col("value").rlike(r"^\s*\[\s*\[").alias("_opens"), F.posexplode(rows).alias("_pos", "row"))
    text = text.where(~(F.col("_opens") & (F.col("block") == 0) & (F.col("_pos") == 0)))
    joined = text.withColumn("plain", _plain("source_file")).join(header, "plain", "left")

    def field(name: str) -> F.Column:
        at = F.array_position("header", F.lit(name)).cast("int")
        return F.when((at > 0) & (at <= F.size("row")), F.element_at("row", at))

    return joined.select("source_file", *[field(c).alias(c) for c in columns],
                         F.struct(F.col("source_file").alias("file"), "block", "record", F.col("_pos").alias("pos")).alias("load_order"))


def _plain(column: str) -> F.Column:
    path = F.url_decode(F.regexp_replace(column, r"\+", "%2B"))
    return F.when(path.startswith("file:"), F.regexp_replace(path, "^file:/+", "file:/")).otherwise(path)


def _row(record: str) -> list:
    """The header row of a file's first record."""
    import json
    return json.loads(re.sub(r"^[\s\[]*", "[", record) + '"]')
