"""Idempotent incremental crash loading (L6), exactly once per file.

The source skipped years whose files were already downloaded and relied on
``ON CONFLICT DO NOTHING`` so that a re-run changed nothing.  Two Spark
forms of the same contract, both over a table of committed batches
(``commits.CommitLog``):

* ``load_new_files`` (batch) — the distributed file listing is anti-joined
  with the files of the committed batches; only new files are read, their
  rows are resolved against the keys of the incoming years (L1), and the
  new rows, the rejected rows and the file list are written into the
  batch's folder; the commit makes all three count at once.
* ``stream_new_files`` (Structured Streaming) — the file source of a
  ``readStream`` (format ``binaryFile``, content never selected) tracks the
  processed files in its checkpoint; ``trigger(availableNow=True)`` turns
  it into a bounded run and ``foreachBatch`` loads each micro-batch the same
  way.  A micro-batch that Spark runs again after a failure finds its files
  committed, or its half-written folder, which it writes again.

Rows are parquet, partitioned by ``year``; ``read_table`` and
``read_quarantine`` read what is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.operators import raw_load as rl
from roadstats.sources import raw_files as rf
from roadstats.streaming.commits import CommitLog, content_id

# the fixed schema of Spark's binaryFile source (content is never selected)
BINARY_FILE_SCHEMA = ("path string, modificationTime timestamp, length long, "
                      "content binary")
ROWS = ("st_case int, year int, crash_date date, state string, state_name string, county string, county_name string, city string, "
        "fars_city_name string, route_code int, road_label string, total_fatalities int, lon double, lat double, coord_status string")
REJECTED = f"{ROWS}, reject_reason string, source_file string"
FILES = "path string, length long, year int, dataset string"


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return CommitLog(spark, table).read("rows", ROWS)


def read_quarantine(spark: SparkSession, table: str) -> DataFrame:
    return CommitLog(spark, table).read("rejected", REJECTED)


def read_files(spark: SparkSession, table: str) -> DataFrame:
    """The manifest: every file that a committed batch has read."""
    return CommitLog(spark, table).read("files", FILES)


def load_files(spark: SparkSession, files: DataFrame, table: str, codes: DataFrame) -> dict:
    """Load the crash files of ``files`` (path, length, year, dataset) that no committed batch has read, as one batch."""
    log = CommitLog(spark, table)
    new = files.where("dataset = 'crash'").join(read_files(spark, table).select("path"), "path", "left_anti")
    listed = sorted(tuple(r) for r in new.select("path", "length", "year", "dataset").collect())  # a row per new file, to be scanned
    if not listed:
        return {"new_files": 0, "rows_added": 0}
    new = spark.createDataFrame(listed, FILES)
    batch = content_id(new)
    numbers = {"new_files": len(listed), "rows_added": 0, "rejected": 0}
    raw = rf.scan_crash_paths(spark, [f[0] for f in listed])
    if raw is not None:
        # keys of the incoming years alone: other partitions aren't read
        target = read_table(spark, table).where(F.col("year").isin(sorted({f[2] for f in listed if f[2] is not None})))
        ledger = rl.crash_ledger(rl.normalize_crashes(spark, raw, codes), target)
        # written once, split by outcome; the two parts then move to their places
        staged = log.folder(batch, "staged")
        (ledger.where("outcome in ('inserted', 'error')").select(*rl.CRASH_COLUMNS, "reject_reason", "source_file", "outcome")
         .write.mode("overwrite").partitionBy("outcome", "year").parquet(staged))
        done = spark.read.schema(f"{REJECTED}, outcome string").parquet(staged)
        for r in done.groupBy("outcome").count().collect():  # two numbers
            numbers["rows_added" if r["outcome"] == "inserted" else "rejected"] = r["count"]
        log.move(batch, f"{staged}/outcome=inserted", "rows")
        log.move(batch, f"{staged}/outcome=error", "rejected")
    new.write.mode("overwrite").parquet(log.folder(batch, "files"))
    log.commit(batch, numbers)
    return {k: numbers[k] for k in ("new_files", "rows_added")}


def load_new_files(spark: SparkSession, raw_root: str, table: str, codes: DataFrame) -> dict:
    """Batch form: load the crash files under ``raw_root`` that aren't loaded yet; repeating it changes nothing."""
    return load_files(spark, rf.dataset_files(spark, raw_root), table, codes)


def stream_new_files(spark: SparkSession, raw_root: str, table: str, codes: DataFrame,
                     checkpoint: str, max_files_per_trigger: int = 16) -> dict:
    """Streaming form: file-source stream + availableNow + foreachBatch."""
    stats = {"new_files": 0, "rows_added": 0}
    listing = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
               .option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.[cC][sS][vV]")
               .option("maxFilesPerTrigger", max_files_per_trigger)
               .load(raw_root).select("path", "length"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        got = load_files(spark, rf.with_dataset(batch), table, codes)
        for k in stats:
            stats[k] += got[k]

    q = (listing.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stats
