"""Tables that grow by committed batches.

A batch's rows are a folder of their own, ``<table>/batch=<id>``; writing it, wholly or in part,
changes nothing that ``CommitLog.read`` shows.  It counts from the moment its commit file
``<table>_log/_commits/<id>.json`` is there, which appears in one step and never changes.  So a
run that ends at any point leaves either the whole batch or nothing, and repeating it writes the
same folders again:

* rows, rejected rows and the list of files of a batch stand under one commit;
* the batch id is a hash of what it reads, so a repeated run has the same id;
* folders without a commit are never read (``sweep`` removes them).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class CommitLog:
    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.table = spark, table.rstrip("/")

    def root(self, part: str) -> str:
        return self.table if part == "rows" else f"{self.table}_log/{part}"

    def folder(self, batch: str, part: str) -> str:
        return f"{self.root(part)}/batch={batch}"

    def committed(self) -> dict[str, dict]:
        """{batch id: what its commit says}, one small file a batch."""
        fs, p = _path(self.spark, f"{self.table}_log/_commits")
        if not fs.exists(p):
            return {}
        rows = self.spark.read.schema("batch string, numbers string").json(f"{self.table}_log/_commits/*.json").collect()
        return {r["batch"]: json.loads(r["numbers"]) for r in rows}

    def commit(self, batch: str, numbers: dict) -> bool:
        """Make ``batch`` part of the table; False if it was already."""
        jvm = self.spark.sparkContext._jvm
        fs, final = _path(self.spark, f"{self.table}_log/_commits/{batch}.json")
        if fs.exists(final):
            return False
        _, draft = _path(self.spark, f"{self.table}_log/_commits/.{batch}-{jvm.java.util.UUID.randomUUID()}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "numbers": json.dumps(numbers)}).encode()))
        out.close()
        if fs.rename(draft, final):  # one step; fails if another run was first
            return True
        fs.delete(draft, False)
        if not fs.exists(final):
            raise OSError(f"could not commit batch {batch} of {self.table}")
        return False

    def move(self, batch: str, source: str, part: str) -> None:
        """Files written elsewhere become the batch's ``part`` (one rename; what an earlier run left there goes)."""
        fs, to = _path(self.spark, self.folder(batch, part))
        _, came = _path(self.spark, source)
        fs.delete(to, True)
        fs.mkdirs(to.getParent())
        if fs.exists(came) and not fs.rename(came, to):
            raise OSError(f"could not move {source} to {to}")

    def read(self, part: str, schema: str) -> DataFrame:
        """``part`` of all committed batches; other folders are pruned as partitions."""
        fs, p = _path(self.spark, self.root(part))
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(f"{schema}, batch string").parquet(self.root(part))
        return table.where(F.col("batch").isin(sorted(self.committed()))).drop("batch")

    def sweep(self) -> int:
        """Remove the folders of batches that were never committed; how many there were."""
        known, gone = self.committed(), 0
        for part in ("rows", "rejected", "files", "staged"):
            fs, p = _path(self.spark, self.root(part))
            for st in (fs.listStatus(p) if fs.exists(p) else []):
                name = st.getPath().getName()
                if name.startswith("batch=") and name.split("=", 1)[1] not in known:
                    gone += bool(fs.delete(st.getPath(), True))
        return gone


def content_id(files: DataFrame) -> str:
    """A batch id from the files it reads (path, length): the same for the same files."""
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{int(r['h'] or 0) % 2 ** 64:016x}"
