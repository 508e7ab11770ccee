"""Scans of the driver parquet tables.

Readers return the full table lazily; callers select the columns they need
so Catalyst prunes the parquet ``ReadSchema`` and pushes filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadstats.session import session_with, shuffle_partitions

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str, split: str | None = None) -> DataFrame:
    """A driver table; ``split`` is the most that one task reads of it (Spark's own setting if none is given), and shuffles
    of what is so read have partitions by the table's size."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown driver table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if split is not None:
        spark = session_with(spark, {"spark.sql.files.maxPartitionBytes": split,
                                     "spark.sql.shuffle.partitions": shuffle_partitions(spark, path)})
    return spark.read.parquet(path)
