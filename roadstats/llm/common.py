"""Helpers shared by the corpus operators: inputs, scratch tables, identity of
rows, and connected components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.session import checkpoint_dir, shared_dir, ship_package

#: The six ASCII white-space characters that end a word.
WHITE_SPACE = " \t\n\x0b\f\r"
#: The same as a Java / DuckDB pattern.
WHITE_PATTERN = "[\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts lineage and keeps a size that the planner knows, so that Spark alone
    decides whether the table is small enough to broadcast.  The folder belongs
    to the running application (``drop_scratch`` removes it).
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; frames built on them end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return what a worker has freed to the system.

    A worker serves many tasks; without this, pyarrow's pool and the C heap keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which nulls of a key are equal; ``right``'s keys are dropped."""
    theirs = dict(zip(keys, free_names(left, *[f"__right_{k}" for k in keys])))
    renamed = right.withColumnsRenamed(theirs)
    on = [left[k].eqNullSafe(renamed[theirs[k]]) for k in keys]
    return left.join(renamed, on, how).drop(*theirs.values())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component: the smallest node.

    Alternating large-star and small-star steps: every node's neighbours are
    hooked to the smallest node they know, until nothing changes, which takes
    about the logarithm of the longest path.  Each round ends in a reliable
    checkpoint.  A node with very many neighbours is met only in aggregates with
    a map-side part and in a join that Spark may split, never as one group.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    known = None
    for _ in range(max_rounds):
        # large star: neighbours greater than the node move to the smallest one known
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours not greater than the node, and the node, move likewise
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        edges = checkpointed(
            small.select(F.col("x").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                                                   F.lit(0).cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


def sent(df: DataFrame, row_bytes: int, limit: int = 32_000_000) -> DataFrame:
    """``df`` (a saved table) marked for broadcast if its rows fit in ``limit`` bytes; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
