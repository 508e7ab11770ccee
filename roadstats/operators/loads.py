"""Keyed loads: first-row-wins de-duplication, anti-join against the target,
row outcome accounting and write-back (L1–L7, J1).

The source database did ``INSERT … ON CONFLICT DO NOTHING`` row by row.  Here
a whole batch is resolved set-wise: rows whose key already exists in the
target are *skipped*, duplicates inside the batch keep the first row by an
explicit load order, and rows failing a mandatory cast are *errors*.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per ``key``: the one with the smallest ``order`` tuple.

    Expressed as ``min(struct(order…, payload…))`` per key, i.e. an ordinary
    aggregate with a map-side partial step: a key holding a third of all rows
    is reduced to one row per map task before the shuffle, so no task ever
    sees the whole hot group (a ``row_number`` window would sort it in one
    task).  Payload columns follow the order columns inside the struct, which
    makes the pick deterministic even when order tuples tie.
    """
    key = list(key)
    order = list(order)
    payload = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in payload])
    picked = df.groupBy(*key).agg(F.min(packed).alias("_first"))
    return picked.select(*key,
                         *[F.col(f"_first._o{i}").alias(c) for i, c in enumerate(order)],
                         *[F.col(f"_first.{c}").alias(c) for c in payload]
                         ).select(*df.columns)


def load_outcomes(batch: DataFrame, target: DataFrame | None, key: Sequence[str],
                  order: Sequence[str], valid: F.Column | None = None,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Per-row outcome of loading ``batch`` into ``target``.

    Every row gets ``outcome`` in {inserted, skipped_existing,
    skipped_duplicate, error}; ``group_cols`` (e.g. year, file) are kept so
    the caller can pivot counts per file/dataset.
    """
    key = list(key)
    order = list(order)
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    b = batch.withColumn("_valid", ok)
    if target is not None:
        existing = target.select(*key).distinct().withColumn("_exists", F.lit(True))
        b = b.join(existing, key, "left")
    else:
        b = b.withColumn("_exists", F.lit(None).cast("boolean"))
    # winner per key among valid, non-existing rows: min order tuple; the
    # group minimum is an aggregate (partial, skew-safe), joined back on key.
    cand = b.filter(F.col("_valid") & F.col("_exists").isNull())
    winners = cand.groupBy(*key).agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_win"))
    b = b.join(winners, key, "left")
    is_winner = F.col("_win").eqNullSafe(F.struct(*[F.col(c) for c in order]))
    outcome = (F.when(~F.col("_valid"), F.lit("error"))
               .when(F.col("_exists").isNotNull(), F.lit("skipped_existing"))
               .when(is_winner, F.lit("inserted"))
               .otherwise(F.lit("skipped_duplicate")))
    return b.withColumn("outcome", outcome).drop("_valid", "_exists", "_win")


def keyed_ledger(batch: DataFrame, target: DataFrame | None, key: Sequence[str],
                 order: Sequence[str], valid: F.Column, orphan: F.Column | None = None) -> DataFrame:
    """``INSERT … ON CONFLICT (key) DO NOTHING`` of a whole batch in one aggregate.

    Batch rows and the target's keys go into one aggregate per key together: the first batch row
    by ``order`` (with its payload), how many rows there were, and whether the target has the key.
    The batch is evaluated and shuffled once, and a hot key shrinks on the map side.  Rows that
    are not ``valid``, or are an ``orphan``, are groups of their own.

    Returns the batch's columns, ``outcome`` and ``n_rows``: one row per inserted key and per
    rejected row, and one per key for the rows skipped (their columns are those of the first).
    """
    key, order = list(key), list(order)
    payload = [c for c in batch.columns if c not in key]
    first = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in payload])
    kind = F.when(F.coalesce(orphan, F.lit(False)), F.lit("skipped_orphan")) if orphan is not None else F.lit(None).cast("string")
    kind = F.coalesce(kind, F.when(~F.coalesce(valid, F.lit(False)), F.lit("error")))
    rows = batch.select(*key, kind.alias("_kind"), first.alias("_row"), F.lit(False).alias("_there"))
    rows = rows.withColumn("_own", F.when(F.col("_kind").isNotNull(), F.struct(*[F.col(f"_row._o{i}") for i in range(len(order))])))
    types = {f.name: f.dataType for f in rows.schema.fields}
    if target is not None:
        there = target.select(*[F.col(c).cast(types[c]).alias(c) for c in key],
                              *[F.lit(None).cast(types[c]).alias(c) for c in ("_kind", "_row")], F.lit(True).alias("_there"),
                              F.lit(None).cast(types["_own"]).alias("_own"))
        rows = rows.unionByName(there)
    one = rows.groupBy(*key, "_kind", "_own").agg(F.min("_row").alias("_row"), F.count("_row").alias("_n"), F.max("_there").alias("_there"))
    pair = lambda what, n: F.struct(what.alias("outcome"), n.cast("long").alias("n_rows"))
    ways = F.when(F.col("_kind").isNotNull(), F.array(pair(F.col("_kind"), F.col("_n")))) \
        .when(F.col("_there"), F.array(pair(F.lit("skipped_existing"), F.col("_n")))) \
        .otherwise(F.array(pair(F.lit("inserted"), F.lit(1)), pair(F.lit("skipped_duplicate"), F.col("_n") - 1)))
    told = one.where("_n > 0").select(*key, "_row", F.explode(F.filter(ways, lambda w: w["n_rows"] > 0)).alias("_w"))
    return told.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in batch.columns], "_w.outcome", "_w.n_rows")


def write_back(target: DataFrame, updates: DataFrame, key: Sequence[str],
               columns: Sequence[str]) -> DataFrame:
    """``UPDATE target SET cols = u.cols FROM updates u WHERE key matches``.

    Matched rows take the new values, unmatched rows keep theirs.  Produces
    a new immutable version of ``target``; ``updates`` must be unique on key.
    """
    key = list(key)
    u = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns]) \
        .withColumn("_matched", F.lit(True))
    joined = target.join(u, key, "left")
    out = joined
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_matched"), F.col(f"_new_{c}"))
                             .otherwise(F.col(c)))
    return out.select(*target.columns)


def orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str],
            parent_key: Sequence[str] | None = None) -> DataFrame:
    """Child rows whose parent key is missing (J1 orphan side, ``left_anti``)."""
    parent_key = list(parent_key or child_key)
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_key, child_key)])
    return child.join(p, list(child_key), "left_anti")


def partition_prints(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """(column, print): a fingerprint per value of the partition column, of the rows of all ``tables`` (any order)."""
    out = None
    for i, t in enumerate(tables):
        h = t.select(F.col(column), F.xxhash64(F.lit(i), *[F.col(c) for c in sorted(t.columns)]).cast("decimal(38,0)").alias("h"))
        out = h if out is None else out.unionByName(h)
    return out.groupBy(column).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("h")).alias("print"))


def changed_partitions(now: DataFrame, before: DataFrame | None, column: str) -> list:
    """Values of ``column`` whose fingerprint is new or other than ``before`` (one row per partition value)."""
    if before is not None:
        now = now.join(before, [column, "print"], "left_anti")
    return sorted(r[column] for r in now.select(column).collect())
