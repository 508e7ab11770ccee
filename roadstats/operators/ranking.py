"""Tie-aware global ranks and percentiles without a single-partition window
(W1–W4, W6, A15).

``Window.orderBy(...)`` with no partition key moves every row into one task.
``global_rank`` instead:

1. collapses rows to distinct sort keys with a weight (an aggregate with a
   map-side partial step, so a key shared by a third of all rows becomes one
   row per map task);
2. range-partitions the distinct keys (range exchange), tags each row with
   its range index and checkpoints them to the cluster's checkpoint folder,
   which freezes the range boundaries;
3. sums the weights per (range, group) — one small row per range — and
   turns them into offsets with a window over that small table (bounded by
   the partition count, so it is broadcast);
4. computes ``rank = offset + weight of smaller keys in the range + 1`` with
   a running-sum window per (range, group) and joins the ranks back on the
   sort key.  Everything stays on the JVM; nothing is collected.

It is meant for a small number of groups (here 24 = 3 scopes × 8 metrics);
many-group windows (per-city hot cells) are ordinary partitioned windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadstats.functions.exprs import ratio_half_up
from roadstats.operators.city_stats import CITY_KEY, eligible
from roadstats.session import reliable_checkpoint

# metric column -> base used in rank / percentile column names
RANK_BASES = {
    "avg_per_100k_5yr": "per_100k",
    "avg_per_100k_pedestrian": "per_100k_pedestrian",
    "avg_per_100k_cyclist": "per_100k_cyclist",
    "avg_per_100k_motorist": "per_100k_motorist",
    "trend_pct_change": "trend",
    "trend_pct_change_pedestrian": "trend_pedestrian",
    "trend_pct_change_cyclist": "trend_cyclist",
    "trend_pct_change_motorist": "trend_motorist",
}
RANK_COLS = tuple(f"rank_{b}_all" for b in RANK_BASES.values())
PCT_COLS = tuple(f"pct_{b}_all" for b in RANK_BASES.values())
RANK_VZ_COLS = tuple(f"rank_{b}_vz" for b in RANK_BASES.values())
PCT_VZ_COLS = tuple(f"pct_{b}_vz" for b in RANK_BASES.values())
ALL_RANK_OUTPUTS = RANK_COLS + PCT_COLS + RANK_VZ_COLS + PCT_VZ_COLS


def sort_key(col: str, ascending: bool = True, nulls_last: bool = True,
             prefix: str | None = None, text: bool = False) -> list:
    """Null-free, ascending-comparable key columns for one ORDER BY term.

    (null flag, value) — the flag puts nulls last (or first); descending
    numeric terms are negated.  ``text``: the column is a string; descending,
    its key is the negated code points, closed by a value above them all so
    that a longer string precedes its own beginning.  Equal keys <=> tied rows.
    """
    p = prefix or f"_k_{col}"
    c = F.col(col)
    flag = c.isNull() if nulls_last else c.isNotNull()
    if text:
        points = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: -F.ascii(x))
        val = F.coalesce(c, F.lit("")) if ascending else F.concat(points, F.array(F.lit(1)))
        return [flag.alias(f"{p}_n"), val.alias(f"{p}_v")]
    val = c if ascending else -c
    return [flag.alias(f"{p}_n"), F.coalesce(val.cast("double"), F.lit(0.0)).alias(f"{p}_v")]


def global_rank(df: DataFrame, group_col: str, key_cols: Sequence[str]) -> DataFrame:
    """SQL ``RANK() OVER (PARTITION BY group ORDER BY keys)`` plus the group
    size ``n`` (for ``percent_rank``), computed without funnelling a group
    through one task.  ``key_cols`` must be null-free and ascending (see
    ``sort_key``).  Returns ``df`` with columns ``rank`` and ``n`` added.
    """
    keys = [group_col, *key_cols]
    distinct = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    # range exchange on (group, keys); the task index after it is the range
    # index (AQE only merges neighbouring ranges), frozen by the checkpoint;
    # clustering the tagged rows by (range, group) before the checkpoint
    # gives the per-range window and totals below their layout for free
    ordered = reliable_checkpoint(
        distinct.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id())
        .repartition("_pid", group_col))
    # per (range, group) totals: at most partitions x groups rows
    totals = ordered.groupBy("_pid", group_col).agg(F.sum("_w").alias("_t"))
    by_range = Window.partitionBy(group_col).orderBy("_pid")
    offsets = totals.select(
        "_pid", group_col,
        F.coalesce(F.sum("_t").over(by_range.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy(group_col)).alias("n"))
    # weight of smaller keys inside the same range: a window per (range,
    # group), i.e. one balanced range of distinct keys per task
    inside = Window.partitionBy("_pid", group_col).orderBy(*key_cols) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("_before", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    ranks = local.join(F.broadcast(offsets), ["_pid", group_col]).select(
        *keys, (F.col("_off") + F.col("_before") + 1).cast("long").alias("rank"),
        F.col("n").cast("long"))
    return df.join(ranks, keys, "inner")


def percent_from_rank(rank: str = "rank", n: str = "n", digits: int = 2) -> F.Column:
    """round(percent_rank * 100, digits), exact: 100*(rank-1)/(n-1), 0 if n = 1."""
    return F.when(F.col(n) <= 1, F.lit(0.0)).otherwise(
        ratio_half_up(f"(100 * ({rank} - 1))", f"({n} - 1)", digits))


def ranked_eligible(stats: DataFrame, min_population: int = 100000) -> DataFrame:
    """Eligible cities with all their stats plus the 32 rank / percentile
    columns (W1–W4), from one checkpoint of the eligible rows.

    The eligible set is one row per city (bounded by the number of places,
    not by the crash data); checkpointing it to the cluster's checkpoint
    folder means the stats are computed once, although the rank job reads
    them three times (distinct keys, join back, output).
    """
    elig = reliable_checkpoint(eligible(stats, min_population))
    return elig.join(_rank_columns(elig), list(CITY_KEY), "left")


def city_rankings(stats: DataFrame, min_population: int = 100000) -> DataFrame:
    """Key + the 32 rank / percentile columns of every eligible city."""
    return ranked_eligible(stats, min_population).select(*CITY_KEY, *ALL_RANK_OUTPUTS)


def _rank_columns(elig: DataFrame) -> DataFrame:
    """8 ranks and 8 percentiles among all eligible cities and among
    pledged cities, one row per eligible city of ``elig``.

    * ``rank_*_all``: order by metric asc nulls last, population desc; null
      when the metric is null.
    * ``pct_*_all``: percent_rank by metric only (nulls count in n); null
      when the metric is null.
    * ``rank_*_vz``: among pledged cities by metric only, *no* null guard.
    * ``pct_*_vz``: as ``pct_*_all`` within pledged cities.
    """
    metrics = list(RANK_BASES)
    long = elig.select(
        *CITY_KEY, "population", "is_pledged",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                     F.col(m).cast("double").alias("value"))
                            for m in metrics])).alias("mv"),
    ).select(*CITY_KEY, "population", "is_pledged", "mv.metric", "mv.value")

    def spec(name: str, frame: DataFrame, tiebreak: bool) -> DataFrame:
        tb = (-F.col("population")).cast("double") if tiebreak else F.lit(0.0)
        return frame.select(
            *CITY_KEY, "metric", "value",
            F.concat(F.lit(name + ":"), F.col("metric")).alias("grp"),
            F.col("value").isNull().alias("k_null"),
            F.coalesce(F.col("value"), F.lit(0.0)).alias("k_val"),
            tb.alias("k_tb"))

    unioned = (spec("all_tb", long, True)
               .unionByName(spec("all", long, False))
               .unionByName(spec("vz", long.filter(F.col("is_pledged")), False)))
    ranked = global_rank(unioned, "grp", ["k_null", "k_val", "k_tb"])

    scope = F.split(F.col("grp"), ":").getItem(0)
    base = F.create_map(*[x for m, b in RANK_BASES.items() for x in (F.lit(m), F.lit(b))])
    b = base[F.col("metric")]
    has = F.col("value").isNotNull()
    pct = percent_from_rank()
    cells = (ranked
             .withColumn("scope", scope)
             .select(*CITY_KEY, F.explode(F.array(
                 F.when(F.col("scope") == "all_tb", F.struct(
                     F.concat(F.lit("rank_"), b, F.lit("_all")).alias("name"),
                     F.when(has, F.col("rank").cast("double")).alias("v"))),
                 F.when(F.col("scope") == "all", F.struct(
                     F.concat(F.lit("pct_"), b, F.lit("_all")).alias("name"),
                     F.when(has, pct).alias("v"))),
                 F.when(F.col("scope") == "vz", F.struct(
                     F.concat(F.lit("rank_"), b, F.lit("_vz")).alias("name"),
                     F.col("rank").cast("double").alias("v"))),
                 F.when(F.col("scope") == "vz", F.struct(
                     F.concat(F.lit("pct_"), b, F.lit("_vz")).alias("name"),
                     F.when(has, pct).alias("v"))),
             )).alias("cell"))
             .filter(F.col("cell").isNotNull())
             .select(*CITY_KEY, "cell.name", "cell.v"))
    wide = cells.groupBy(*CITY_KEY).pivot("name", list(ALL_RANK_OUTPUTS)).agg(F.first("v"))
    # pledged-only columns are absent for non-pledged cities: pivot gives null
    out = [F.col(c) for c in CITY_KEY]
    for c in ALL_RANK_OUTPUTS:
        out.append(F.col(c).cast("int").alias(c) if c.startswith("rank_") else F.col(c))
    return elig.select(*CITY_KEY).join(wide.select(*out), list(CITY_KEY), "left")


def with_rankings(stats: DataFrame, min_population: int = 100000) -> DataFrame:
    """city_stats with the 32 rank/percentile columns (L7 write-back)."""
    ranks = ranked_eligible(stats, min_population).select(*CITY_KEY, *ALL_RANK_OUTPUTS)
    return stats.join(ranks, list(CITY_KEY), "left")


def ranked_totals(ranked_stats: DataFrame) -> DataFrame:
    """Number of cities holding a rank, per rank column (one pass)."""
    cols = RANK_COLS + RANK_VZ_COLS
    counts = ranked_stats.agg(*[F.count(c).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("rank_column"), F.col(c).alias("n_ranked"))
        for c in cols])).alias("t")).select("t.rank_column", "t.n_ranked")


def better_than(ranked_stats: DataFrame, small_population: int = 100000) -> DataFrame:
    """W6: "better than X %" (100 - pct, 1 decimal), "#rank of n" and the
    small-population flag, per city and metric (long form)."""
    totals = ranked_totals(ranked_stats)
    rows = []
    for m, bname in RANK_BASES.items():
        for scope in ("all", "vz"):
            rows.append(F.struct(
                F.lit(m).alias("metric"), F.lit(scope).alias("scope"),
                F.col(f"rank_{bname}_{scope}").alias("rank"),
                F.col(f"pct_{bname}_{scope}").alias("pct"),
                F.lit(f"rank_{bname}_{scope}").alias("rank_column")))
    long = ranked_stats.select(*CITY_KEY, "population",
                               F.explode(F.array(*rows)).alias("r")).select(
        *CITY_KEY, "population", "r.*")
    long = long.join(F.broadcast(totals), "rank_column", "left")
    return long.select(
        *CITY_KEY, "metric", "scope", "rank", "n_ranked",
        # 100 - pct to one decimal, half up on the 2-decimal value (integers)
        F.when(F.col("pct").isNotNull(),
               ((F.lit(10005) - F.round(F.col("pct") * 100).cast("long")) / 10)
               .cast("long").cast("double") / F.lit(10.0)).alias("better_than_pct"),
        F.when(F.col("rank").isNotNull(),
               F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" of "),
                        F.col("n_ranked").cast("string"))).alias("rank_label"),
        (F.col("population") < small_population).alias("small_population"))
