"""Blocking checks, diagnostics and table profiles.

The blocking checks are one aggregate pass over the crash table (plus one
aggregate for duplicate keys) that yields a small result table
(check, violations, passed); ``enforce`` raises after the action.  The
source ran six separate EXISTS queries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRASH_KEY = ("st_case", "year")


def _stack(agg_row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """Unpivot a one-row aggregate into (label, value) rows."""
    return agg_row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias(label), F.col(n).cast("long").alias(value)) for n in names
    ])).alias("_r")).select(f"_r.{label}", f"_r.{value}")


def blocking_checks(crashes: DataFrame, date_lo: str = "1987-01-01",
                    date_hi: str = "2024-12-31", max_fatalities: int = 30,
                    key: Sequence[str] = CRASH_KEY) -> DataFrame:
    """V1–V6 as rows (check, violations, passed)."""
    d = F.col("crash_date")
    tot = F.col("total_fatalities")
    rows = crashes.agg(
        F.count_if(F.col("year").isNull() | F.col("st_case").isNull()
                   | F.col("state").isNull()).alias("missing_required_fields"),
        F.count_if(d.isNotNull() & ((d < F.lit(date_lo).cast("date"))
                                    | (d > F.lit(date_hi).cast("date")))).alias("date_out_of_range"),
        F.count_if((tot < 0) | (F.col("motorist_fatalities") < 0)
                   | (F.col("cyclist_fatalities") < 0)
                   | (F.col("pedestrian_fatalities") < 0)).alias("negative_fatalities"),
        # SQL three-valued logic: a null subtype makes the sum null -> not flagged
        F.count_if(tot != (F.col("motorist_fatalities") + F.col("cyclist_fatalities")
                           + F.col("pedestrian_fatalities") + F.col("other_fatalities")))
         .alias("fatality_sum_mismatch"),
        F.count_if(tot > max_fatalities).alias("implausible_fatalities"),
    )
    row_checks = _stack(rows, ["missing_required_fields", "date_out_of_range",
                               "negative_fatalities", "fatality_sum_mismatch",
                               "implausible_fatalities"], "check", "violations")
    dups = (crashes.groupBy(*key).count().filter(F.col("count") > 1)
            .agg(F.count(F.lit(1)).cast("long").alias("violations"))
            .select(F.lit("duplicate_keys").alias("check"), "violations"))
    return dups.unionByName(row_checks).withColumn("passed", F.col("violations") == 0)


#: Blocking checks that a crash file's rows can fail before they are enriched, and counts for the report.
LOAD_CHECKS = ("missing_required_fields", "date_out_of_range", "negative_fatalities", "implausible_fatalities")
LOAD_COUNTS = ("inserted", "skipped_existing", "skipped_duplicate", "error", "missing_date", "missing_point")


def load_metrics(date_lo: str = "1987-01-01", date_hi: str = "2024-12-31", max_fatalities: int = 30) -> list[F.Column]:
    """V2, V3, V4 and V6 over the rows that a load inserts, its outcomes (L5) and gaps (D10), as aggregates for
    ``DataFrame.observe``: they are counted while the rows are written, without another scan."""
    new = F.col("outcome") == "inserted"
    d, tot = F.col("crash_date"), F.col("total_fatalities")
    found = {
        "missing_required_fields": F.col("year").isNull() | F.col("st_case").isNull() | F.col("state").isNull(),
        "date_out_of_range": (d < F.lit(date_lo).cast("date")) | (d > F.lit(date_hi).cast("date")),
        "negative_fatalities": tot < 0, "implausible_fatalities": tot > max_fatalities,
        "missing_date": d.isNull(), "missing_point": F.col("lon").isNull()}
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    outcomes = [n(F.when(F.col("outcome") == o, F.col("n_rows"))).alias(o) for o in LOAD_COUNTS[:4]]
    return [*[n(F.when(new & F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in found.items()], *outcomes]


def load_report(spark: SparkSession, metrics: dict) -> DataFrame:
    """(check, violations, passed) of observed ``load_metrics``; counts that no check limits always pass."""
    rows = [(k, int(metrics.get(k) or 0), k not in LOAD_CHECKS or not metrics.get(k)) for k in (*LOAD_CHECKS, *LOAD_COUNTS)]
    return spark.createDataFrame(rows, "check string, violations long, passed boolean")


class BlockingCheckFailed(RuntimeError):
    pass


def enforce(checks: DataFrame) -> DataFrame:
    """V7 gate: raise if any blocking check has violations (≤ 6 rows collected)."""
    failed = [(r["check"], r["violations"]) for r in checks.collect() if not r["passed"]]
    if failed:
        raise BlockingCheckFailed(
            "blocking checks failed: " + ", ".join(f"{c}={n}" for c, n in failed))
    return checks


def duplicate_keys(crashes: DataFrame, key: Sequence[str] = CRASH_KEY) -> DataFrame:
    """Duplicate key listing with counts."""
    return crashes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_fields(crashes: DataFrame) -> DataFrame:
    """Missing critical fields (one row)."""
    return crashes.agg(F.count_if(F.col("year").isNull()).alias("missing_year"),
                       F.count_if(F.col("state").isNull()).alias("missing_state"),
                       F.count_if(F.col("st_case").isNull()).alias("missing_case"))


def bad_dates_per_year(crashes: DataFrame, date_lo: str = "1987-01-01",
                       date_hi: str = "2023-12-31") -> DataFrame:
    """D3: crashes with a date outside the range, per year (diagnostic bound)."""
    d = F.col("crash_date")
    bad = crashes.filter(d.isNotNull() & ((d < F.lit(date_lo).cast("date"))
                                          | (d > F.lit(date_hi).cast("date"))))
    return bad.groupBy("year").agg(F.count(F.lit(1)).alias("total_records"),
                                   F.count(F.lit(1)).alias("bad_dates"))


def _sample(df: DataFrame, n: int) -> DataFrame:
    cols = ["st_case", "year", "total_fatalities", "motorist_fatalities",
            "cyclist_fatalities", "pedestrian_fatalities"]
    # a sampling report: the limit is the feature; ordered for determinism
    return df.select(*cols).orderBy("year", "st_case").limit(n)


def negative_samples(crashes: DataFrame, n: int = 10) -> DataFrame:
    """Up to ``n`` crashes with a negative fatality value."""
    return _sample(crashes.filter((F.col("total_fatalities") < 0)
                                  | (F.col("motorist_fatalities") < 0)
                                  | (F.col("cyclist_fatalities") < 0)
                                  | (F.col("pedestrian_fatalities") < 0)), n)


def implausible_samples(crashes: DataFrame, max_fatalities: int = 30, n: int = 10) -> DataFrame:
    """Up to ``n`` crashes with more than ``max_fatalities`` deaths."""
    return _sample(crashes.filter(F.col("total_fatalities") > max_fatalities), n)


def crashes_per_year(crashes: DataFrame) -> DataFrame:
    """Crash count per year (D7 is its sum)."""
    return crashes.groupBy("year").agg(F.count(F.lit(1)).alias("crashes"))


def total_crashes(crashes: DataFrame) -> DataFrame:
    """Total crash count."""
    return crashes.agg(F.count(F.lit(1)).alias("crashes"))


def fatality_distribution(crashes: DataFrame) -> DataFrame:
    """Yearly fatality sums by subtype."""
    return crashes.groupBy("year").agg(
        F.sum("total_fatalities").alias("total"),
        F.sum("pedestrian_fatalities").alias("peds"),
        F.sum("cyclist_fatalities").alias("cyclists"),
        F.sum("motorist_fatalities").alias("motorists"))


def year_mismatches(crashes: DataFrame) -> DataFrame:
    """Crashes whose date's year differs from the dataset year."""
    d = F.col("crash_date")
    return (crashes.filter(d.isNotNull() & (F.year(d) != F.col("year")))
            .groupBy("year").agg(F.count(F.lit(1)).alias("mismatches")))


def completeness(crashes: DataFrame) -> DataFrame:
    """Date and location completeness per year."""
    has_loc = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return crashes.groupBy("year").agg(
        F.count(F.lit(1)).alias("total"),
        (F.count(F.lit(1)) - F.count("crash_date")).alias("missing_date"),
        F.count_if(~has_loc).alias("missing_geometry"))


def implausible_points(crashes: DataFrame) -> DataFrame:
    """Located crashes outside ±180 / ±90."""
    has_loc = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return crashes.agg(F.count_if(has_loc & ~ok).alias("invalid_points"))


def table_profile(df: DataFrame) -> DataFrame:
    """Per column, row count and null count (one aggregate pass)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}")
                   for i, c in enumerate(cols)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.col("_rows").alias("row_count"), F.col(f"_null_{i}").alias("null_count"))
        for i, c in enumerate(cols)])).alias("p")).select("p.*")


def table_preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order (a distributed top-k: each task
    keeps its ``n`` smallest rows, the driver merges at most tasks × n)."""
    return df.orderBy(*order).limit(n)


def file_profile(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """S10 for raw files: per file (dataset year) and column present in it,
    the row count and the number of blank cells — one aggregate pass over
    all files, unpivoted with ``explode``."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(fields):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_null_{i}"))
        aggs.append(F.max(F.col(f"has_{c.lower()}")).alias(f"_has_{i}"))
    per_file = raw.groupBy("source_file", "dataset_year").agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("null_count"),
                 F.col(f"_has_{i}").alias("present"))
        for i, c in enumerate(fields)])).alias("c")
    return (per_file.select(F.col("dataset_year").alias("year"),
                            F.col("_rows").alias("row_count"), cells)
            .filter("c.present")
            .select("year", "c.column_name", "row_count", "c.null_count"))
