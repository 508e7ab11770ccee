"""Typed crash / person records from raw files, keyed loads and outcomes
(N1–N8, L1, L2, L5, J1, J2).

``normalize_crashes`` is one projection over the scanned text (native
expressions only); every row gets ``reject_reason`` — null when the row
would have been inserted by the source, otherwise the first rule it
breaks (unparsable key or count, a value longer than its column, a
negative count, a required column missing from the file).  The source
aborted the whole file on a parse error and rolled back partial batches;
here each row is quarantined on its own and the counters are exact
(declared difference, SURVEY §8 Q16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.functions import dims
from roadstats.functions import normalize as nz
from roadstats.operators import loads as ld
from roadstats.sources.raw_files import CRASH_REQUIRED

CRASH_KEY = ("st_case", "year")
PERSON_KEY = ("st_case", "year", "vehicle_number", "person_number")

CRASH_COLUMNS = ("st_case", "year", "crash_date", "state", "state_name", "county",
                 "county_name", "city", "fars_city_name", "route_code", "road_label",
                 "total_fatalities", "lon", "lat", "coord_status")
# Column length limits of the target table (CHAR / VARCHAR).
CRASH_LENGTHS = (("state", 2), ("county", 3), ("city", 4), ("state_name", 20),
                 ("county_name", 40), ("fars_city_name", 80), ("road_label", 30))
PERSON_INT_FIELDS = (("VEH_NO", "vehicle_number"), ("PER_NO", "person_number"),
                     ("AGE", "person_age"), ("SEX", "sex"), ("PER_TYP", "person_type"),
                     ("INJ_SEV", "injury_severity"), ("LOCATION", "location_code"))


def normalize_crashes(spark: SparkSession, raw: DataFrame, city_codes: DataFrame,
                      west_positive: bool = False) -> DataFrame:
    """Typed crash records (+ ``reject_reason``, ``load_order``).

    ``city_codes`` (state_code, fars_city_code, fars_city_name) is the J2
    lookup; it is de-duplicated on its key first (the source kept whichever
    row its dict saw last).  The fixed dimensions (states, routes) are
    broadcast; the code table is joined without a hint, so its measured size
    decides the strategy.
    """
    has = {c: F.col(f"has_{c.lower()}") for c in
           ("ST_CASE", "STATE", "STATENAME", "COUNTY", "COUNTYNAME", "CITY", "CITYNAME",
            "ROUTE", "FATALS", "YEAR", "MONTH", "DAY")}
    lon, lat, status = nz.coordinates("LATITUDE", "LONGITUD", west_positive=west_positive)
    t = raw.select(
        nz.int_text("ST_CASE").alias("st_case"),
        F.col("dataset_year").alias("year"),
        nz.crash_date("YEAR", "MONTH", "DAY").alias("crash_date"),
        nz.padded_code("STATE", 2).alias("state"),
        F.when(has["STATENAME"], F.coalesce("STATENAME", F.lit(""))).alias("_state_name"),
        has["STATENAME"].alias("_has_state_name"),
        nz.padded_code("COUNTY", 3).alias("county"),
        F.when(has["COUNTYNAME"], F.coalesce("COUNTYNAME", F.lit(""))).alias("county_name"),
        nz.padded_code("CITY", 4).alias("city"),
        F.col("CITYNAME").alias("_city_name_raw"), has["CITYNAME"].alias("_has_city_name"),
        nz.route_code("ROUTE", has["ROUTE"]).alias("route_code"),
        F.when(has["FATALS"], nz.int_text("FATALS")).otherwise(F.lit(0))
         .alias("total_fatalities"),
        lon.alias("lon"), lat.alias("lat"), status.alias("coord_status"),
        F.coalesce(*[F.when(~has[c], F.lit(f"missing_column_{c}")) for c in CRASH_REQUIRED])
         .alias("_missing"),
        "source_file", "load_order", *_raw_row(raw),
    )
    codes = (city_codes.groupBy("state_code", "fars_city_code")
             .agg(F.max("fars_city_name").alias("_code_name"))
             .withColumnRenamed("state_code", "state").withColumnRenamed("fars_city_code", "city"))
    t = (t.join(F.broadcast(dims.state_dim(spark)).withColumnRenamed("state_fips", "state"),
                "state", "left")
         # the code table is an input file: no broadcast hint; Spark's
         # size threshold (and AQE at run time) decides
         .join(codes, ["state", "city"], "left")
         .join(F.broadcast(dims.route_dim(spark)), "route_code", "left"))
    t = t.select(
        "*",
        F.when(F.col("_has_state_name"), F.col("_state_name"))
         .otherwise(F.coalesce(F.col("state_name"), F.lit("ERROR"))).alias("_sn"),
        nz.city_name(F.col("city"), F.col("_city_name_raw"), F.col("_has_city_name"),
                     F.col("_code_name")).alias("fars_city_name"),
        F.coalesce(F.col("road_label"), F.lit("Unknown")).alias("_rl"),
    ).drop("state_name", "road_label", "_code_name").withColumnRenamed("_sn", "state_name") \
        .withColumnRenamed("_rl", "road_label")
    too_long = [F.when(F.length(c) > n, F.lit(f"{c}_too_long")) for c, n in CRASH_LENGTHS]
    reason = F.coalesce(
        F.col("_missing"),
        F.when(F.col("st_case").isNull(), F.lit("bad_st_case")),
        F.when(F.col("route_code").isNull(), F.lit("bad_route")),
        F.when(F.col("total_fatalities").isNull(), F.lit("bad_fatals")),
        F.when(F.col("total_fatalities") < 0, F.lit("negative_fatalities")),
        *too_long,
    )
    return _rejected_raw(t.withColumn("reject_reason", reason).select(
        *CRASH_COLUMNS, "reject_reason", "source_file", "load_order", *_raw_row(t)))


def load_crashes(typed: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """L1 + L5: per-row outcome of loading ``typed`` into ``target``.

    Errors are rows with a ``reject_reason``; rows whose key exists in
    ``target`` are ``skipped_existing``; among the rest the first row in
    file order wins per (st_case, year).
    """
    return ld.load_outcomes(typed, target, CRASH_KEY, ["load_order"],
                            valid=F.col("reject_reason").isNull())


def crash_ledger(typed: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """L1 + L5 as a ledger (``loads.keyed_ledger``): what ``load_crashes`` tells row by row, with the rows skipped
    counted per key; the files are parsed and shuffled once."""
    return ld.keyed_ledger(typed, target, CRASH_KEY, ["load_order"], F.col("reject_reason").isNull())


def person_ledger(typed_persons: DataFrame, crashes: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """J1 + L2 + L5 as a ledger; an unparsable ST_CASE is an error, a missing crash an orphan, then field errors."""
    keys = crashes.select(*CRASH_KEY).distinct().withColumn("_crash", F.lit(True))
    p = typed_persons.join(keys, list(CRASH_KEY), "left")
    orphan = F.col("_crash").isNull() & F.col("st_case").isNotNull()
    return ld.keyed_ledger(p, target, PERSON_KEY, ["load_order"], F.col("reject_reason").isNull(), orphan).drop("_crash")


def loaded_keys(typed: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Crash keys present after a load: the target's keys plus every key of
    a valid batch row (each such key gets exactly one inserted row).  An
    aggregate, without the per-row outcome join of ``load_crashes``."""
    keys = typed.filter(F.col("reject_reason").isNull()).select(*CRASH_KEY)
    if target is not None:
        keys = keys.unionByName(target.select(*CRASH_KEY))
    return keys.distinct()


def inserted(outcomes: DataFrame, columns: Sequence[str]) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "inserted").select(*columns)


def normalize_persons(raw: DataFrame) -> DataFrame:
    """Ten integer fields; ``reject_reason`` when any is not an integer."""
    ints = [nz.int_text(src).alias(dst) for src, dst in PERSON_INT_FIELDS]
    t = raw.select(nz.int_text("ST_CASE").alias("st_case"),
                   F.col("dataset_year").alias("year"), *ints,
                   "source_file", "load_order", *_raw_row(raw))
    bad = [F.when(F.col(dst).isNull(), F.lit(f"bad_{dst}")) for _, dst in PERSON_INT_FIELDS]
    return _rejected_raw(t.withColumn("reject_reason", F.coalesce(*bad)))


def with_raw_row(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``raw`` and ``raw_row``, its fields as they stand in the file (JSON), for the quarantine."""
    return raw.withColumn("raw_row", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def _raw_row(df: DataFrame) -> list[str]:
    return ["raw_row"] if "raw_row" in df.columns else []


def _rejected_raw(df: DataFrame) -> DataFrame:
    """``raw_row`` is kept for rejected rows only."""
    return df.withColumns({c: F.when(F.col("reject_reason").isNotNull(), F.col(c)) for c in _raw_row(df)})


def load_persons(typed_persons: DataFrame, crashes: DataFrame,
                 target: DataFrame | None = None) -> DataFrame:
    """J1 + L2 + L5: persons against the loaded crashes of their year.

    Outcome order follows the source: an unparsable ST_CASE is an error; a
    crash key missing from ``crashes`` is ``skipped_orphan``; then field
    errors; then first row wins per (crash, vehicle, person).  ``crashes``
    is a key set of the size of the crash table, so the join is a shuffle
    join (AQE may broadcast it when a year slice is small).
    """
    keys = crashes.select(*CRASH_KEY).withColumn("_crash", F.lit(True))
    p = typed_persons.join(keys, list(CRASH_KEY), "left")
    out = ld.load_outcomes(p, target, PERSON_KEY, ["load_order"],
                           valid=F.col("reject_reason").isNull() & F.col("_crash").isNotNull())
    outcome = (F.when(F.col("st_case").isNull(), F.lit("error"))
               .when(F.col("_crash").isNull(), F.lit("skipped_orphan"))
               .otherwise(F.col("outcome")))
    return out.withColumn("outcome", outcome).drop("_crash")
