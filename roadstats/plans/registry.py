"""Registered queries: one per operator family of SURVEY §2.

Each query takes (spark, sf_dir), reads the driver tables at ``sf_dir``
through the stand-in rules and returns a DataFrame.  Output columns are
normalised for the oracle comparison (integers -> bigint, decimals and
floats -> double, dates -> ISO string); the matching DuckDB SQL lives in
``ORACLES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.operators import arcs as ar
from roadstats.operators import city_stats as cs
from roadstats.operators import loads as ld
from roadstats.operators import quality as qa
from roadstats.operators import ranking as rk
from roadstats.operators import serving as sv
from roadstats.operators import overlay as ov
from roadstats.operators import spatial as sa
from roadstats.operators import hotspots as hs
from roadstats.operators import places as pl
from roadstats.operators import raw_load as rl
from roadstats.operators import subtypes as st
from roadstats.plans import export as ex
from roadstats.plans import oracle_sql as osql
from roadstats.session import reliable_checkpoint, shared_dir
from roadstats.sources import place_files as pf
from roadstats.sources import raw_files as rf
from roadstats.sources import standins as sp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The SQL as written, before the stand-ins' definitions are put in front.
ORACLES_TEXT: dict[str, str] = {}


def normalise(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DecimalType, T.DoubleType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: normalise(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES_TEXT[name] = oracle
            ORACLES[name] = osql.with_ctes(oracle)
        return fn
    return deco


# ---------------------------------------------------------------------------
# City statistics
# ---------------------------------------------------------------------------

_STATS_OUT = ("state_fips", "place_fips", "population", "is_pledged") + cs.STAT_COLS


@register("city_stats", "SELECT " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c == "population" else c for c in _STATS_OUT)
    + " FROM sp_city_stats")
def q_city_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir))
    return stats.select(*_STATS_OUT)


# ---------------------------------------------------------------------------
# Ranks and percentiles (W1–W4) — the flagship query
# ---------------------------------------------------------------------------

_RANKED_OUT = _STATS_OUT + rk.ALL_RANK_OUTPUTS


def ranked_city_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir))
    return rk.ranked_eligible(stats)


@register("city_rankings", "SELECT " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c == "population" else c for c in _RANKED_OUT)
    + " FROM sp_ranked")
def q_city_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_city_stats(spark, sf_dir).select(*_RANKED_OUT)


# ---------------------------------------------------------------------------
# Crash table, persons, subtypes (N3–N6 typed, A1, A2, N13, J1, J3, L2, L5, D12)
# ---------------------------------------------------------------------------

_CRASH_OUT = ("st_case", "year", "crash_date", "state", "state_name", "county", "city",
              "fars_city_name", "place_fips", "route_code", "road_label", "lon", "lat",
              "total_fatalities") + st.SUBTYPE_COLS


@register("crash_table", "SELECT " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c in ("year", "route_code", "total_fatalities")
    + st.SUBTYPE_COLS else (f"strftime({c}, '%Y-%m-%d') AS {c}" if c == "crash_date" else c)
    for c in _CRASH_OUT) + " FROM sp_crashes")
def q_crash_table(spark, sf_dir):
    return sp.crashes(spark, sf_dir).select(*_CRASH_OUT)


@register("fatal_crash_flags", """
    SELECT st_case, CAST(year AS BIGINT) AS year, bool_or(is_fatal_person) AS is_fatal_crash
    FROM sp_person_sem GROUP BY st_case, year""")
def q_fatal_crash_flags(spark, sf_dir):
    return st.fatal_crash_flags(sp.persons(spark, sf_dir), sp.loaded_crashes(spark, sf_dir),
                                sp.PERSON_CRASH_KEY)


@register("person_semantics", """
    SELECT person_role, person_mode, is_fatal_person, count(*) AS n_persons
    FROM sp_person_modes GROUP BY ALL""")
def q_person_semantics(spark, sf_dir):
    pw = st.person_with_crash(sp.persons(spark, sf_dir),
                              sp.loaded_crashes(spark, sf_dir), sp.PERSON_CRASH_KEY)
    return (st.person_semantics(pw).groupBy("person_role", "person_mode", "is_fatal_person")
            .agg(F.count(F.lit(1)).alias("n_persons")))


@register("unknown_person_types", """
    SELECT CAST(person_type AS BIGINT) AS person_type, count(*) AS n_persons,
           count(DISTINCT st_case) AS n_crashes
    FROM sp_persons WHERE injury_severity = 4
      AND person_type NOT IN (1, 2, 3, 9, 5, 10, 6, 7, 4, 8, 11, 12, 13, 19, 99)
    GROUP BY person_type""")
def q_unknown_person_types(spark, sf_dir):
    return st.unknown_person_types(sp.persons(spark, sf_dir), sp.PERSON_CRASH_KEY)


@register("person_load_outcomes", """
    WITH j AS (SELECT r.*, k.st_case IS NOT NULL AS has_crash FROM sp_persons_raw r
               LEFT JOIN sp_crash_keys k ON r.st_case = k.st_case),
    w AS (SELECT *, row_number() OVER (PARTITION BY st_case, vehicle_number, person_number
                  ORDER BY l_partkey, l_extendedprice, l_quantity, l_shipdate) AS rn
          FROM j WHERE has_crash)
    SELECT outcome, count(*) AS n_rows FROM (
        SELECT 'skipped_orphan' AS outcome FROM j WHERE NOT has_crash
        UNION ALL
        SELECT CASE WHEN rn = 1 THEN 'inserted' ELSE 'skipped_duplicate' END FROM w) t
    GROUP BY outcome""")
def q_person_load_outcomes(spark, sf_dir):
    """J1 + L2 + L5: persons against crashes with st_case % 23 <> 0 removed
    (orphans), first row wins per person key."""
    crash_keys = sp.crash_points(spark, sf_dir).select("st_case") \
        .filter(F.col("st_case") % 23 != 0).withColumn("_has", F.lit(True))
    raw = sp.raw_persons(spark, sf_dir).join(crash_keys, "st_case", "left")
    out = ld.load_outcomes(raw, None, ["st_case", "vehicle_number", "person_number"],
                           ["load_order"], valid=F.col("_has").isNotNull())
    out = out.withColumn("outcome", F.when(F.col("outcome") == "error", "skipped_orphan")
                         .otherwise(F.col("outcome")))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


@register("person_orphans", """
    SELECT count(*) AS orphans, count(DISTINCT r.st_case) AS orphan_crashes
    FROM sp_persons_raw r WHERE r.st_case NOT IN (SELECT st_case FROM sp_crash_keys)""")
def q_person_orphans(spark, sf_dir):
    crash_keys = sp.crash_points(spark, sf_dir).select("st_case").filter(F.col("st_case") % 23 != 0)
    o = ld.orphans(sp.raw_persons(spark, sf_dir), crash_keys, ["st_case"])
    return o.agg(F.count(F.lit(1)).alias("orphans"),
                 F.count_distinct("st_case").alias("orphan_crashes"))


# ---------------------------------------------------------------------------
# Data quality
# ---------------------------------------------------------------------------

@register("blocking_checks", """
    SELECT * , violations = 0 AS passed FROM (
      SELECT 'duplicate_keys' AS "check", (SELECT count(*) FROM (SELECT st_case, year FROM sp_crashes
              GROUP BY st_case, year HAVING count(*) > 1)) AS violations
      UNION ALL SELECT 'missing_required_fields', count(*) FILTER (WHERE year IS NULL OR st_case IS NULL OR state IS NULL) FROM sp_crashes
      UNION ALL SELECT 'date_out_of_range', count(*) FILTER (WHERE crash_date IS NOT NULL AND (crash_date < DATE '1987-01-01' OR crash_date > DATE '2024-12-31')) FROM sp_crashes
      UNION ALL SELECT 'negative_fatalities', count(*) FILTER (WHERE total_fatalities < 0 OR motorist_fatalities < 0 OR cyclist_fatalities < 0 OR pedestrian_fatalities < 0) FROM sp_crashes
      UNION ALL SELECT 'fatality_sum_mismatch', count(*) FILTER (WHERE total_fatalities <> motorist_fatalities + cyclist_fatalities + pedestrian_fatalities + other_fatalities) FROM sp_crashes
      UNION ALL SELECT 'implausible_fatalities', count(*) FILTER (WHERE total_fatalities > 30) FROM sp_crashes) t""")
def q_blocking_checks(spark, sf_dir):
    return qa.blocking_checks(sp.loaded_crashes(spark, sf_dir))


@register("duplicate_person_keys", """
    SELECT st_case, CAST(vehicle_number AS BIGINT) AS vehicle_number,
           CAST(person_number AS BIGINT) AS person_number, count(*) AS n FROM sp_persons_raw
    GROUP BY ALL HAVING count(*) > 1""")
def q_duplicate_person_keys(spark, sf_dir):
    return qa.duplicate_keys(sp.raw_persons(spark, sf_dir),
                             ["st_case", "vehicle_number", "person_number"])


@register("missing_fields", """
    SELECT count(*) FILTER (WHERE year IS NULL) AS missing_year,
           count(*) FILTER (WHERE state IS NULL) AS missing_state,
           count(*) FILTER (WHERE st_case IS NULL) AS missing_case FROM sp_crashes""")
def q_missing_fields(spark, sf_dir):
    return qa.missing_fields(sp.loaded_crashes(spark, sf_dir))


@register("bad_dates_per_year", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS total_records, count(*) AS bad_dates
    FROM sp_crashes WHERE crash_date IS NOT NULL
      AND (crash_date < DATE '1987-01-01' OR crash_date > DATE '1998-12-31')
    GROUP BY year""")
def q_bad_dates_per_year(spark, sf_dir):
    # diagnostic upper bound as a parameter; 1998-12-31 makes the stand-in years hit it
    return qa.bad_dates_per_year(sp.loaded_crashes(spark, sf_dir),
                                 date_hi="1998-12-31")


@register("negative_samples", """
    SELECT st_case, CAST(year AS BIGINT) AS year, CAST(total_fatalities AS BIGINT) AS total_fatalities,
           CAST(motorist_fatalities AS BIGINT) AS motorist_fatalities,
           CAST(cyclist_fatalities AS BIGINT) AS cyclist_fatalities,
           CAST(pedestrian_fatalities AS BIGINT) AS pedestrian_fatalities
    FROM sp_crashes WHERE total_fatalities < 0 OR motorist_fatalities < 0
       OR cyclist_fatalities < 0 OR pedestrian_fatalities < 0
    ORDER BY year, st_case LIMIT 10""")
def q_negative_samples(spark, sf_dir):
    return qa.negative_samples(sp.loaded_crashes(spark, sf_dir))


@register("implausible_samples", """
    SELECT st_case, CAST(year AS BIGINT) AS year, CAST(total_fatalities AS BIGINT) AS total_fatalities,
           CAST(motorist_fatalities AS BIGINT) AS motorist_fatalities,
           CAST(cyclist_fatalities AS BIGINT) AS cyclist_fatalities,
           CAST(pedestrian_fatalities AS BIGINT) AS pedestrian_fatalities
    FROM sp_crashes WHERE total_fatalities > 3 ORDER BY year, st_case LIMIT 10""")
def q_implausible_samples(spark, sf_dir):
    # threshold is a parameter (30 in the blocking check); 3 exercises the report
    return qa.implausible_samples(sp.loaded_crashes(spark, sf_dir), max_fatalities=3)


@register("crashes_per_year", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS crashes FROM sp_crashes GROUP BY year""")
def q_crashes_per_year(spark, sf_dir):
    return qa.crashes_per_year(sp.loaded_crashes(spark, sf_dir))


@register("total_crashes", "SELECT count(*) AS crashes FROM sp_crashes")
def q_total_crashes(spark, sf_dir):
    return qa.total_crashes(sp.loaded_crashes(spark, sf_dir))


@register("fatality_distribution", """
    SELECT CAST(year AS BIGINT) AS year, CAST(sum(total_fatalities) AS BIGINT) AS total,
           CAST(sum(pedestrian_fatalities) AS BIGINT) AS peds,
           CAST(sum(cyclist_fatalities) AS BIGINT) AS cyclists,
           CAST(sum(motorist_fatalities) AS BIGINT) AS motorists
    FROM sp_crashes GROUP BY year""")
def q_fatality_distribution(spark, sf_dir):
    return qa.fatality_distribution(sp.loaded_crashes(spark, sf_dir))


@register("year_mismatches", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS mismatches FROM (
        SELECT st_case, year + (st_case % 3 = 0)::INTEGER AS year, crash_date FROM sp_crashes) t
    WHERE crash_date IS NOT NULL AND year(crash_date) <> year GROUP BY year""")
def q_year_mismatches(spark, sf_dir):
    # dataset year shifted by one for st_case % 3 = 0 so the check has hits
    c = sp.loaded_crashes(spark, sf_dir)
    c = c.withColumn("year", F.col("year") + (F.col("st_case") % 3 == 0).cast("int"))
    return qa.year_mismatches(c)


@register("completeness", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS total,
           count(*) - count(crash_date) AS missing_date,
           count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS missing_geometry
    FROM sp_crashes GROUP BY year""")
def q_completeness(spark, sf_dir):
    return qa.completeness(sp.loaded_crashes(spark, sf_dir))


@register("implausible_points", """
    SELECT count(*) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT
        (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) AS invalid_points FROM sp_crashes""")
def q_implausible_points(spark, sf_dir):
    return qa.implausible_points(sp.loaded_crashes(spark, sf_dir))


_PROFILE_COLS = ["st_case", "year", "crash_date", "state", "place_fips", "lon", "lat"]


@register("crash_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({i} AS BIGINT) AS position, count(*) AS row_count, "
    f"count(*) - count({c}) AS null_count FROM sp_crashes"
    for i, c in enumerate(_PROFILE_COLS)))
def q_crash_profile(spark, sf_dir):
    return qa.table_profile(sp.loaded_crashes(spark, sf_dir).select(*_PROFILE_COLS))


# ---------------------------------------------------------------------------
# Serving projections
# ---------------------------------------------------------------------------

@register("eligible_cities", """
    SELECT state_fips, place_fips, CAST(population AS BIGINT) AS population, is_pledged
    FROM sp_places WHERE population >= 100000 OR is_pledged""")
def q_eligible_cities(spark, sf_dir):
    return cs.eligible(sp.places(spark, sf_dir)).select(
        "state_fips", "place_fips", "population", "is_pledged")


_EXPORT_OUT = ("state_fips", "place_fips") + sv.EXPORT_CRASH_COLS


@register("export_crash_points", "SELECT " + ", ".join(
    f"strftime({c}, '%Y-%m-%d') AS {c}" if c == "crash_date" else
    (f"CAST({c} AS BIGINT) AS {c}" if c in ("year",) + sv.ANNUAL_COLS else c)
    for c in _EXPORT_OUT) + " FROM sp_export_points")
def q_export_crash_points(spark, sf_dir):
    return sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))


@register("annual_fatalities", "SELECT state_fips, place_fips, CAST(year AS BIGINT) AS year, "
          + ", ".join(sv.ANNUAL_COLS) + " FROM sp_annual_city")
def q_annual_fatalities(spark, sf_dir):
    return sv.annual_fatalities(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))


@register("year_extent", """
    SELECT CAST(min(year) AS BIGINT) AS min_year, CAST(max(year) AS BIGINT) AS max_year
    FROM sp_crashes""")
def q_year_extent(spark, sf_dir):
    return sv.year_extent(sp.crash_points(spark, sf_dir))


@register("annual_gap_filled", """
    WITH ext AS (SELECT max(year) AS mx FROM sp_crashes),
    grid AS (SELECT e.state_fips, e.place_fips, y.year FROM sp_elig_cities e,
             (SELECT unnest(range(1996, (SELECT mx FROM ext) + 1)) AS year) y)
    SELECT g.state_fips, g.place_fips, CAST(g.year AS BIGINT) AS year, """
          + ", ".join(f"CAST(coalesce(a.{c}, 0) AS BIGINT) AS {c}" for c in sv.ANNUAL_COLS)
          + """ FROM grid g LEFT JOIN sp_annual_city a ON a.state_fips = g.state_fips
      AND a.place_fips = g.place_fips AND a.year = g.year""")
def q_annual_gap_filled(spark, sf_dir):
    """J13 from 1996 (parameter; the dashboard uses 2001) to the max year."""
    crashes = sp.loaded_crashes(spark, sf_dir)
    elig = cs.eligible(sp.places(spark, sf_dir))
    max_year = sv.year_extent(sp.crash_points(spark, sf_dir)).first()["max_year"]
    return sv.gap_filled_annual(sv.annual_fatalities(crashes, elig), elig, 1996, max_year)


@register("pedestrian_points", """
    SELECT state_fips, place_fips, st_case, CAST(year AS BIGINT) AS year
    FROM sp_export_points WHERE pedestrian_fatalities > 0""")
def q_pedestrian_points(spark, sf_dir):
    pts = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    return sv.fatality_filter(pts, "pedestrian").select("state_fips", "place_fips", "st_case", "year")


@register("dominant_type_summary", """
    SELECT CASE WHEN pedestrian_fatalities > 0 THEN 'pedestrian'
                WHEN cyclist_fatalities > 0 THEN 'cyclist' ELSE 'motorist' END AS dominant_type,
           count(*) AS n_points, CAST(sum(total_fatalities) AS BIGINT) AS fatalities
    FROM sp_export_points GROUP BY 1""")
def q_dominant_type_summary(spark, sf_dir):
    pts = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    return sv.dominant_type(pts).groupBy("dominant_type").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("total_fatalities").alias("fatalities"))


@register("trend_directions", " UNION ALL ".join(
    f"SELECT state_fips, place_fips, '{c}' AS metric, CASE WHEN {c} IS NULL THEN 'none' "
    f"WHEN {c} <= 0 THEN 'improving' ELSE 'worsening' END AS direction, "
    f"round(abs({c}), 1) AS magnitude FROM sp_eligible" for c in cs.TREND_COLS))
def q_trend_directions(spark, sf_dir):
    stats = cs.eligible(cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir)))
    rows = []
    for c in cs.TREND_COLS:
        d, m = sv.trend_direction(c)
        rows.append(F.struct(F.lit(c).alias("metric"), d.alias("direction"), m.alias("magnitude")))
    # one pass over the stats: a row per metric
    return stats.select("state_fips", "place_fips", F.inline(F.array(*rows)))


@register("city_search", """
    SELECT state_fips, place_fips, place_name FROM sp_places
    WHERE (population >= 100000 OR is_pledged) AND is_pledged
      AND (lower(place_name) LIKE '%00001%')""")
def q_city_search(spark, sf_dir):
    elig = cs.eligible(sp.places(spark, sf_dir))
    return sv.filter_cities(elig, scopes=("vz",), search="00001") \
        .select("state_fips", "place_fips", "place_name")


# ---------------------------------------------------------------------------
# Spatial (J4/G1, G12, G14, O4, A13/G6)
# ---------------------------------------------------------------------------

@register("spatial_assignment", """
    SELECT st_case, CAST(year AS BIGINT) AS year, min(state_fips) AS state_fips,
           min(place_fips) AS place_fips
    FROM sp_pip WHERE n % 2 = 1 AND NOT on_edge GROUP BY st_case, year""")
def q_spatial_assignment(spark, sf_dir):
    """Crash points within the stand-in city polygons (0.05 deg cells)."""
    return sa.assign_points(sp.crash_points(spark, sf_dir), sp.polygon_vertices(spark, sf_dir),
                            ["st_case", "year"], cell=0.05)


@register("place_extents", """
    SELECT state_fips, place_fips, min(x) AS min_lon, max(x) AS max_lon,
           min(y) AS min_lat, max(y) AS max_lat
    FROM sp_vertices WHERE ring = 0 GROUP BY state_fips, place_fips""")
def q_place_extents(spark, sf_dir):
    return sa.extents(sp.polygon_vertices(spark, sf_dir))


@register("part_areas", """
    SELECT state_fips, place_fips, CAST(part AS BIGINT) AS part,
           round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, CAST(1 AS BIGINT) AS n_rings
    FROM sp_edges GROUP BY state_fips, place_fips, part""")
def q_part_areas(spark, sf_dir):
    a = sa.part_areas(sa.largest_part(sp.polygon_vertices(spark, sf_dir)))
    return a.withColumn("area", F.round("area", 6))


@register("region_unions", """
    WITH d AS (
      SELECT n_regionkey, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2
      FROM sp_edges GROUP BY n_regionkey, least(x1, x2), least(y1, y2), greatest(x1, x2),
           greatest(y1, y2) HAVING count(*) = 1)
    SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS target_state, count(*) AS n_edges,
           round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area
    FROM d GROUP BY n_regionkey""")
def q_region_unions(spark, sf_dir):
    """Union of the member polygons of each region."""
    n = sp.table(spark, sf_dir, "nation")
    members = n.select(F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("target_state"),
                       F.lit("00000").alias("target_place"),
                       F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("state_fips"),
                       F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("place_fips"))
    u = ov.polygon_unions(sp.polygon_vertices(spark, sf_dir), members)
    return u.groupBy("target_state").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.round(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2, 6)
         .alias("area"))


# a block's footprints as rectangles of whole units, covered unit squares counted once
CONSOLIDATED_SQL = """
    WITH c AS (SELECT c_custkey // 6 AS block, c_custkey % 6 AS k, ((CAST(floor(c_acctbal) AS BIGINT) % 4) + 4) % 4 AS s FROM customer),
    r AS (SELECT block, 0 AS x0, 0 AS y0, 10 AS x1, 5 AS y1 FROM c WHERE k = 0 OR k = 3
          UNION ALL SELECT block, 0, 0, 5, 10 FROM c WHERE k = 0 OR (k = 3 AND s % 2 = 0)
          UNION ALL SELECT block, s + 4, 3, s + 12, 9 FROM c WHERE k = 1
          UNION ALL SELECT block, 1, 1, 3, 3 FROM c WHERE k = 2
          UNION ALL SELECT block, 10, s, 14, s + 4 FROM c WHERE k = 4
          UNION ALL SELECT block, x0, y0, x1, y1 FROM c, (VALUES (-3, -3, 20, -2), (-3, 13, 20, 16), (-3, -3, -2, 16), (14, -3, 20, 16))
                    AS f(x0, y0, x1, y1) WHERE k = 5),
    q AS (SELECT DISTINCT block, x, y FROM r, unnest(range(x0, x1)) AS a(x), unnest(range(y0, y1)) AS b(y)),
    e AS (SELECT block, 2 * x AS x, 2 * y + 1 AS y FROM q UNION ALL SELECT block, 2 * x + 2, 2 * y + 1 FROM q
          UNION ALL SELECT block, 2 * x + 1, 2 * y FROM q UNION ALL SELECT block, 2 * x + 1, 2 * y + 2 FROM q),
    side AS (SELECT block, x, y FROM e GROUP BY ALL HAVING count(*) = 1),
    around AS (SELECT block, count(*) AS n FROM side GROUP BY block)
    SELECT CAST(block AS BIGINT) AS block, count(*) AS area, any_value(n) AS perimeter, count(*) AS ring_area
    FROM q JOIN around USING (block) GROUP BY block"""


@register("consolidated_unions", CONSOLIDATED_SQL)
def q_consolidated_unions(spark, sf_dir):
    """Unions of overlapping, nested, equal and touching places with holes: area, length of the boundary, and
    area of the assembled rings, in units of 0.01 degree."""
    v = sp.footprints(spark, sf_dir)
    key = ["state_fips", "place_fips"]
    members = v.select("block", *key).distinct()
    e = reliable_checkpoint(ov.union_boundary(ov.directed_edges(v, key).join(members, key), ["block"]))
    unit = F.lit(2 * round(sp.FOOTPRINT_UNIT / ov.UNIT))
    cross = lambda x1, y1, x2, y2: (F.col(x1) / unit * F.col(y2) - F.col(x2) * (F.col(y1) / unit)) / unit / 2
    measured = e.groupBy("block").agg(
        F.round(F.sum(cross("ax", "ay", "bx", "by"))).cast("long").alias("area"),
        F.round(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / unit)).cast("long").alias("perimeter"))
    w = sa.edges(ov.ring_vertices(e, ["block"]), ["block"])
    rings = w.groupBy("block").agg(F.round(F.sum(cross("x1", "y1", "x2", "y2"))).cast("long").alias("ring_area"))
    return measured.join(rings, "block")


# corners stay, and the middle of a border that is further off than the tolerance
SIMPLIFIED_SQL = """
    WITH c AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_fips, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS place_fips,
                      c_custkey % 50 AS col, c_custkey // 50 AS r FROM customer),
    b AS (SELECT state_fips, place_fips, TRUE AS level, col, r + d AS r FROM c, (VALUES (0), (1)) AS s(d)
          UNION ALL SELECT state_fips, place_fips, FALSE, col + d, r FROM c, (VALUES (0), (1)) AS s(d)),
    m AS (SELECT *, CASE WHEN level THEN (7 * col + 13 * r) % 3 ELSE (5 * col + 11 * r) % 3 END AS kind FROM b),
    v AS (SELECT state_fips, place_fips, (col + dx) * 100000 AS x, (r + dy) * 100000 AS y
          FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(dx, dy)
          UNION ALL SELECT state_fips, place_fips, col * 100000 + CASE WHEN level THEN 50000 ELSE 150 END,
                           r * 100000 + CASE WHEN level THEN 150 ELSE 50000 END FROM m WHERE kind = 2)
    SELECT state_fips, place_fips, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM v"""


@register("simplified_borders", SIMPLIFIED_SQL)
def q_simplified_borders(spark, sf_dir):
    """Vertices left of neighbours with common borders, in millionths of a degree, where the tolerance decides."""
    v = ar.simplify_shared(sp.board_places(spark, sf_dir), ex.SIMPLIFY_TOLERANCE)
    return v.select("state_fips", "place_fips", *[F.round(F.col(c) * sp.BOARD_SCALE).cast("long").alias(c) for c in "xy"])


# ---------------------------------------------------------------------------
# Hotspots (A11, W5, G2–G9, U1, E6)
# ---------------------------------------------------------------------------

@register("hotspot_cells", """
    SELECT state_fips, place_fips, cx, cy, crash_count, pct_rank >= 0.85 AS is_hot
    FROM sp_cell_counts""")
def q_hotspot_cells(spark, sf_dir):
    ranked = hs.rank_cells(hs.cell_counts(sp.hotspot_points(spark, sf_dir)))
    return ranked.select("state_fips", "place_fips", "cx", "cy", "crash_count", "is_hot")


def _hot(spark, sf_dir):
    ranked = hs.rank_cells(hs.cell_counts(sp.hotspot_points(spark, sf_dir)))
    return ranked.filter("is_hot").select("state_fips", "place_fips", "cx", "cy")


@register("hotspot_zones", """
    WITH n AS (SELECT state_fips, place_fips, count(*) AS hot_cells FROM sp_hot GROUP BY ALL),
    c AS (SELECT state_fips, place_fips, CAST(sum(x1 * y2 - x2 * y1) * 62500 // 2 AS BIGINT) AS core_area_m2,
                 count(*) AS core_edges FROM sp_core_edges GROUP BY ALL),
    b AS (SELECT state_fips, place_fips, CAST(sum(x1 * y2 - x2 * y1) * 62500 // 2 AS BIGINT) AS buffer_area_m2,
                 count(*) AS buffer_edges FROM sp_buffer_edges GROUP BY ALL)
    SELECT * FROM n JOIN c USING (state_fips, place_fips) JOIN b USING (state_fips, place_fips)""")
def q_hotspot_zones(spark, sf_dir):
    return hs.zone_summary(_hot(spark, sf_dir))


@register("hotspot_features")
def q_hotspot_features(spark, sf_dir):
    """G8 + G9 + U1 (+ E6 rows): one GeoJSON feature per city and zone."""
    return hs.zone_features(_hot(spark, sf_dir))


@register("albers_projection", """
    WITH p AS (SELECT st_case, lon, lat, radians(lat) AS phi, sin(radians(lat)) AS s FROM sp_crashes
               WHERE lon IS NOT NULL AND lat IS NOT NULL)
    SELECT st_case, round(x, 3) AS x_m, round(y, 3) AS y_m, CAST(round(x / 500) AS BIGINT) AS cx,
           CAST(round(y / 500) AS BIGINT) AS cy FROM (
      SELECT st_case, rho * sin(theta) AS x, RHO0 - rho * cos(theta) AS y FROM (
        SELECT st_case, A * sqrt(C - N * ((1 - E2) * (s / (1 - E2 * s * s) - (1 / (2 * E)) *
               ln((1 - E * s) / (1 + E * s))))) / N AS rho, N * radians(lon - (-96.0)) AS theta
        FROM p) t) u""".replace("RHO0", repr(hs.RHO_0)).replace("A *", repr(hs.A_AXIS) + " *")
          .replace("C -", repr(hs.C_CONE) + " -").replace("/ N", "/ " + repr(hs.N_CONE))
          .replace("N *", repr(hs.N_CONE) + " *").replace("E2", repr(hs.E2))
          .replace("(2 * E)", "(2 * " + repr(hs.E) + ")").replace("E * s", repr(hs.E) + " * s"))
def q_albers_projection(spark, sf_dir):
    """G2 + G3: projected metres (mm precision) and 500 m cell ids.  (The
    oracle rounds half-even like rint only away from exact .5 — cell ids of
    exact half-way points never occur with these coordinates.)"""
    pts = hs.project_points(sp.crash_points(spark, sf_dir))
    return pts.select("st_case", F.round("x", 3).alias("x_m"), F.round("y", 3).alias("y_m"),
                      "cx", "cy")


# ---------------------------------------------------------------------------
# Raw files: S1–S3, N1–N8, L1, L2, L5, J1, J2 (files generated once per scale
# into the shared folder from the driver tables, then scanned as text)
# ---------------------------------------------------------------------------

def _raw_crash_outcomes(spark, sf_dir):
    root = rf.ensure_fars_files(spark, sf_dir)
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, root),
                                 sp.city_codes(spark, sf_dir))
    return root, rl.crash_ledger(typed)


_RAW_CRASH_OUT = rl.CRASH_COLUMNS


@register("raw_crash_load", "SELECT " + ", ".join(
    f"strftime({c}, '%Y-%m-%d') AS {c}" if c == "crash_date" else
    (f"CAST({c} AS BIGINT) AS {c}" if c in ("year", "route_code", "total_fatalities") else c)
    for c in _RAW_CRASH_OUT) + " FROM sp_raw_points")
def q_raw_crash_load(spark, sf_dir):
    """S1 + S3 + N1–N7 + J2 + L1: the crash table loaded from the raw files."""
    _, out = _raw_crash_outcomes(spark, sf_dir)
    return rl.inserted(out, _RAW_CRASH_OUT)


@register("raw_crash_outcomes", """
    SELECT CAST(year AS BIGINT) AS year, outcome, reject_reason, count(*) AS n_rows FROM (
      SELECT year, CASE WHEN reason IS NOT NULL THEN 'error' WHEN cp = 0 THEN 'inserted'
                        ELSE 'skipped_duplicate' END AS outcome, reason AS reject_reason
      FROM sp_raw_crash, (SELECT unnest([0, 1]) AS cp) t WHERE cp = 0 OR k % 29 = 0) u
    GROUP BY ALL""")
def q_raw_crash_outcomes(spark, sf_dir):
    """Rows per (year, outcome, reason) of the crash load."""
    _, out = _raw_crash_outcomes(spark, sf_dir)
    return out.groupBy("year", "outcome", "reject_reason").agg(F.sum("n_rows").alias("n_rows"))


@register("load_checks", """
    WITH t AS (SELECT * FROM sp_raw_points),
    o AS (SELECT CASE WHEN reason IS NOT NULL THEN 'error' WHEN cp = 0 THEN 'inserted' ELSE 'skipped_duplicate' END AS outcome
          FROM sp_raw_crash, (SELECT unnest([0, 1]) AS cp) u WHERE cp = 0 OR k % 29 = 0),
    m AS (SELECT 'missing_required_fields' AS "check", count(*) FILTER (WHERE year IS NULL OR st_case IS NULL OR state IS NULL) AS v, TRUE AS blocks FROM t
          UNION ALL SELECT 'date_out_of_range', count(*) FILTER (WHERE crash_date < DATE '1987-01-01' OR crash_date > DATE '2024-12-31'), TRUE FROM t
          UNION ALL SELECT 'negative_fatalities', count(*) FILTER (WHERE total_fatalities < 0), TRUE FROM t
          UNION ALL SELECT 'implausible_fatalities', count(*) FILTER (WHERE total_fatalities > 30), TRUE FROM t
          UNION ALL SELECT 'missing_date', count(*) FILTER (WHERE crash_date IS NULL), FALSE FROM t
          UNION ALL SELECT 'missing_point', count(*) FILTER (WHERE lon IS NULL), FALSE FROM t
          UNION ALL SELECT kind, (SELECT count(*) FROM o WHERE outcome = kind), FALSE
                    FROM (VALUES ('inserted'), ('skipped_existing'), ('skipped_duplicate'), ('error')) AS n(kind))
    SELECT "check", CAST(v AS BIGINT) AS violations, NOT blocks OR v = 0 AS passed FROM m""")
def q_load_checks(spark, sf_dir):
    """What the crash load observes while it writes, and whether its gate lets the batch through."""
    _, out = _raw_crash_outcomes(spark, sf_dir)
    return qa.load_report(spark, out.agg(*qa.load_metrics()).first().asDict())


@register("raw_person_outcomes", """
    SELECT CAST(year AS BIGINT) AS year, outcome, count(*) AS n_rows FROM (
      SELECT year, CASE WHEN NOT has_crash THEN 'skipped_orphan' ELSE 'error' END AS outcome
      FROM sp_raw_person WHERE NOT has_crash OR bad_age
      UNION ALL
      SELECT year, CASE WHEN rn = 1 THEN 'inserted' ELSE 'skipped_duplicate' END
      FROM sp_raw_person_rank) t
    GROUP BY ALL""")
def q_raw_person_outcomes(spark, sf_dir):
    """S2 + N8 + J1 + L2 + L5: person rows per (year, outcome)."""
    root = rf.ensure_fars_files(spark, sf_dir)
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, root),
                                 sp.city_codes(spark, sf_dir))
    persons = rl.person_ledger(rl.normalize_persons(rf.scan_person_files(spark, root)),
                               rl.loaded_keys(typed))
    return persons.groupBy("year", "outcome").agg(F.sum("n_rows").alias("n_rows"))


@register("raw_person_subtypes", """
    SELECT CAST(p.year AS BIGINT) AS year,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (1, 2, 3, 9)) AS motorist_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (5, 10)) AS pedestrian_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (6, 7)) AS cyclist_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (4, 8, 11, 12, 13, 19, 99)) AS other_fatalities,
      count(DISTINCT st_case) AS crashes_with_persons
    FROM sp_raw_person_rank p WHERE rn = 1 GROUP BY p.year""")
def q_raw_person_subtypes(spark, sf_dir):
    """A1 over the persons loaded from the raw files, summed per year."""
    root = rf.ensure_fars_files(spark, sf_dir)
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, root),
                                 sp.city_codes(spark, sf_dir))
    persons = rl.person_ledger(rl.normalize_persons(rf.scan_person_files(spark, root)),
                               rl.loaded_keys(typed))
    loaded = persons.filter(F.col("outcome") == "inserted")
    counts = st.crash_subtype_counts(loaded, ["st_case", "year"])
    return counts.groupBy("year").agg(
        *[F.sum(c).alias(c) for c in st.SUBTYPE_COLS],
        F.count(F.lit(1)).alias("crashes_with_persons"))


@register("dataset_presence", """
    SELECT CAST(year AS BIGINT) AS year, CAST(1 AS BIGINT) AS crash_files,
           CAST(CASE WHEN year = 2001 THEN 0 ELSE 1 END AS BIGINT) AS person_files,
           true AS loads_crashes, year <> 2001 AS loads_persons
    FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders) t""")
def q_dataset_presence(spark, sf_dir):
    """S3: which dataset files each year has, and what loads."""
    root = rf.ensure_fars_files(spark, sf_dir)
    return rf.dataset_presence(rf.dataset_files(spark, root))


# ---------------------------------------------------------------------------
# City-side files: S5–S9, N9–N12, L3, L4, L7, J9–J12, A12, U3, O4
# ---------------------------------------------------------------------------

def _place_root(spark, sf_dir):
    return pf.ensure_place_files(spark, sf_dir)


@register("population_load", """
    SELECT state_fips, place_fips, c_name AS place_name, state_label AS state_name,
           CAST(population AS BIGINT) AS population FROM sp_pcust""")
def q_population_load(spark, sf_dir):
    """S5 + N9 + L4: population rows loaded (first wins per place)."""
    out = pl.load_populations(pf.scan_populations(spark, _place_root(spark, sf_dir)))
    return out.filter(F.col("outcome") == "inserted").select(
        "state_fips", "place_fips", "place_name", "state_name", "population")


@register("population_outcomes", """
    SELECT 'inserted' AS outcome, count(*) AS n_rows FROM sp_pcust
    UNION ALL SELECT 'skipped_duplicate', count(*) FROM sp_pcust WHERE c % 47 = 0""")
def q_population_outcomes(spark, sf_dir):
    out = pl.load_populations(pf.scan_populations(spark, _place_root(spark, sf_dir)))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


@register("city_points", "SELECT * FROM sp_city_points")
def q_city_points(spark, sf_dir):
    """S6 + N12 + L7: places after the point write-back (those with a point)."""
    resolved = pl.resolve_points(spark, pf.scan_city_points(spark, _place_root(spark, sf_dir)))
    places = sp.places(spark, sf_dir)
    out = pl.apply_points(places, resolved)
    return out.filter(F.col("point_source").isNotNull()).select(
        "state_fips", "place_fips", "point_lon", "point_lat", "point_source")


@register("pledged_places", """
    SELECT state_fips, place_fips FROM sp_pcust
    WHERE c_mktsegment = 'BUILDING' AND c % 19 <> 0 AND real_state IS NOT NULL""")
def q_pledged_places(spark, sf_dir):
    """S7 + N10 + L7: places flagged pledged from the list."""
    pledges = pl.canonical_pledges(spark, pf.scan_pledged(spark, _place_root(spark, sf_dir)))
    places = sp.places(spark, sf_dir).drop("is_pledged")
    return pl.apply_pledges(places, pledges).filter("is_pledged") \
        .select("state_fips", "place_fips")


@register("unmatched_pledges", """
    SELECT c_name AS city_name, state_label AS state_name, 'ERROR' AS state_fips FROM sp_pcust
    WHERE c_mktsegment = 'BUILDING' AND c % 19 <> 0 AND real_state IS NULL
    UNION ALL SELECT * FROM (VALUES ('Washington', 'District of Columbia', '11'),
        ('Fort Lauderdale', 'Florida', '12'), ('Macon-Bibb County', 'Georgia', '13'),
        ('New York', 'New York', '36'), ('Springfield', 'Atlantis', 'ERROR')) t(a, b, c)""")
def q_unmatched_pledges(spark, sf_dir):
    """Pledged-list entries that match no place."""
    pledges = pl.canonical_pledges(spark, pf.scan_pledged(spark, _place_root(spark, sf_dir)))
    return pl.unmatched_pledges(sp.places(spark, sf_dir), pledges)


@register("city_code_load", f"""
    SELECT {osql.zf('n_nationkey', 2)} AS state_code, {osql.zf('n_nationkey * 37', 4)} AS fars_city_code,
           n_name AS fars_city_name,
           CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS source_rows
    FROM nation""")
def q_city_code_load(spark, sf_dir):
    """S8 + L4: the city-code table, one name per code."""
    return pl.load_city_codes(pf.scan_city_codes(spark, _place_root(spark, sf_dir)))


@register("boundary_places", """
    SELECT v.state_fips, v.place_fips, s.state_name, n.n_name AS display_name, '25' AS place_type,
           CAST(4 * count(*) AS BIGINT) AS n_vertices,
           round(abs(sum(e.x1 * e.y2 - e.x2 * e.y1)) / 2, 6) AS area
    FROM sp_vertices v JOIN nation n ON v.place_fips = lpad(CAST(n.n_nationkey AS VARCHAR), 5, '0')
    JOIN sp_edges e ON e.place_fips = v.place_fips AND e.seq = v.seq
    LEFT JOIN sp_states s ON s.state_fips = v.state_fips
    GROUP BY ALL""")
def q_boundary_places(spark, sf_dir):
    """S9 + L3 + N11 + O4 + G14: loaded boundaries, largest part only."""
    v = pf.scan_boundaries(spark, _place_root(spark, sf_dir))
    places = pl.load_boundaries(spark, v)
    kept = sa.largest_part(pl.boundary_vertices(v, places))
    area = sa.part_areas(kept).select("state_fips", "place_fips",
                                     F.round("area", 6).alias("area"))
    nv = kept.groupBy("state_fips", "place_fips").agg(F.count(F.lit(1)).alias("n_vertices"))
    return places.select("state_fips", "place_fips", "state_name", "display_name", "place_type") \
        .join(nv, ["state_fips", "place_fips"]).join(area, ["state_fips", "place_fips"])


@register("mismatched_city_names", """
    SELECT DISTINCT fars_city_name AS city_name, state_name FROM (
        SELECT fars_city_name, state_name FROM sp_crashes
        WHERE fars_city_name IS NOT NULL AND TRY_CAST(city AS INTEGER) <> 0
        GROUP BY ALL HAVING count(*) >= 50) f
    WHERE NOT EXISTS (SELECT 1 FROM sp_pcust p WHERE upper(p.c_name) = f.fars_city_name
                      AND p.state_label = f.state_name)""")
def q_mismatched_city_names(spark, sf_dir):
    """J9 + A12 + U3: frequent FARS city names with no population place."""
    pops = pl.load_populations(pf.scan_populations(spark, _place_root(spark, sf_dir))) \
        .filter(F.col("outcome") == "inserted")
    return pl.mismatched_city_names(sp.loaded_crashes(spark, sf_dir), pops)


@register("eligible_without_boundary", f"""
    SELECT e.state_fips, e.place_fips FROM sp_elig_cities e
    WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE {osql.zf('n.n_nationkey', 2)} = e.state_fips
                      AND {osql.zf('n.n_nationkey', 5)} = e.place_fips)""")
def q_eligible_without_boundary(spark, sf_dir):
    """Eligible cities with no loaded boundary."""
    v = pf.scan_boundaries(spark, _place_root(spark, sf_dir))
    places = pl.load_boundaries(spark, v)
    elig = cs.eligible(sp.places(spark, sf_dir)).select("state_fips", "place_fips")
    return pl.eligible_without_boundary(elig, places)


@register("geocode_candidates", """
    SELECT p.state_fips, p.place_fips, p.place_name, s.state_name FROM sp_places p
    JOIN sp_pcust c ON c.state_fips = p.state_fips AND c.place_fips = p.place_fips
    LEFT JOIN sp_states s ON s.state_fips = p.state_fips
    WHERE c.population > 100000 AND NOT ((c.c % 7 = 0 AND c.c % 3 = 0) OR (c.c % 7 <> 0 AND c.c % 13 <> 0))""")
def q_geocode_candidates(spark, sf_dir):
    """Places over 100000 people still without a point (work list)."""
    resolved = pl.resolve_points(spark, pf.scan_city_points(spark, _place_root(spark, sf_dir)))
    places = sp.places(spark, sf_dir)
    return pl.geocode_candidates(places, places, resolved)


# ---------------------------------------------------------------------------
# Sinks: E1–E6, A17, G9, G10 (each query writes a fresh export folder in the
# shared folder, then reads the files back)
# ---------------------------------------------------------------------------

def _export_dir(spark):
    import uuid
    return f"{shared_dir(spark)}/roadstats_exports/{uuid.uuid4().hex}"


def _ranked_places(spark, sf_dir):
    resolved = pl.resolve_points(spark, pf.scan_city_points(spark, _place_root(spark, sf_dir)))
    places = pl.apply_points(sp.places(spark, sf_dir), resolved)
    stats = cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir))
    return places, rk.ranked_eligible(stats)


@register("export_metadata", """
    SELECT CAST(min(year) AS BIGINT) AS min_year, CAST(max(year) AS BIGINT) AS max_year
    FROM sp_crashes""")
def q_export_metadata(spark, sf_dir):
    """crashes_metadata written and read back."""
    path = ex.write_crashes_metadata(sp.crash_points(spark, sf_dir), _export_dir(spark))
    return spark.read.schema("min_year long, max_year long").json(path)


def _city_export_sql() -> str:
    cols = []
    for c in ex.CITY_EXPORT_COLS:
        if c in ("place_name", "state_fips", "place_fips", "is_pledged"):
            cols.append(f"r.{c}")
        elif c == "display_name":
            cols.append("r.place_name AS display_name")
        elif c == "state_name":
            cols.append("s.state_name")
        elif c == "population":
            cols.append("CAST(r.population AS BIGINT) AS population")
        elif c == "lon":
            cols.append("pt.point_lon AS lon")
        elif c == "lat":
            cols.append("pt.point_lat AS lat")
        else:
            cols.append(f"r.{c}")
    return ("SELECT " + ", ".join(cols) + " FROM sp_ranked r "
            "LEFT JOIN sp_states s ON s.state_fips = r.state_fips "
            "LEFT JOIN sp_city_points pt ON pt.state_fips = r.state_fips "
            "AND pt.place_fips = r.place_fips")


@register("export_cities", _city_export_sql())
def q_export_cities(spark, sf_dir):
    """E2 (+ J6, F1, O2): cities.json rows written and read back."""
    places, ranked = _ranked_places(spark, sf_dir)
    cities = ex.city_export(places, ranked)
    path = ex.write_cities(cities, _export_dir(spark))
    return spark.read.schema(cities.schema).json(path)


@register("export_annual", "SELECT state_fips, place_fips, CAST(year AS BIGINT) AS year, "
          + ", ".join(sv.ANNUAL_COLS) + " FROM sp_annual_city")
def q_export_annual(spark, sf_dir):
    """annual_fatalities per city folder, read back."""
    annual = sv.annual_fatalities(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    path = ex.write_annual(annual, _export_dir(spark))
    return ex.read_folders(spark, path, annual.schema, ("state_fips", "place_fips"))


@register("export_crash_files", "SELECT " + ", ".join(
    f"strftime({c}, '%Y-%m-%d') AS {c}" if c == "crash_date" else
    (f"CAST({c} AS BIGINT) AS {c}" if c in ("year",) + sv.ANNUAL_COLS else c)
    for c in _EXPORT_OUT) + " FROM sp_export_points")
def q_export_crash_files(spark, sf_dir):
    """E5: crash points per (city, year) folder, read back."""
    pts = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    path = ex.write_crash_points(pts, _export_dir(spark))
    return ex.read_folders(spark, path, pts.schema, ("state_fips", "place_fips")).select(*_EXPORT_OUT)


@register("export_empty_slots", """
    WITH mx AS (SELECT max(year) AS m FROM sp_crashes)
    SELECT e.state_fips, e.place_fips, CAST(y.year AS BIGINT) AS year
    FROM sp_elig_cities e, (SELECT unnest(range(2001, (SELECT m FROM mx) + 1)) AS year) y
    WHERE NOT EXISTS (SELECT 1 FROM sp_export_points p WHERE p.state_fips = e.state_fips
                      AND p.place_fips = e.place_fips AND p.year = y.year)""")
def q_export_empty_slots(spark, sf_dir):
    """E5 coverage: (city, year) slots from 2001 with no crash file."""
    crashes = sp.loaded_crashes(spark, sf_dir)
    elig = cs.eligible(sp.places(spark, sf_dir))
    pts = sv.export_crash_points(crashes, elig)
    max_year = sv.year_extent(sp.crash_points(spark, sf_dir)).first()["max_year"]
    slots = ex.empty_slots(pts, elig, max_year)
    path = ex.write_empty_slots(slots, _export_dir(spark))
    return spark.read.schema(slots.schema).json(path)


@register("export_boundaries", """
    SELECT state_fips, place_fips, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS ring,
           CAST(7 AS BIGINT) AS n_points FROM sp_vertices WHERE seq = 0
    UNION ALL
    SELECT state_fips, place_fips, 1, 0, 5 FROM sp_vertices
    WHERE seq = 0 AND CAST(place_fips AS INTEGER) % 4 = 0""")
def q_export_boundaries(spark, sf_dir):
    """E3 + G10 + G9: simplified boundary GeoJSON per city, read back and
    counted per part and ring (closing point included)."""
    v = pf.scan_boundaries(spark, _place_root(spark, sf_dir))
    places = pl.load_boundaries(spark, v)
    path = ex.write_boundaries(pl.boundary_vertices(v, places), places, _export_dir(spark))
    back = spark.read.schema("value string, state_fips string, place_fips string").text(path)
    g = back.select("state_fips", "place_fips",
                    F.get_json_object("value", "$.geometry.type").alias("t"),
                    F.get_json_object("value", "$.geometry.coordinates").alias("c"))
    parts = F.when(F.col("t") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))) \
        .otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    p = g.select("state_fips", "place_fips", F.posexplode(parts).alias("part", "rings"))
    r = p.select("state_fips", "place_fips", "part", F.posexplode("rings").alias("ring", "pts"))
    return r.select("state_fips", "place_fips", "part", "ring", F.size("pts").alias("n_points"))


@register("export_hotspots", """
    SELECT DISTINCT place_fips, z.zone_type FROM sp_hot,
           (VALUES ('core'), ('buffer')) z(zone_type)""")
def q_export_hotspots(spark, sf_dir):
    """Hotspot features written one per line and read back."""
    path = ex.write_hotspots(_hot(spark, sf_dir), _export_dir(spark))
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.properties.place_fips").alias("place_fips"),
                       F.get_json_object("value", "$.properties.zone_type").alias("zone_type"))


@register("export_sizes")
def q_export_sizes(spark, sf_dir):
    """Files and bytes per sink after writing E1, E2 and E4."""
    out = _export_dir(spark)
    ex.write_crashes_metadata(sp.crash_points(spark, sf_dir), out)
    places, ranked = _ranked_places(spark, sf_dir)
    ex.write_cities(ex.city_export(places, ranked), out)
    ex.write_annual(sv.annual_fatalities(sp.loaded_crashes(spark, sf_dir),
                                         cs.eligible(sp.places(spark, sf_dir))), out)
    return ex.export_sizes(spark, out)


# ---------------------------------------------------------------------------
# Serving projections: A15, W6, F7, O2/O3, O6/U2, G11 + A16 + G13
# ---------------------------------------------------------------------------

@register("ranked_totals", " UNION ALL ".join(
    f"SELECT '{c}' AS rank_column, count({c}) AS n_ranked FROM sp_ranked"
    for c in rk.RANK_COLS + rk.RANK_VZ_COLS))
def q_ranked_totals(spark, sf_dir):
    """Cities holding each rank."""
    return rk.ranked_totals(ranked_city_stats(spark, sf_dir))


def _better_sql() -> str:
    parts = []
    for m, b in rk.RANK_BASES.items():
        for scope in ("all", "vz"):
            rc, pc = f"rank_{b}_{scope}", f"pct_{b}_{scope}"
            parts.append(
                f"SELECT r.state_fips, r.place_fips, '{m}' AS metric, '{scope}' AS scope, "
                f"CAST(r.{rc} AS BIGINT) AS rank, t.n AS n_ranked, "
                f"CASE WHEN r.{pc} IS NOT NULL THEN CAST((10005 - CAST(round(r.{pc} * 100) AS BIGINT)) // 10 AS DOUBLE) / 10 END AS better_than_pct, "
                f"CASE WHEN r.{rc} IS NOT NULL THEN '#' || CAST(r.{rc} AS VARCHAR) || ' of ' || CAST(t.n AS VARCHAR) END AS rank_label, "
                f"r.population < 100000 AS small_population "
                f"FROM sp_ranked r, (SELECT count({rc}) AS n FROM sp_ranked) t")
    return " UNION ALL ".join(parts)


@register("better_than", _better_sql())
def q_better_than(spark, sf_dir):
    """W6: "better than X %", "#rank of n", small-population flag."""
    return rk.better_than(ranked_city_stats(spark, sf_dir))


def _long_form_sql() -> str:
    parts = []
    for vt in ("all",) + sv.VICTIM_TYPES:
        s = "" if vt == "all" else f"_{vt}"
        avg = "avg_fatalities_5yr" if vt == "all" else f"avg_5yr{s}"
        rate = "avg_per_100k_5yr" if vt == "all" else f"avg_per_100k{s}"
        for scope in ("all", "vz"):
            parts.append(
                f"SELECT state_fips, place_fips, '{vt}' AS victim_type, '{scope}' AS scope, "
                f"{avg} AS avg_5yr, {rate} AS per_100k, trend_pct_change{s} AS trend_pct, "
                f"CAST(rank_per_100k{s}_{scope} AS BIGINT) AS rank_per_100k, "
                f"pct_per_100k{s}_{scope} AS pct_per_100k, "
                f"CAST(rank_trend{s}_{scope} AS BIGINT) AS rank_trend, "
                f"pct_trend{s}_{scope} AS pct_trend FROM sp_ranked")
    return " UNION ALL ".join(parts)


@register("metric_long_form", _long_form_sql())
def q_metric_long_form(spark, sf_dir):
    """metric columns by victim type and scope, long form."""
    return sv.metric_long_form(ranked_city_stats(spark, sf_dir))


@register("sorted_cities", """
    SELECT state_fips, place_fips, avg_per_100k_5yr,
           row_number() OVER (ORDER BY avg_per_100k_5yr DESC NULLS LAST, state_fips, place_fips)
             AS position
    FROM sp_eligible""")
def q_sorted_cities(spark, sf_dir):
    """O2/O3: city table sorted by per-capita rate, descending, nulls last."""
    stats = cs.eligible(cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir)))
    # one row per eligible city: checkpointed so the sort reads it once
    pos = sv.sort_positions(reliable_checkpoint(stats), "perCapita", ascending=False)
    return pos.select("state_fips", "place_fips", "avg_per_100k_5yr", "position")


@register("recent_crash_points", """
    SELECT state_fips, place_fips, st_case, CAST(year AS BIGINT) AS year FROM sp_export_points
    WHERE year > (SELECT max(year) FROM sp_crashes) - 5""")
def q_recent_crash_points(spark, sf_dir):
    """The latest five calendar years of the exported points."""
    pts = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    max_year = sv.year_extent(sp.crash_points(spark, sf_dir)).first()["max_year"]
    return sv.recent_years(pts, max_year).select("state_fips", "place_fips", "st_case", "year")


@register("city_clusters", """
    WITH c AS (
      SELECT p.state_fips, p.place_fips, p.place_name AS name, p.population, p.is_pledged,
             pt.point_lon AS lon, pt.point_lat AS lat
      FROM sp_places p JOIN sp_city_points pt USING (state_fips, place_fips)
      WHERE p.population >= 100000 OR p.is_pledged),
    z AS (SELECT c.*, zz.zoom, CAST(256 AS DOUBLE) * pow(2.0, zz.zoom) AS scale
          FROM c, (SELECT unnest(range(0, 15)) AS zoom) zz),
    b AS (SELECT z.*, CAST(floor((lon + 180.0) / 360.0 * scale / 40) AS BIGINT) AS cx,
                 CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0
                            * scale / 40) AS BIGINT) AS cy FROM z),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY zoom, cx, cy
                 ORDER BY population DESC, state_fips DESC, place_fips DESC) AS rn FROM b)
    SELECT CAST(zoom AS BIGINT) AS zoom, cx, cy, count(*) AS n_cities, bool_or(is_pledged) AS any_pledged,
           max(CASE WHEN rn = 1 THEN name END) AS largest_city,
           min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat,
           CASE WHEN max(CASE WHEN rn = 1 THEN name END) = 'San Jose' THEN 'Bay Area'
                ELSE max(CASE WHEN rn = 1 THEN name END) || ' Region' END AS region_name
    FROM r GROUP BY zoom, cx, cy""")
def q_city_clusters(spark, sf_dir):
    """G11 + A16 + G13: zoom-level clusters of eligible city points."""
    resolved = pl.resolve_points(spark, pf.scan_city_points(spark, _place_root(spark, sf_dir)))
    places = pl.apply_points(sp.places(spark, sf_dir), resolved)
    cities = cs.eligible(places).filter(F.col("point_lon").isNotNull()) \
        .withColumnRenamed("point_lon", "lon").withColumnRenamed("point_lat", "lat")
    return sv.city_clusters(cities)


# ---------------------------------------------------------------------------
# Idempotent incremental load (batch manifest form, then streaming form)
# ---------------------------------------------------------------------------

@register("incremental_reload", """
    WITH f AS (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders),
         r AS (SELECT count(*) AS n FROM sp_raw_loaded)
    SELECT 'batch' AS form, CAST(1 AS BIGINT) AS run, f.n AS new_files, r.n AS rows_added, r.n AS table_rows FROM f, r
    UNION ALL SELECT 'batch', 2, 0, 0, r.n FROM r
    UNION ALL SELECT 'stream', 1, f.n, r.n, r.n FROM f, r
    UNION ALL SELECT 'stream', 2, 0, 0, r.n FROM r""")
def q_incremental_reload(spark, sf_dir):
    """Load every crash file twice (batch manifest, then an availableNow
    stream); the second run of each finds no new file and adds nothing."""
    from roadstats.streaming import incremental as inc
    root = rf.ensure_fars_files(spark, sf_dir)
    codes = sp.city_codes(spark, sf_dir)
    base = _export_dir(spark)
    rows = []
    for run in (1, 2):
        r = inc.load_new_files(spark, root, f"{base}/batch_crashes", codes)
        n = inc.read_table(spark, f"{base}/batch_crashes").count()
        rows.append(("batch", run, r["new_files"], r["rows_added"], n))
    for run in (1, 2):
        r = inc.stream_new_files(spark, root, f"{base}/stream_crashes", codes,
                                 f"{base}/stream_checkpoint")
        n = inc.read_table(spark, f"{base}/stream_crashes").count()
        rows.append(("stream", run, r["new_files"], r["rows_added"], n))
    return spark.createDataFrame(
        rows, "form string, run long, new_files long, rows_added long, table_rows long")


# ---------------------------------------------------------------------------
# O1 on its own, J4 write-back (L7), state-mismatch diagnostic,
# end-to-end hotspot cells from projected crash points
# ---------------------------------------------------------------------------

@register("year_windows", """
    SELECT CAST(year AS BIGINT) AS year, is_recent, is_previous FROM sp_years""")
def q_year_windows(spark, sf_dir):
    """O1: the ten latest years, flagged recent / previous five."""
    return cs.year_windows(sp.crash_points(spark, sf_dir))


def _polygon_places(spark, sf_dir):
    return sp.polygon_vertices(spark, sf_dir).select(
        "state_fips", "place_fips", F.col("place_name").alias("display_name")).distinct()


def _assignment(spark, sf_dir):
    return sa.assign_points(sp.crash_points(spark, sf_dir), sp.polygon_vertices(spark, sf_dir),
                            ["st_case", "year"], cell=0.05)


CTES_ASSIGN = """
    WITH a AS (SELECT st_case, year, min(state_fips) AS state_fips, min(place_fips) AS place_fips
               FROM sp_pip WHERE n % 2 = 1 AND NOT on_edge GROUP BY st_case, year)"""


@register("crash_place_enrichment", CTES_ASSIGN + f"""
    SELECT c.st_case, CAST(c.year AS BIGINT) AS year, c.state,
           CASE WHEN a.st_case IS NOT NULL THEN a.place_fips ELSE c.place_fips END AS place_fips,
           CASE WHEN a.st_case IS NOT NULL THEN n.n_name ELSE c.fips_city_name END AS fips_city_name
    FROM sp_crashes c LEFT JOIN a ON a.st_case = c.st_case AND a.year = c.year
    LEFT JOIN nation n ON {osql.zf('n.n_nationkey', 5)} = a.place_fips""")
def q_crash_place_enrichment(spark, sf_dir):
    """J4 + L7: every crash after the spatial write-back of place and name."""
    crashes = sp.loaded_crashes(spark, sf_dir)
    out = sa.enrich_crash_locations(crashes, _assignment(spark, sf_dir),
                                    _polygon_places(spark, sf_dir))
    return out.select("st_case", "year", "state", "place_fips", "fips_city_name")


@register("state_mismatch", CTES_ASSIGN + """
    SELECT c.state AS crash_state, a.state_fips AS polygon_state, count(*) AS n_crashes
    FROM sp_crashes c JOIN a ON a.st_case = c.st_case AND a.year = c.year
    WHERE c.state <> a.state_fips GROUP BY ALL""")
def q_state_mismatch(spark, sf_dir):
    """Diagnostic for §8 Q6: crashes assigned to a polygon of another state."""
    crashes = sp.loaded_crashes(spark, sf_dir).select("st_case", "year", "state")
    a = _assignment(spark, sf_dir)
    return (crashes.join(a, ["st_case", "year"]).filter(F.col("state") != F.col("state_fips"))
            .groupBy(F.col("state").alias("crash_state"), F.col("state_fips").alias("polygon_state"))
            .agg(F.count(F.lit(1)).alias("n_crashes")))


def _projected_cells_sql() -> str:
    x, y = osql.albers_xy_sql("lon", "lat")
    return f"""
    WITH p AS (SELECT state_fips, place_fips, CAST(round({x} / 500) AS BIGINT) AS cx,
                      CAST(round({y} / 500) AS BIGINT) AS cy FROM sp_export_points),
    c AS (SELECT state_fips, place_fips, cx, cy, count(*) AS crash_count FROM p GROUP BY ALL)
    SELECT *, percent_rank() OVER (PARTITION BY state_fips, place_fips ORDER BY crash_count) >= 0.85
              AS is_hot FROM c"""


@register("hotspot_cells_projected", _projected_cells_sql())
def q_hotspot_cells_projected(spark, sf_dir):
    """J7 + F6 + G2 + G3 + A11 + W5 from the crash points of eligible cities."""
    pts = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    ranked = hs.rank_cells(hs.cell_counts(hs.project_points(pts)))
    return ranked.select("state_fips", "place_fips", "cx", "cy", "crash_count", "is_hot")


@register("crash_preview", """
    SELECT st_case, CAST(year AS BIGINT) AS year, strftime(crash_date, '%Y-%m-%d') AS crash_date,
           state, place_fips, lon, lat FROM sp_crashes ORDER BY st_case, year LIMIT 5""")
def q_crash_preview(spark, sf_dir):
    """S10 (preview part): the first five crashes in key order."""
    c = sp.loaded_crashes(spark, sf_dir).select(
        "st_case", "year", "crash_date", "state", "place_fips", "lon", "lat")
    return qa.table_preview(c, ["st_case", "year"], 5)


@register("city_stats_filled_years", """
    WITH w AS (SELECT count(*) FILTER (WHERE is_recent) AS nr,
                      count(*) FILTER (WHERE is_previous) AS np FROM sp_years),
    s AS (SELECT a.state_fips, a.place_fips,
                 CAST(sum(a.fatalities) FILTER (WHERE y.is_recent) AS BIGINT) AS sr,
                 CAST(sum(a.fatalities) FILTER (WHERE y.is_previous) AS BIGINT) AS sp
          FROM sp_annual a JOIN sp_years y USING (year) GROUP BY ALL),
    r AS (SELECT s.state_fips, s.place_fips,
                 """ + osql.hu("coalesce(sr, 0)", "w.nr", 2) + """ AS avg_fatalities_5yr,
                 """ + osql.hu("(coalesce(sr, 0) * 100000)", "(CAST(p.population AS BIGINT) * w.nr)", 2)
          + """ AS avg_per_100k_5yr,
                 CASE WHEN coalesce(sp, 0) > 0 THEN """
          + osql.hu("(100 * (coalesce(sr, 0) * w.np - coalesce(sp, 0) * w.nr))",
                    "(coalesce(sp, 0) * w.nr)", 1) + """ END AS trend_pct_change
          FROM s JOIN sp_places p ON p.state_fips = s.state_fips AND p.place_fips = s.place_fips
               AND p.population > 0, w)
    SELECT p.state_fips, p.place_fips,
           CASE WHEN (p.population >= 100000 OR p.is_pledged) AND r.avg_per_100k_5yr IS NULL
                THEN CAST(0 AS DOUBLE) ELSE r.avg_fatalities_5yr END AS avg_fatalities_5yr,
           CASE WHEN (p.population >= 100000 OR p.is_pledged) AND r.avg_per_100k_5yr IS NULL
                THEN CAST(0 AS DOUBLE) ELSE r.avg_per_100k_5yr END AS avg_per_100k_5yr,
           r.trend_pct_change
    FROM sp_places p LEFT JOIN r ON p.state_fips = r.state_fips AND p.place_fips = r.place_fips""")
def q_city_stats_filled_years(spark, sf_dir):
    """A4–A7 with the Q4 option: crash-free window years count as zeros."""
    stats = cs.city_stats(sp.loaded_crashes(spark, sf_dir), sp.places(spark, sf_dir),
                          fill_years=True)
    return stats.select("state_fips", "place_fips", "avg_fatalities_5yr", "avg_per_100k_5yr",
                        "trend_pct_change")


def _zone_lonlat_sql() -> str:
    ctes, out = osql.albers_inverse_ctes("zv")
    return ("WITH zv AS (SELECT DISTINCT state_fips, place_fips, CAST(x1 * 250 AS DOUBLE) AS x, "
            "CAST(y1 * 250 AS DOUBLE) AS y FROM sp_core_edges),\n" + ctes +
            f"\nSELECT state_fips, place_fips, x AS x_m, y AS y_m, round(lon, 7) AS lon, "
            f"round(lat, 7) AS lat FROM {out}")


@register("hotspot_zone_vertices", _zone_lonlat_sql())
def q_hotspot_zone_vertices(spark, sf_dir):
    """G4 + G5 + G8: vertices of the dissolved core zones, back in lon/lat."""
    e = hs.core_edges(_hot(spark, sf_dir))
    v = e.select("state_fips", "place_fips", (F.col("x1") * hs.SUB_M).cast("double").alias("x"),
                 (F.col("y1") * hs.SUB_M).cast("double").alias("y")).distinct()
    out = hs.with_albers_inverse(v, "x", "y", "lon", "lat")
    return out.select("state_fips", "place_fips", F.col("x").alias("x_m"), F.col("y").alias("y_m"),
                      F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def _raw_profile_sql() -> str:
    eras = {"early": "year < 1997", "route": "year >= 1997 AND year % 2 = 1",
            "named": "year >= 1997 AND year % 2 = 0"}
    cols = {"ST_CASE": ("all", "FALSE"), "STATE": ("all", "FALSE"), "COUNTY": ("all", "FALSE"),
            "CITY": ("all", "FALSE"), "FATALS": ("all", "FALSE"), "YEAR": ("all", "FALSE"),
            "MONTH": ("all", "FALSE"), "DAY": ("all", "FALSE"),
            "LATITUDE": ("all", "lat IS NULL OR k % 4 = 3"), "LONGITUD": ("all", "lat IS NULL"),
            "ROUTE": ("route_named", "k % 97 = 0"), "STATENAME": ("named", "r = 40"),
            "COUNTYNAME": ("named", "FALSE"), "CITYNAME": ("named", "r = 45")}
    where = {"all": "TRUE", "route_named": "year >= 1997", "named": eras["named"]}
    rows = ("(SELECT *, 1 + CAST(k % 29 = 0 AS INTEGER) AS copies FROM sp_raw_crash) t")
    parts = [f"SELECT CAST(year AS BIGINT) AS year, '{c}' AS column_name, "
             f"CAST(sum(copies) AS BIGINT) AS row_count, "
             f"CAST(sum(CASE WHEN {cond} THEN copies ELSE 0 END) AS BIGINT) AS null_count "
             f"FROM {rows} WHERE {where[w]} GROUP BY year" for c, (w, cond) in cols.items()]
    return " UNION ALL ".join(parts)


@register("raw_file_profile", _raw_profile_sql())
def q_raw_file_profile(spark, sf_dir):
    """S10 over the raw crash files: rows and blank cells per file and column."""
    root = rf.ensure_fars_files(spark, sf_dir)
    return qa.file_profile(rf.scan_crash_files(spark, root), rf.CRASH_FIELDS)


@register("hotspot_feature_edges", """
    SELECT state_fips, place_fips, 'core' AS zone_type, count(*) AS n_edges
    FROM sp_core_edges GROUP BY ALL
    UNION ALL
    SELECT state_fips, place_fips, 'buffer' AS zone_type, count(*) AS n_edges
    FROM sp_buffer_edges GROUP BY ALL""")
def q_hotspot_feature_edges(spark, sf_dir):
    """G5 + G7 + G9 + U1 checked through the assembled GeoJSON: every ring
    keeps its lattice vertices, so coordinates minus closing points per
    feature equals the dissolved boundary edges."""
    f = hs.zone_features(_hot(spark, sf_dir))
    g = f.select("state_fips", "place_fips", "zone_type",
                 F.get_json_object("feature", "$.geometry.type").alias("t"),
                 F.get_json_object("feature", "$.geometry.coordinates").alias("c"))
    parts = F.when(F.col("t") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))) \
        .otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    rings = g.select("state_fips", "place_fips", "zone_type", F.explode(parts).alias("p")) \
        .select("state_fips", "place_fips", "zone_type", F.explode("p").alias("r"))
    return rings.groupBy("state_fips", "place_fips", "zone_type").agg(
        F.sum(F.size("r") - 1).cast("long").alias("n_edges"))


# queries over tables with defects and over the raw text of the sinks
from roadstats.plans import written_queries  # noqa: E402,F401
