"""Serving-side projections over the derived tables (J7, J13, A9, A10, A16,
F2–F7, O2, O3, O6, G11, G13, N12).

The dashboard computed these per selected city in the browser; here each is
a set-based DataFrame over all cities at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.operators.city_stats import CITY_KEY

EXPORT_CRASH_COLS = ("lon", "lat", "st_case", "year", "crash_date", "state_name",
                     "fars_city_name", "fips_city_name", "road_label", "total_fatalities",
                     "motorist_fatalities", "pedestrian_fatalities", "cyclist_fatalities",
                     "other_fatalities")
ANNUAL_COLS = ("total_fatalities", "motorist_fatalities", "pedestrian_fatalities",
               "cyclist_fatalities", "other_fatalities")
VICTIM_TYPES = ("pedestrian", "cyclist", "motorist")
# FIXED VALUES: cluster display-name overrides.
CLUSTER_NAME_OVERRIDES = [("San Jose", "Bay Area")]


def _city_join(crashes: DataFrame, cities: DataFrame) -> DataFrame:
    """crashes ⋈ cities on (state, place_fips).  The city side is the
    eligible-city table; Spark/AQE broadcast it only when its measured size
    is under the broadcast threshold, otherwise both sides shuffle on key."""
    c = cities.select(*CITY_KEY)
    return crashes.join(c, (crashes["state"] == c["state_fips"])
                        & (crashes["place_fips"] == c["place_fips"]), "inner") \
        .drop(c["place_fips"])


def export_crash_points(crashes: DataFrame, cities: DataFrame, min_year: int = 2001) -> DataFrame:
    """J7 + F6: located crashes of eligible cities from ``min_year`` on, with
    the 14 exported columns plus the city key (for partitioned sinks)."""
    located = crashes.filter((F.col("year") >= min_year) & F.col("lon").isNotNull()
                             & F.col("lat").isNotNull())
    j = _city_join(located, cities)
    return j.select("state_fips", "place_fips", *EXPORT_CRASH_COLS)


def annual_fatalities(crashes: DataFrame, cities: DataFrame) -> DataFrame:
    """Five fatality sums per eligible city and year (all years)."""
    j = _city_join(crashes, cities)
    return j.groupBy("state_fips", "place_fips", "year").agg(
        *[F.sum(c).alias(c) for c in ANNUAL_COLS])


def year_extent(crashes: DataFrame) -> DataFrame:
    """Min and max year (one row)."""
    return crashes.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def gap_filled_annual(annual: DataFrame, cities: DataFrame, min_year: int,
                      max_year: int) -> DataFrame:
    """Every (city, year) in [min_year, max_year]; missing years -> zeros.

    Years come from a generated range per city (``explode(sequence)``), a
    bounded multiplier, then a left join on (city, year).
    """
    grid = cities.select(*CITY_KEY, F.explode(F.sequence(F.lit(min_year), F.lit(max_year)))
                         .alias("year"))
    j = grid.join(annual, [*CITY_KEY, "year"], "left")
    return j.select(*CITY_KEY, "year",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ANNUAL_COLS])


def fatality_filter(points: DataFrame, fatality_type: str = "all") -> DataFrame:
    """all points, or those with ``<type>_fatalities > 0``."""
    if fatality_type == "all":
        return points
    if fatality_type not in VICTIM_TYPES:
        raise ValueError(f"unknown fatality type {fatality_type!r}")
    return points.filter(F.col(f"{fatality_type}_fatalities") > 0)


def dominant_type(points: DataFrame) -> DataFrame:
    """pedestrian > cyclist > motorist colour rule per crash point."""
    return points.withColumn(
        "dominant_type",
        F.when(F.col("pedestrian_fatalities") > 0, F.lit("pedestrian"))
         .when(F.col("cyclist_fatalities") > 0, F.lit("cyclist"))
         .otherwise(F.lit("motorist")))


def trend_direction(col: str) -> tuple[F.Column, F.Column]:
    """(direction, magnitude) of a trend: <=0 improving, >0 worsening,
    null -> 'none'; magnitude = |trend| at one decimal."""
    c = F.col(col)
    direction = (F.when(c.isNull(), F.lit("none"))
                 .when(c <= 0, F.lit("improving")).otherwise(F.lit("worsening")))
    return direction, F.round(F.abs(c), 1)


def filter_cities(cities: DataFrame, scopes: Iterable[str] = ("vz", "non-vz"),
                  search: str | None = None) -> DataFrame:
    """pledged / non-pledged / both, plus a lower-case substring search on
    display name, place name or state name."""
    scopes = set(scopes)
    out = cities
    if "vz" not in scopes:
        out = out.filter(~F.col("is_pledged"))
    if "non-vz" not in scopes:
        out = out.filter(F.col("is_pledged"))
    if search:
        q = search.strip().lower()
        out = out.filter(F.coalesce(F.lower("display_name").contains(q), F.lit(False))
                         | F.coalesce(F.lower("place_name").contains(q), F.lit(False))
                         | F.coalesce(F.lower("state_name").contains(q), F.lit(False)))
    return out


def sort_cities(cities: DataFrame, field: str = "population", ascending: bool = False,
                fatality_type: str = "all") -> DataFrame:
    """O2/O3: sort on a chosen field, nulls always last (distributed sort)."""
    sfx = "" if fatality_type == "all" else f"_{fatality_type}"
    col = {"population": "population", "city": "place_name",
           "avgFatalities": "avg_fatalities_5yr" if not sfx else f"avg_5yr{sfx}",
           "perCapita": "avg_per_100k_5yr" if not sfx else f"avg_per_100k{sfx}",
           "trend": f"trend_pct_change{sfx}"}.get(field, "population")
    c = F.col(col)
    return cities.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(),
                          *[F.col(k) for k in CITY_KEY])


def sort_positions(cities: DataFrame, field: str = "population", ascending: bool = False,
                   fatality_type: str = "all") -> DataFrame:
    """O2/O3 as data: the 1-based position of every city in the chosen sort
    (nulls last, then city key), from the distributed rank (no
    single-partition window)."""
    from roadstats.operators.ranking import global_rank, sort_key
    sfx = "" if fatality_type == "all" else f"_{fatality_type}"
    col = {"population": "population", "city": "place_name",
           "avgFatalities": "avg_fatalities_5yr" if not sfx else f"avg_5yr{sfx}",
           "perCapita": "avg_per_100k_5yr" if not sfx else f"avg_per_100k{sfx}",
           "trend": f"trend_pct_change{sfx}"}.get(field, "population")
    k = sort_key(col, ascending=ascending, nulls_last=True, prefix="_s",
                 text=dict(cities.dtypes)[col] == "string")
    keyed = cities.select("*", F.lit("sort").alias("_g"), *k)
    ranked = global_rank(keyed, "_g", ["_s_n", "_s_v", *CITY_KEY])
    return ranked.withColumnRenamed("rank", "position").drop("_g", "_s_n", "_s_v", "n")


def recent_years(points: DataFrame, max_year: int, n: int = 5, min_year: int = 2001) -> DataFrame:
    """The ``n`` latest calendar years up to ``max_year`` (partition
    pruning on a year-partitioned table)."""
    return points.filter((F.col("year") > max_year - n) & (F.col("year") <= max_year)
                         & (F.col("year") >= min_year))


def metric_long_form(ranked: DataFrame) -> DataFrame:
    """one row per (city, victim type, scope) with the columns the
    naming rule selects (avg, rate, trend, ranks and percentiles)."""
    rows = []
    for vt in ("all",) + VICTIM_TYPES:
        s = "" if vt == "all" else f"_{vt}"
        avg = "avg_fatalities_5yr" if vt == "all" else f"avg_5yr{s}"
        rate = "avg_per_100k_5yr" if vt == "all" else f"avg_per_100k{s}"
        trend = f"trend_pct_change{s}"
        for scope in ("all", "vz"):
            rows.append(F.struct(
                F.lit(vt).alias("victim_type"), F.lit(scope).alias("scope"),
                F.col(avg).alias("avg_5yr"), F.col(rate).alias("per_100k"),
                F.col(trend).alias("trend_pct"),
                F.col(f"rank_per_100k{s}_{scope}").alias("rank_per_100k"),
                F.col(f"pct_per_100k{s}_{scope}").alias("pct_per_100k"),
                F.col(f"rank_trend{s}_{scope}").alias("rank_trend"),
                F.col(f"pct_trend{s}_{scope}").alias("pct_trend")))
    return ranked.select(*CITY_KEY, F.explode(F.array(*rows)).alias("m")).select(
        *CITY_KEY, "m.*")


def mercator_pixels(lon: str, lat: str, zoom: F.Column, tile: int = 256) -> tuple:
    """Web-Mercator world pixel coordinates at ``zoom``."""
    scale = F.lit(float(tile)) * F.pow(F.lit(2.0), zoom.cast("double"))
    x = (F.col(lon) + F.lit(180.0)) / F.lit(360.0) * scale
    phi = F.radians(F.col(lat))
    y = (F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)) \
        / F.lit(2.0) * scale
    return x, y


def city_clusters(cities: DataFrame, radius_px: int = 40, max_zoom: int = 14) -> DataFrame:
    """G11 + A16 + G13: per zoom level, cities binned on a ``radius_px``
    pixel grid; per bin the count, any-pledged flag, the region name (city
    with the largest population, one override) and the members' bbox.

    Declared difference: fixed grid bins instead of a greedy radius
    clustering.  Each city contributes max_zoom+1 rows (bounded multiplier).
    """
    z = cities.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))).alias("zoom"))
    x, y = mercator_pixels("lon", "lat", F.col("zoom"))
    z = z.withColumn("cx", F.floor(x / radius_px)).withColumn("cy", F.floor(y / radius_px))
    name = F.coalesce(F.col("display_name"), F.col("place_name"))
    g = z.groupBy("zoom", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n_cities"),
        F.bool_or("is_pledged").alias("any_pledged"),
        F.max_by(F.struct(name.alias("n"), F.col("state_fips"), F.col("place_fips")),
                 F.struct(F.col("population"), F.col("state_fips"), F.col("place_fips")))
         .getField("n").alias("largest_city"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))
    ov = F.create_map(*[F.lit(x) for pair in CLUSTER_NAME_OVERRIDES for x in pair])
    return g.withColumn("region_name", F.coalesce(ov[F.col("largest_city")],
                                                  F.concat(F.col("largest_city"),
                                                           F.lit(" Region"))))
