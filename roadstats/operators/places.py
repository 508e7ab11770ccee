"""Place-table jobs: population load, city points, pledged flags, city codes,
boundary load and the place-side reports (N9–N12, L3, L4, L7, J9–J12, A12,
U3).

All lookups against constant dimensions are broadcast joins of fixed lists;
joins between data tables (places, populations, points, pledged list,
crash names) are ordinary equi-joins that Spark sizes at run time (AQE
turns them into broadcasts only when a side is measured small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.functions import dims
from roadstats.functions import normalize as nz
from roadstats.operators import loads as ld

PLACE_KEY = ("state_fips", "place_fips")


# ---------------------------------------------------------------------------
# S5 + N9 + L4 — population rows
# ---------------------------------------------------------------------------

def normalize_populations(raw: DataFrame) -> DataFrame:
    """Drop Puerto Rico (state 72); split and clean the place name;
    integer population (a non-integer value is a rejected row)."""
    city, state = nz.population_place("NAME")
    t = raw.filter(F.col("state").isNull() | (F.col("state") != "72")).select(
        F.col("state").alias("state_fips"), F.col("place").alias("place_fips"),
        city.alias("place_name"), state.alias("state_name"),
        nz.int_text("B01003_001E").alias("population"), "load_order")
    return t.withColumn("reject_reason", F.when(F.col("population").isNull(),
                                                F.lit("bad_population")))


def load_populations(raw: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """L4: first row wins per (state_fips, place_fips); outcome per row."""
    t = normalize_populations(raw)
    return ld.load_outcomes(t, target, PLACE_KEY, ["load_order"],
                            valid=F.col("reject_reason").isNull())


# ---------------------------------------------------------------------------
# S6 + N12 + L7 — city points
# ---------------------------------------------------------------------------

def resolve_points(spark: SparkSession, points: DataFrame) -> DataFrame:
    """A failed geocode whose name is in the override table takes the
    override point; an ``ok`` row with both coordinates keeps its own;
    everything else sets nothing.  Returns (state_fips, place_fips,
    point_lon, point_lat, point_source) for the rows that set a point."""
    ov = F.broadcast(dims.point_override_dim(spark))
    j = points.join(ov, "place_name", "left")
    ok = (F.col("status") == "ok") & (F.coalesce(F.col("lon"), F.lit("")) != "") \
        & (F.coalesce(F.col("lat"), F.lit("")) != "")
    use_override = (F.col("status") != "ok") & F.col("override_lon").isNotNull()
    out = j.select(
        "state_fips", "place_fips",
        F.when(use_override, F.col("override_lon")).when(ok, F.col("lon").try_cast("double"))
         .alias("point_lon"),
        F.when(use_override, F.col("override_lat")).when(ok, F.col("lat").try_cast("double"))
         .alias("point_lat"),
        F.when(use_override, F.lit("override")).when(ok, F.lit("geocoded")).alias("point_source"),
        F.monotonically_increasing_id().alias("_row"))
    out = out.filter(F.col("point_source").isNotNull())
    # several rows for one place: the later row's UPDATE wins in the source
    return ld.first_wins(out.withColumn("_neg", -F.col("_row")), list(PLACE_KEY), ["_neg"]) \
        .drop("_neg", "_row")


def apply_points(places: DataFrame, resolved: DataFrame) -> DataFrame:
    """Places take the resolved point where one exists, else keep theirs."""
    base = places
    for c in ("point_lon", "point_lat", "point_source"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string" if c == "point_source"
                                                       else "double"))
    return ld.write_back(base, resolved, PLACE_KEY, ["point_lon", "point_lat", "point_source"])


def copy_points(places: DataFrame, sources: DataFrame) -> DataFrame:
    """A13 + L7: a consolidated place without a point of its own takes that of
    its source place.  ``sources``: (target_state, target_place, state_fips,
    place_fips), one row per target."""
    pts = places.select(*PLACE_KEY, F.col("point_lon").alias("_lon"), F.col("point_lat").alias("_lat")) \
        .filter(F.col("_lon").isNotNull())
    found = sources.join(pts, list(PLACE_KEY)).select(
        F.col("target_state").alias("state_fips"), F.col("target_place").alias("place_fips"), "_lon", "_lat")
    j = places.join(found, list(PLACE_KEY), "left")
    lacks = F.col("point_lon").isNull() & F.col("_lon").isNotNull()
    return j.withColumns({
        "point_source": F.when(lacks, F.lit("member")).otherwise(F.col("point_source")),
        "point_lon": F.when(lacks, F.col("_lon")).otherwise(F.col("point_lon")),
        "point_lat": F.when(lacks, F.col("_lat")).otherwise(F.col("point_lat"))}).select(*places.columns)


# ---------------------------------------------------------------------------
# S7 + N10 + L7 + J10 — pledged flags
# ---------------------------------------------------------------------------

def canonical_pledges(spark: SparkSession, pledged: DataFrame) -> DataFrame:
    """Spelling fixes (city, optionally state), then state name -> FIPS
    (``ERROR`` when the name is not a state)."""
    fixes = F.broadcast(dims.pledge_fix_dim(spark))
    j = pledged.join(fixes, pledged.city_name == fixes.raw_city, "left")
    j = j.select(F.coalesce("fixed_city", "city_name").alias("city_name"),
                 F.coalesce("fixed_state", "state_name").alias("state_name"))
    inv = F.broadcast(dims.state_dim(spark).withColumnRenamed("state_name", "_sn"))
    return j.join(inv, j.state_name == inv._sn, "left").select(
        "city_name", "state_name",
        F.coalesce("state_fips", F.lit("ERROR")).alias("state_fips"))


def apply_pledges(places: DataFrame, pledges: DataFrame) -> DataFrame:
    """``is_pledged = TRUE`` for places matching (place_name, state_fips);
    other places keep their flag (default false)."""
    hits = pledges.select(F.col("city_name").alias("place_name"), "state_fips").distinct() \
        .withColumn("_hit", F.lit(True))
    j = places.join(hits, ["place_name", "state_fips"], "left")
    base = F.coalesce(F.col("is_pledged"), F.lit(False)) if "is_pledged" in places.columns \
        else F.lit(False)
    return j.withColumn("is_pledged", F.col("_hit").isNotNull() | base).drop("_hit") \
        .select(*places.columns, *([] if "is_pledged" in places.columns else ["is_pledged"]))


def unmatched_pledges(places: DataFrame, pledges: DataFrame) -> DataFrame:
    """Pledged entries matching no place (warned by the source)."""
    p = places.select(F.col("place_name").alias("city_name"), "state_fips")
    return pledges.join(p, ["city_name", "state_fips"], "left_anti")


# ---------------------------------------------------------------------------
# S8 + L4 — city codes
# ---------------------------------------------------------------------------

def load_city_codes(codes: DataFrame) -> DataFrame:
    """L4 for the code table.  The source table has no key, so every row is
    inserted and a duplicate code keeps both names; the lookup (J2) needs
    one name per code, so the declared difference is an explicit de-dup:
    the smallest name per (state, code)."""
    return codes.groupBy("state_code", "fars_city_code").agg(
        F.min("fars_city_name").alias("fars_city_name"),
        F.count(F.lit(1)).alias("source_rows"))


# ---------------------------------------------------------------------------
# S9 + N11 + L3 — boundaries
# ---------------------------------------------------------------------------

def load_boundaries(spark: SparkSession, vertices: DataFrame) -> DataFrame:
    """L3 + N11: first feature wins per place; state name and display name
    from the fixed dimensions.  Returns the place rows (one per place) with
    the vertex table kept separately by ``boundary_vertices``."""
    feats = vertices.select("state_fips", "place_fips", "place_name", "place_type",
                            "load_order").distinct()
    first = ld.first_wins(feats, list(PLACE_KEY), ["load_order"])
    first = first.join(F.broadcast(dims.state_dim(spark)), "state_fips", "left") \
        .join(F.broadcast(dims.display_name_dim(spark)), "place_name", "left") \
        .withColumn("display_name", F.coalesce("display_name", "place_name"))
    return first.select("state_fips", "place_fips", "state_name", "place_name", "display_name",
                        "place_type", "load_order")


def boundary_vertices(vertices: DataFrame, places: DataFrame) -> DataFrame:
    """Vertices of the winning feature of each place (semi-join on key and
    load order)."""
    return vertices.join(places.select(*PLACE_KEY, "load_order"),
                         [*PLACE_KEY, "load_order"], "left_semi").drop("load_order")


# ---------------------------------------------------------------------------
# Reports: J9 / A12 / U3, J11, J12
# ---------------------------------------------------------------------------

def mismatched_city_names(crashes: DataFrame, populations: DataFrame,
                          min_crashes: int = 50) -> DataFrame:
    """J9 + A12 + U3: FARS city names (city code not 0) seen in at least
    ``min_crashes`` crashes with no population place of the same upper-case
    name in the same state."""
    named = (crashes.filter(F.col("fars_city_name").isNotNull()
                            & (F.col("city").try_cast("int") != 0))
             .groupBy("fars_city_name", "state_name").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= min_crashes)
             .select(F.col("fars_city_name").alias("city_name"), "state_name").distinct())
    pop = populations.select(F.upper("place_name").alias("city_name"), "state_name").distinct()
    return named.join(pop, ["city_name", "state_name"], "left_anti")


def eligible_without_boundary(eligible: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Eligible cities with no boundary row (warned by the source)."""
    return eligible.join(boundaries.select(*PLACE_KEY), list(PLACE_KEY), "left_anti")


def geocode_candidates(places: DataFrame, stats: DataFrame, existing: DataFrame | None = None,
                       min_population: int = 100000) -> DataFrame:
    """Places with population strictly above ``min_population``, ordered
    by key; places that already have a point are removed (work list)."""
    j = places.select(*PLACE_KEY, "place_name", "state_name").join(
        stats.filter(F.col("population") > min_population).select(*PLACE_KEY),
        list(PLACE_KEY), "inner")
    if existing is not None:
        j = j.join(existing.select(*PLACE_KEY), list(PLACE_KEY), "left_anti")
    return j.orderBy(*PLACE_KEY)
