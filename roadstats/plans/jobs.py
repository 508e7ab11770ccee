"""The reference's batch runs as Spark jobs over table folders.

Each ``run_*`` function reads its inputs, chains the operators of this
package and writes parquet tables under ``out`` (one folder per table; a
write-back produces a new table version).  They return small outcome
DataFrames (counts per dataset / year / outcome), never the data itself.

* ``run_city_load``   — §3.2: boundaries (S9, L3, N11), union of consolidated
  places (A13, G6) and their points, largest part (O4),
  populations (S5, N9, L4), pledged flags (S7, N10, L7), city points
  (S6, N12, L7) -> ``places``, ``place_vertices``, ``populations``,
  ``consolidated``
* ``run_crash_load``  — §3.1 stages 2–8: year selection (S4), dataset
  dispatch (S3), crash and person scans (S1, S2), normalisation, keyed
  loads with quarantine (L1, L2, L5) -> ``crashes``, ``persons``,
  ``quarantine`` (partitioned by year)
* ``run_enrichment``  — §3.1 stages 9–10: spatial assignment (J4) and
  subtypes (A1), both written back (L7) -> ``crashes_enriched``
* ``run_city_stats``  — §3.1 stages 11–12: stats (A3–A8) and ranks
  (W1–W4) -> ``city_stats``
* ``run_exports``     — §3.3: E1–E5 under ``export_root``
* ``run_hotspots``    — §3.4: G2–G9, W5, U1 -> E6
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadstats.functions import dims
from roadstats.operators import city_stats as cs
from roadstats.operators import hotspots as hs
from roadstats.operators import loads as ld
from roadstats.operators import overlay as ov
from roadstats.operators import places as pl
from roadstats.operators import quality as qa
from roadstats.operators import raw_load as rl
from roadstats.operators import ranking as rk
from roadstats.operators import serving as sv
from roadstats.operators import spatial as sa
from roadstats.operators import subtypes as st
from roadstats.plans import export as ex
from roadstats.session import light_tasks_session, reliable_checkpoint
from roadstats.sources import place_files as pf
from roadstats.sources import raw_files as rf


def _table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def run_city_load(spark: SparkSession, place_root: str, out: str,
                  largest_part_places: Sequence[tuple[str, str]] = dims.LARGEST_PART_PLACES,
                  members: DataFrame | None = None, point_sources: DataFrame | None = None
                  ) -> DataFrame:
    """§3.2: the places table with populations, pledged flags and points.
    ``largest_part_places``: (state, place) of which only the largest part
    counts (O4); all others keep every part.  ``members`` (target_state,
    target_place, state_fips, place_fips): consolidated governments, whose
    polygon becomes the union of their members' (A13); ``point_sources``
    (the same columns): where such a target takes its point from when it has
    none.  Both default to the fixed lists."""
    members = dims.consolidated_member_dim(spark) if members is None else members
    point_sources = dims.consolidated_point_dim(spark) if point_sources is None else point_sources
    v = pf.scan_boundaries(spark, place_root)
    places = pl.load_boundaries(spark, v)
    verts = ov.merge_places(pl.boundary_vertices(v, places), members)
    members.write.mode("overwrite").parquet(f"{out}/consolidated")
    if largest_part_places:
        verts = sa.largest_part(verts, only=F.broadcast(spark.createDataFrame(
            list(largest_part_places), "state_fips string, place_fips string")))
    verts.write.mode("overwrite").parquet(f"{out}/place_vertices")

    pops = reliable_checkpoint(pl.load_populations(pf.scan_populations(spark, place_root)))
    pops.filter(F.col("outcome") == "inserted").select(
        "state_fips", "place_fips", "place_name", "state_name", "population") \
        .write.mode("overwrite").parquet(f"{out}/populations")

    pledges = pl.canonical_pledges(spark, pf.scan_pledged(spark, place_root))
    resolved = pl.resolve_points(spark, pf.scan_city_points(spark, place_root))
    table = places.drop("load_order")
    table = pl.apply_pledges(table, pledges)
    table = pl.copy_points(pl.apply_points(table, resolved), point_sources)
    table.write.mode("overwrite").parquet(f"{out}/places")
    return (pops.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("dataset", F.lit("populations")))


def _loaded(path: str, years: list[int] | None, like: DataFrame) -> DataFrame | None:
    """The table at ``path`` (columns of ``like``) cut to the incoming years
    (its partitions), or None if there is none yet."""
    spark = like.sparkSession
    if not rf._exists(spark, path):
        return None
    t = spark.read.schema(like.schema).parquet(path)
    return t if years is None else t.filter(F.col("year").isin(years))


def run_crash_load(spark: SparkSession, raw_root: str, out: str, codes: DataFrame,
                   years: Sequence[int] | None = None, refuse: bool = False) -> DataFrame:
    """§3.1 stages 2–8: crash and person files of the selected years into
    keyed tables; returns rows per (dataset, year, outcome).

    New keys are appended, so other years and rows that are there already
    stay, and a run that is repeated adds nothing.  A year without a person
    file keeps its crashes and is reported as (person, year, missing_file).
    Rejected rows go to ``quarantine`` as they stood in the file; a repeated
    year replaces its own.

    The crash rows are written once beside the tables and checked while that
    happens (``load_report``: V2–V4, V6, outcomes, gaps).  With ``refuse``, a
    batch that fails a blocking check is not loaded: the report stays, the
    tables are as before, and ``BlockingCheckFailed`` is raised (V7).
    """
    selected = None if years is None else sorted(rf.resolve_years(years))
    files = rf.dataset_presence(rf.dataset_files(spark, raw_root))
    if selected is not None:
        files = files.filter(F.col("year").isin(selected))
    missing = files.filter("loads_crashes AND NOT loads_persons").select(
        F.lit("person").alias("dataset"), "year", F.lit("missing_file").alias("outcome"),
        F.lit(1).cast("long").alias("n_rows"))
    raw = rf.scan_crash_files(spark, raw_root, selected)
    if raw is None:
        return missing
    typed = rl.normalize_crashes(spark, rl.with_raw_row(raw, rf.CRASH_FIELDS), codes)
    table = typed.select(*rl.CRASH_COLUMNS)
    seen = Observation("crash load")
    (rl.crash_ledger(typed, _loaded(f"{out}/crashes", selected, table)).observe(seen, *qa.load_metrics())
     .write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/_staged/crashes"))
    report = qa.load_report(spark, seen.get)
    report.coalesce(1).write.mode("overwrite").parquet(f"{out}/load_report")
    if refuse:
        qa.enforce(report)
    light = light_tasks_session(spark)  # a write by year sorts what its task reads
    crashes = light.read.parquet(f"{out}/_staged/crashes")
    rl.inserted(crashes, rl.CRASH_COLUMNS) \
        .write.mode("append").partitionBy("year").parquet(f"{out}/crashes")
    loads = [(crashes, "crash")]
    raw = rf.scan_person_files(spark, raw_root, selected)
    if raw is not None:
        keys = _loaded(f"{out}/crashes", selected, table).select(*rl.CRASH_KEY)
        typed = rl.normalize_persons(rl.with_raw_row(raw, rf.PERSON_FIELDS))
        table = typed.drop("reject_reason", "load_order", "raw_row")
        (rl.person_ledger(typed, keys, _loaded(f"{out}/persons", selected, table))
         .write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/_staged/persons"))
        persons = light.read.parquet(f"{out}/_staged/persons")
        persons.filter(F.col("outcome") == "inserted").select(*table.columns) \
            .write.mode("append").partitionBy("year").parquet(f"{out}/persons")
        loads.append((persons, "person"))
    for rows, dataset in loads:
        (rows.filter(F.col("outcome") == "error")
         .select("source_file", "reject_reason", "raw_row", "year", F.lit(dataset).alias("dataset"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("year", "dataset").parquet(f"{out}/quarantine"))
    counts = missing
    for rows, dataset in loads:
        counts = counts.unionByName(
            rows.withColumn("dataset", F.lit(dataset)).groupBy("dataset", "year", "outcome")
            .agg(F.sum("n_rows").alias("n_rows")))
    return counts


def run_enrichment(spark: SparkSession, out: str, cell: float = 0.05) -> DataFrame:
    """§3.1 stages 9–10: place assignment (J4 + L7) and victim subtypes
    (A1 + L7) as a new version of the crash table.

    Only years whose crashes or persons changed since the last run are
    enriched and rewritten; a change of the places touches all years.  The
    fingerprints are written last, so a run that ends early is repeated."""
    crashes, persons = _table(spark, out, "crashes"), _table(spark, out, "persons")
    city = [_table(spark, out, t) for t in ("places", "place_vertices", "consolidated")]
    places = ld.partition_prints([t.withColumn("_all", F.lit(0)) for t in city], "_all").first()
    now = ld.partition_prints([crashes, persons], "year").withColumn(
        "print", F.concat_ws("/", "print", F.lit(f"{places['print'] if places else ''}/{cell}")))
    now = reliable_checkpoint(now)
    known = f"{out}/enriched_prints"
    whole = rf._exists(spark, f"{out}/crashes_enriched") and rf._exists(spark, known)
    before = spark.read.parquet(known) if whole else None
    years = ld.changed_partitions(now, before, "year")
    if years:
        crashes, persons = crashes.filter(F.col("year").isin(years)), persons.filter(F.col("year").isin(years))
        if "place_fips" not in crashes.columns:
            crashes = crashes.withColumn("place_fips", F.lit(None).cast("string")) \
                .withColumn("fips_city_name", F.lit(None).cast("string"))
        # a crash within a merged place and one of its members counts for the merged one
        merged = _table(spark, out, "consolidated").select(F.col("target_state").alias("state_fips"),
                                                           F.col("target_place").alias("place_fips")).distinct()
        assignment = sa.assign_points(crashes.select("st_case", "year", "lon", "lat"),
                                      _table(spark, out, "place_vertices"), ["st_case", "year"], cell,
                                      preferred=merged)
        located = sa.enrich_crash_locations(crashes, assignment, _table(spark, out, "places"))
        enriched = st.apply_subtypes(located, persons, ("st_case", "year"))
        (enriched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if whole else "static")
         .partitionBy("year").parquet(f"{out}/crashes_enriched"))
        now.write.mode("overwrite").parquet(known)
    t = _table(spark, out, "crashes_enriched")
    return t.agg(F.count(F.lit(1)).alias("crashes"),
                 F.count_if(F.col("place_fips").isNotNull()).alias("with_place"),
                 F.sum("total_fatalities").alias("fatalities"))


def run_city_stats(spark: SparkSession, out: str, min_population: int = 100000) -> DataFrame:
    """§3.1 stages 11–12: city_stats with ranks for every place that has a
    population row (the source's city_stats is keyed by the population
    table)."""
    pops = _table(spark, out, "populations")
    flags = _table(spark, out, "places").select("state_fips", "place_fips", "is_pledged")
    places = pops.join(flags, ["state_fips", "place_fips"], "left") \
        .withColumn("is_pledged", F.coalesce("is_pledged", F.lit(False)))
    crashes = _table(spark, out, "crashes_enriched")
    stats = cs.city_stats(crashes, places, min_population)
    rk.with_rankings(stats, min_population).write.mode("overwrite").parquet(f"{out}/city_stats")
    t = _table(spark, out, "city_stats")
    return t.agg(F.count(F.lit(1)).alias("cities"),
                 F.count("avg_per_100k_5yr").alias("with_rate"),
                 F.count("rank_per_100k_all").alias("ranked"))


def run_exports(spark: SparkSession, out: str, export_root: str,
                min_population: int = 100000) -> DataFrame:
    """§3.3: metadata, cities, boundaries, annual fatalities, crash files."""
    crashes = _table(spark, out, "crashes_enriched")
    places = _table(spark, out, "places")
    stats = _table(spark, out, "city_stats")
    eligible = cs.eligible(stats, min_population).select("state_fips", "place_fips")
    ex.write_crashes_metadata(crashes, export_root)
    ex.write_cities(ex.city_export(places, stats, min_population), export_root)
    verts = _table(spark, out, "place_vertices").join(eligible, ["state_fips", "place_fips"],
                                                     "left_semi")
    ex.write_boundaries(verts, places, export_root)
    ex.write_annual(sv.annual_fatalities(crashes, eligible), export_root)
    points = sv.export_crash_points(crashes, eligible)
    ex.write_crash_points(points, export_root)
    max_year = sv.year_extent(crashes).first()["max_year"]
    if max_year is not None:
        ex.write_empty_slots(ex.empty_slots(points, eligible, max_year), export_root)
    return ex.export_sizes(spark, export_root)


def run_hotspots(spark: SparkSession, out: str, export_root: str,
                 min_population: int = 100000) -> DataFrame:
    """§3.4: hot cells of eligible cities from 2001, dissolved and buffered."""
    crashes = _table(spark, out, "crashes_enriched")
    eligible = cs.eligible(_table(spark, out, "city_stats"), min_population)
    points = sv.export_crash_points(crashes, eligible)
    ranked = hs.rank_cells(hs.cell_counts(hs.project_points(points)))
    hot = ranked.filter("is_hot").select("state_fips", "place_fips", "cx", "cy")
    ex.write_hotspots(hot, export_root)
    return hs.zone_summary(hot)
