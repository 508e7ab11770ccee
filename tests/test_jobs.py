"""The batch runs chained end to end on the sf0.001 stand-in files."""

from pyspark.sql import functions as F

from roadstats.operators import places as pl
from roadstats.operators import spatial as sa
from roadstats.plans import jobs
from roadstats.sources import place_files as pf
from roadstats.sources import raw_files as rf
from roadstats.sources import standins as sp
from tests.conftest import SF_SMALL


def test_runs_chain(spark, tmp_path):
    out, exports = str(tmp_path / "tables"), str(tmp_path / "exports")
    place_root = pf.ensure_place_files(spark, SF_SMALL)
    raw_root = rf.ensure_fars_files(spark, SF_SMALL)

    city = {r["outcome"]: r["n_rows"] for r in jobs.run_city_load(spark, place_root, out).collect()}
    assert city["inserted"] == sp.table(spark, SF_SMALL, "customer").count()

    counts = jobs.run_crash_load(spark, raw_root, out, sp.city_codes(spark, SF_SMALL))
    c = {(r["dataset"], r["outcome"]): 0 for r in counts.collect()}
    for r in counts.collect():
        c[(r["dataset"], r["outcome"])] += r["n_rows"]
    loaded = spark.read.parquet(f"{out}/crashes").count()
    assert c[("crash", "inserted")] == loaded > 0
    assert c[("person", "skipped_orphan")] > 0 and c[("crash", "error")] > 0

    e = jobs.run_enrichment(spark, out).first()
    assert e["crashes"] == loaded and 0 < e["with_place"] < loaded

    s = jobs.run_city_stats(spark, out).first()
    assert s["cities"] == city["inserted"]

    # stand-in boundaries are keyed by nation, populations by customer, so
    # few places have both; the metadata file is always written
    sizes = {r["sink"]: r["files"] for r in jobs.run_exports(spark, out, exports).collect()}
    assert "crashes_metadata" in sizes

    # a year selection loads only those years (S4 as a partition filter)
    out2 = str(tmp_path / "tables_1996")
    jobs.run_crash_load(spark, raw_root, out2, sp.city_codes(spark, SF_SMALL), years=[1996])
    years = {r["year"] for r in spark.read.parquet(f"{out2}/crashes").select("year")
             .distinct().collect()}
    assert years == {1996}


def test_consolidated_places(spark, tmp_path):
    """The target's polygon is the union of its members', its point is the source's, and crashes within it count for it
    although the members' polygons are still there."""
    out = str(tmp_path / "tables")
    schema = "target_state string, target_place string, state_fips string, place_fips string"
    places = [(f"{n:02d}", f"{n:05d}") for n in (7, 1, 2)]
    members = spark.createDataFrame([("07", "00007", *p) for p in places], schema)
    jobs.run_city_load(spark, pf.ensure_place_files(spark, SF_SMALL), out, members=members,
                       point_sources=spark.createDataFrame([("07", "00007", "01", "00001")], schema)).collect()
    areas = {}
    for r in sa.part_areas(spark.read.parquet(f"{out}/place_vertices")).collect():
        areas[r["place_fips"]] = areas.get(r["place_fips"], 0) + r["area"]
    assert abs(areas["00007"] - areas["00001"] - areas["00002"] - areas["00003"]) < 1e-6  # 3 and 7 are of one shape

    sp.crash_points(spark, SF_SMALL).withColumn("total_fatalities", F.lit(1)).write.partitionBy("year").parquet(f"{out}/crashes")
    spark.createDataFrame([], "st_case bigint, year int, person_type int, injury_severity int").write.parquet(f"{out}/persons")
    jobs.run_enrichment(spark, out)
    found = {r["place_fips"] for r in spark.read.parquet(f"{out}/crashes_enriched").select("place_fips").distinct().collect()}
    assert "00007" in found and not found & {"00001", "00002"} and "00003" in found


def test_point_of_a_member(spark):
    rows = [("21", "1", None, None, None), ("21", "2", -85.7, 38.2, "geocoded"), ("21", "3", -1.0, 2.0, "override"), ("21", "4", None, None, None)]
    places = spark.createDataFrame(rows, "state_fips string, place_fips string, point_lon double, point_lat double, point_source string")
    sources = spark.createDataFrame([("21", "1", "21", "2"), ("21", "3", "21", "2"), ("21", "4", "21", "9")],
                                    "target_state string, target_place string, state_fips string, place_fips string")
    got = {r["place_fips"]: (r["point_lon"], r["point_lat"], r["point_source"]) for r in pl.copy_points(places, sources).collect()}
    assert got == {"1": (-85.7, 38.2, "member"), "2": (-85.7, 38.2, "geocoded"), "3": (-1.0, 2.0, "override"), "4": (None, None, None)}


def test_year_loads_keep_other_years(spark, tmp_path):
    out, raw_root = str(tmp_path / "tables"), rf.ensure_fars_files(spark, SF_SMALL)
    codes = sp.city_codes(spark, SF_SMALL)
    jobs.run_crash_load(spark, raw_root, out, codes).collect()

    def per_year(table):
        return {r["year"]: r["count"] for r in spark.read.parquet(f"{out}/{table}").groupBy("year").count().collect()}
    before = {t: per_year(t) for t in ("crashes", "persons", "quarantine")}
    assert len(before["crashes"]) == 7
    again = jobs.run_crash_load(spark, raw_root, out, codes, years=[1996]).collect()
    assert {t: per_year(t) for t in before} == before
    assert not [r for r in again if r["outcome"] == "inserted"] and {r["year"] for r in again} == {1996}
    rejected = spark.read.parquet(f"{out}/quarantine")
    assert rejected.filter("raw_row IS NULL").count() == 0
    assert rejected.filter("dataset = 'crash'").select(F.get_json_object("raw_row", "$.STATE").alias("s")) \
        .filter("s IS NOT NULL").count() > 0

    # a year without a person file keeps its crashes, and says so
    alone = str(tmp_path / "alone")
    got = jobs.run_crash_load(spark, raw_root, alone, codes, years=[2001]).collect()
    assert ("person", 2001, "missing_file", 1) in [tuple(r) for r in got]
    assert spark.read.parquet(f"{alone}/crashes").count() == before["crashes"][2001]


def test_hotspot_run(spark, tmp_path):
    out, exports = str(tmp_path / "tables"), str(tmp_path / "exports")
    # hotspots from the stand-in crash table (eligible customer places)
    sp.loaded_crashes(spark, SF_SMALL).write.parquet(f"{out}/crashes_enriched")
    stats = sp.places(spark, SF_SMALL)
    stats.write.parquet(f"{out}/city_stats")
    zones = jobs.run_hotspots(spark, out, exports)
    assert zones.count() >= 0
    assert spark.read.text(f"{exports}/hotspots").filter(F.col("value").contains("Feature")) \
        .count() == 2 * zones.count()
