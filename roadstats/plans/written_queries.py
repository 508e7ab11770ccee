"""Registered queries over tables with defects, and over the text that the sinks write.

The first half runs the checks of ``operators.quality`` (and rules that the plain tables never trigger) on
stand-ins whose defects follow a rule, so that each result is neither empty nor everything.  The second
reads written files back as text: keys, values and the order of the lines, not just the parsed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators import city_stats as cs
from roadstats.operators import places as pl
from roadstats.operators import quality as qa
from roadstats.operators import serving as sv
from roadstats.operators import spatial as sa
from roadstats.plans import export as ex
from roadstats.plans import oracle_sql as osql
from roadstats.plans import registry as rg
from roadstats.plans.registry import register
from roadstats.session import reliable_checkpoint, small_files_session
from roadstats.sources import folder_files as ff
from roadstats.sources import place_files as pf
from roadstats.sources import raw_files as rf
from roadstats.sources import standins as sp

# ---------------------------------------------------------------------------
# V1-V6, D1-D5, D9-D11 on the crash table with defects
# ---------------------------------------------------------------------------

register("flawed_blocking_checks", rg.ORACLES_TEXT["blocking_checks"].replace("sp_crashes", "sp_flawed"))(
    lambda spark, sf_dir: qa.blocking_checks(sp.flawed_crashes(spark, sf_dir)))


@register("flawed_duplicate_keys", """
    SELECT st_case, CAST(year AS BIGINT) AS year, count(*) AS n FROM sp_flawed GROUP BY ALL HAVING count(*) > 1""")
def q_flawed_duplicate_keys(spark, sf_dir):
    """Crash keys held twice (null keys among them)."""
    return qa.duplicate_keys(sp.flawed_crashes(spark, sf_dir))


for _name, _check in (("missing_fields", qa.missing_fields), ("negative_samples", qa.negative_samples),
                      ("implausible_points", qa.implausible_points), ("completeness", qa.completeness)):
    register(f"flawed_{_name}", rg.ORACLES_TEXT[_name].replace("sp_crashes", "sp_flawed").replace(
        "ORDER BY year, st_case", "ORDER BY year NULLS FIRST, st_case NULLS FIRST"))(
        lambda spark, sf_dir, check=_check: check(sp.flawed_crashes(spark, sf_dir)))


@register("flawed_bad_dates", """
    SELECT CAST(year AS BIGINT) AS year, count(*) AS total_records, count(*) AS bad_dates FROM sp_flawed
    WHERE crash_date < DATE '1987-01-01' OR crash_date > DATE '2023-12-31' GROUP BY year""")
def q_flawed_bad_dates(spark, sf_dir):
    """D3 with its own bounds."""
    return qa.bad_dates_per_year(sp.flawed_crashes(spark, sf_dir))


# ---------------------------------------------------------------------------
# O1, O6/U2 over more than ten years; N11, O3, O4 where the rule decides
# ---------------------------------------------------------------------------

@register("year_windows_spread", """
    SELECT year, row_number() OVER (ORDER BY year DESC) <= 5 AS is_recent, row_number() OVER (ORDER BY year) <= 5 AS is_previous
    FROM (SELECT DISTINCT year FROM sp_spread ORDER BY year DESC LIMIT 10) t""")
def q_year_windows_spread(spark, sf_dir):
    """O1: more years than the window holds."""
    return cs.year_windows(sp.spread_points(spark, sf_dir))


@register("recent_points_spread", """
    SELECT st_case, year FROM sp_spread WHERE year > (SELECT max(year) FROM sp_spread) - 5""")
def q_recent_points_spread(spark, sf_dir):
    """The five latest calendar years of points over more of them."""
    points = sp.spread_points(spark, sf_dir)
    return sv.recent_years(points, sv.year_extent(points).first()["max_year"]).select("st_case", "year")


@register("display_names", f"""
    WITH t AS (SELECT * FROM (VALUES (0, 'Athens'), (1, 'Augusta'), (2, 'Louisville'), (3, 'Lexington'), (4, 'Nashville'),
                              (5, 'Macon')) v(i, display_name))
    SELECT {osql.zf('c_nationkey', 2)} AS state_fips, {osql.zf('c_custkey', 5)} AS place_fips, s.state_name,
           coalesce(t.display_name, c_name) AS display_name
    FROM customer LEFT JOIN t ON t.i = c_custkey % 9 LEFT JOIN sp_states s ON s.state_fips = {osql.zf('c_nationkey', 2)}""")
def q_display_names(spark, sf_dir):
    """L3 + N11: the first feature of a place wins, long official names become display names."""
    return pl.load_boundaries(spark, sp.titled_features(spark, sf_dir)).select(
        "state_fips", "place_fips", "state_name", "display_name")


@register("sorted_cities_by_name", """
    SELECT state_fips, place_fips, town, row_number() OVER (ORDER BY town, state_fips, place_fips) AS position
    FROM (SELECT *, 'Town ' || CAST(CAST(place_fips AS INTEGER) % 7 AS VARCHAR) AS town FROM sp_places
          WHERE population >= 100000 OR is_pledged) t""")
def q_sorted_cities_by_name(spark, sf_dir):
    """O3: the city table sorted by a text that many cities share."""
    towns = cs.eligible(sp.places(spark, sf_dir)).withColumn(
        "place_name", F.concat(F.lit("Town "), F.col("place_fips").cast("int") % 7))
    return sv.sort_positions(towns, "city", ascending=True).select(
        "state_fips", "place_fips", F.col("place_name").alias("town"), "position")


@register("named_largest_part", """
    WITH own AS (SELECT place_fips, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area FROM sp_edges GROUP BY place_fips)
    SELECT v.state_fips, v.place_fips, CAST(p.part AS BIGINT) AS part,
           CASE WHEN p.part = 0 THEN own.area ELSE %s END AS area
    FROM sp_vertices v JOIN own ON own.place_fips = v.place_fips, (VALUES (0), (1)) p(part)
    WHERE v.seq = 0 AND (p.part = 0 OR CAST(v.place_fips AS INTEGER) %% 8 = 4)""" % repr(round(pf.ISLAND_SIZE ** 2, 6)))
def q_named_largest_part(spark, sf_dir):
    """Only listed places are cut to their largest part; others keep their islands."""
    v = pf.scan_boundaries(spark, rg._place_root(spark, sf_dir))
    verts = pl.boundary_vertices(v, pl.load_boundaries(spark, v))
    listed = verts.filter(F.col("place_fips").cast("int") % 8 == 0).select("state_fips", "place_fips")
    return sa.part_areas(sa.largest_part(verts, only=listed)).select(
        "state_fips", "place_fips", "part", F.round("area", 6).alias("area"))


# ---------------------------------------------------------------------------
# The crash load as a run
# ---------------------------------------------------------------------------

@register("year_reload", """
    WITH chosen AS (SELECT * FROM (VALUES (1, 1995), (1, 1997), (2, 1995), (2, 1997), (2, 1998)) c(run, year)),
    n AS (SELECT year, count(*) AS n FROM sp_raw_loaded GROUP BY year)
    SELECT CAST(c.run AS BIGINT) AS run, CAST(c.year AS BIGINT) AS year, n.n AS table_rows FROM chosen c JOIN n USING (year)""")
def q_year_reload(spark, sf_dir):
    """S4 + L1: two years, then one of them again and a new one; other years stay as they are."""
    from roadstats.plans import jobs
    root, out = rf.ensure_fars_files(spark, sf_dir), rg._export_dir(spark)
    tables = []
    for run, years in ((1, [1997, 1995, 1997]), (2, [1998, 1997])):
        jobs.run_crash_load(spark, root, out, sp.city_codes(spark, sf_dir), years=years)
        rows = spark.read.parquet(f"{out}/crashes").groupBy("year").agg(F.count(F.lit(1)).alias("table_rows"))
        # at most one row a year
        tables += [(run, int(r["year"]), r["table_rows"]) for r in rows.collect()]
    return spark.createDataFrame(tables, "run long, year long, table_rows long")


@register("quarantine_rows", """
    SELECT 'crash' AS dataset, CAST(year AS BIGINT) AS year, reason AS reject_reason, count(*) AS n_rows, count(*) AS with_raw
    FROM sp_raw_crash, (SELECT unnest([0, 1]) AS cp) t WHERE reason IS NOT NULL AND (cp = 0 OR k % 29 = 0) GROUP BY ALL
    UNION ALL
    SELECT 'person', CAST(year AS BIGINT), 'bad_person_age', count(*), count(*) FROM sp_raw_person WHERE has_crash AND bad_age GROUP BY ALL""")
def q_quarantine_rows(spark, sf_dir):
    """L5 + S3: rejected rows of a whole load, with what stood in the file."""
    from roadstats.plans import jobs
    root, out = rf.ensure_fars_files(spark, sf_dir), rg._export_dir(spark)
    jobs.run_crash_load(spark, root, out, sp.city_codes(spark, sf_dir))
    q = spark.read.parquet(f"{out}/quarantine")
    return q.groupBy("dataset", "year", "reject_reason").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.get_json_object("raw_row", "$.ST_CASE")).alias("with_raw"))


# ---------------------------------------------------------------------------
# The files' text
# ---------------------------------------------------------------------------

def written_lines(spark, path: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """(folders..., file, position, value): the lines of every file under ``path`` in their order.

    A file is what one task wrote, and is read by one task, in a local folder by one that listed it; the texts are
    checkpointed, as each file is opened but once."""
    root = ff.local_root(spark, path)
    if root is None:
        texts = (small_files_session(spark).read.option("recursiveFileLookup", "true").text(path, wholetext=True)
                 .where("value <> ''").select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"),
                                              F.regexp_replace("value", "\n$", "").alias("text")))
    else:
        texts = ff.file_texts(spark, root)
    texts = reliable_checkpoint(texts)
    lines = texts.select("file", "start", F.posexplode(F.split("text", "\n")).alias("_at", "value"))
    return lines.select("file", *[ex.folder_value(F.col("file"), f).alias(f) for f in folders],
                        (F.col("start") + F.col("_at")).alias("position"), "value")


def in_order(lines: DataFrame, folders: tuple[str, ...] = ()) -> DataFrame:
    """``place``: a line's place from 1 among all of its folder, files by name; one row a file is windowed."""
    sizes = lines.groupBy("file", *folders).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*folders).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, "file").withColumn("place", F.col("position") + F.col("_start") + 1)


def _field(name: str, kind: str):
    return F.get_json_object("value", f"$.{name}").cast(kind).alias(name)


def _keys():
    return F.array_join(F.json_object_keys("value"), ",").alias("keys")


_CITY_KEY = ("state_fips", "place_fips")


@register("export_city_lines", f"""
    SELECT state_fips, place_fips, CAST(population AS BIGINT) AS population, '{",".join(ex.CITY_EXPORT_COLS)}' AS keys,
           row_number() OVER (ORDER BY population DESC, state_fips, place_fips) AS place FROM sp_ranked""")
def q_export_city_lines(spark, sf_dir):
    """E2 + O2: every line has all 53 keys (nulls too), and the files hold the cities by population."""
    places, ranked = rg._ranked_places(spark, sf_dir)
    path = ex.write_cities(ex.city_export(places, ranked), rg._export_dir(spark))
    return in_order(written_lines(spark, path)).select(
        _field("state_fips", "string"), _field("place_fips", "string"), _field("population", "long"), _keys(), "place")


def _annual(spark, sf_dir):
    return sv.annual_fatalities(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))


@register("export_annual_lines", f"""
    SELECT state_fips, place_fips, CAST(year AS BIGINT) AS year, 'year,{",".join(sv.ANNUAL_COLS)}' AS keys,
           row_number() OVER (PARTITION BY state_fips, place_fips ORDER BY year) AS place FROM sp_annual_city""")
def q_export_annual_lines(spark, sf_dir):
    """E4 + O7: a city's lines stand in year order."""
    path = ex.write_annual(_annual(spark, sf_dir), rg._export_dir(spark))
    return in_order(written_lines(spark, path, _CITY_KEY), _CITY_KEY).select(*_CITY_KEY, _field("year", "long"), _keys(), "place")


@register("export_crash_lines", f"""
    SELECT state_fips, place_fips, CAST(year AS BIGINT) AS folder_year, CAST(year AS BIGINT) AS year, st_case,
           '{",".join(c for c in sv.EXPORT_CRASH_COLS)}' AS keys,
           row_number() OVER (PARTITION BY state_fips, place_fips, year ORDER BY st_case) AS place FROM sp_export_points""")
def q_export_crash_lines(spark, sf_dir):
    """E5 + O7: the body of a line holds its year, and a folder's lines stand in case order."""
    points = sv.export_crash_points(sp.loaded_crashes(spark, sf_dir), cs.eligible(sp.places(spark, sf_dir)))
    path = ex.write_crash_points(points, rg._export_dir(spark))
    folders = (*_CITY_KEY, "folder_year")
    return in_order(written_lines(spark, path, folders), folders).select(
        *_CITY_KEY, F.col("folder_year").cast("long").alias("folder_year"), _field("year", "long"),
        _field("st_case", "long"), _keys(), "place")


def _rings(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys..., part, ring, points) of GeoJSON features in ``value``."""
    kind, text = F.get_json_object("value", "$.geometry.type"), F.get_json_object("value", "$.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).otherwise(
        F.from_json(text, "array<array<array<array<double>>>>"))
    p = lines.select(*keys, F.posexplode(parts).alias("part", "rings"))
    return p.select(*keys, "part", F.posexplode("rings").alias("ring", "points"))


@register("export_boundary_vertices", f"""
    WITH b AS (
      SELECT place_fips, state_fips, 0 AS part, x, y FROM sp_vertices
      UNION ALL
      SELECT v.place_fips, v.state_fips, 1, v.x + i.dx * {pf.ISLAND_SIZE!r}, v.y - 1 + i.dy * {pf.ISLAND_SIZE!r}
      FROM sp_vertices v, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) i(dx, dy)
      WHERE v.seq = 0 AND CAST(v.place_fips AS INTEGER) % 4 = 0)
    SELECT b.state_fips, b.place_fips, n.n_name AS place_name, CAST(part AS BIGINT) AS part, CAST(0 AS BIGINT) AS ring,
           CAST(round(x * 100000) AS BIGINT) AS x, CAST(round(y * 100000) AS BIGINT) AS y
    FROM b JOIN nation n ON n.n_nationkey = CAST(b.place_fips AS INTEGER)""")
def q_export_boundary_vertices(spark, sf_dir):
    """E3 + G9 + G10: the written features' names and vertices (1e-5 degree); points on straight lines are gone."""
    v = pf.scan_boundaries(spark, rg._place_root(spark, sf_dir))
    places = pl.load_boundaries(spark, v)
    path = ex.write_boundaries(pl.boundary_vertices(v, places), places, rg._export_dir(spark))
    props = [F.get_json_object("value", f"$.properties.{c}").alias(c) for c in (*_CITY_KEY, "place_name")]
    lines = written_lines(spark, path).select("value", *props)
    r = _rings(lines, *_CITY_KEY, "place_name")
    p = r.select(*_CITY_KEY, "place_name", "part", "ring", F.explode("points").alias("xy"))
    x, y = (F.round(F.col("xy")[i] * 100000).cast("long") for i in (0, 1))
    return p.select(*_CITY_KEY, "place_name", "part", "ring", x.alias("x"), y.alias("y")).distinct()


@register("export_hotspot_vertices", rg._zone_lonlat_sql().replace(
    "SELECT state_fips, place_fips, x AS x_m, y AS y_m, round(lon, 7) AS lon, round(lat, 7) AS lat",
    "SELECT DISTINCT place_fips, 'core' AS zone_type, 'type,geometry,properties' AS keys, "
    "CAST(round(lon * 100000) AS BIGINT) AS lon, CAST(round(lat * 100000) AS BIGINT) AS lat"))
def q_export_hotspot_vertices(spark, sf_dir):
    """E6 + A14 + G8 + G9: the core features as written, with the vertices of the dissolved zones (1e-5 degree)."""
    path = ex.write_hotspots(rg._hot(spark, sf_dir), rg._export_dir(spark))
    props = [F.get_json_object("value", f"$.properties.{c}").alias(c) for c in ("place_fips", "zone_type")]
    lines = written_lines(spark, path).select("value", *props, _keys()).where("zone_type = 'core'")
    p = _rings(lines, "place_fips", "zone_type", "keys").select("place_fips", "zone_type", "keys", F.explode("points").alias("xy"))
    lon, lat = (F.round(F.col("xy")[i] * 100000).cast("long") for i in (0, 1))
    return p.select("place_fips", "zone_type", "keys", lon.alias("lon"), lat.alias("lat")).distinct()


@register("export_file_sizes", f"""
    SELECT 'annual_fatalities' AS sink, count(DISTINCT state_fips || place_fips) AS files,
           CAST(sum({" + ".join(f"length(CAST({c} AS VARCHAR)) + {len(c) + 4}" for c in ("year", *sv.ANNUAL_COLS))} + 2) AS BIGINT) AS bytes
    FROM sp_annual_city
    UNION ALL
    SELECT 'crashes_metadata', 1, length('{{"min_year":' || CAST(min(year) AS VARCHAR) || ',"max_year":' || CAST(max(year) AS VARCHAR) || '}}') + 1
    FROM sp_crashes""")
def q_export_file_sizes(spark, sf_dir):
    """Files and bytes of two sinks, whose text the oracle spells out (a city's folder holds one file)."""
    out = rg._export_dir(spark)
    ex.write_crashes_metadata(sp.crash_points(spark, sf_dir), out)
    ex.write_annual(_annual(spark, sf_dir), out)
    return ex.export_sizes(spark, out)
