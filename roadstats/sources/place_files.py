"""City-side input files: stand-in generator and scans.

The source read an ACS population JSON, a geocoded city-point CSV, a
pledged-city CSV, a FARS city-code CSV and one boundary layer per state.
``ensure_place_files`` derives each from the driver tables with Spark and
writes them once to ``<shared dir>/roadstats_place_raw/v<N>/<sf>/``.
Rules (FIXED VALUES of the stand-in, mirrored by the oracles), with
``c = c_custkey``, ``n = c_nationkey``:

* ``populations/`` — one JSON array-of-arrays per state, header row
  ``["NAME","B01003_001E","state","place"]``; NAME = c_name + a legal
  suffix chosen by c % 6 (" city", " town", " CDP", " city and borough",
  " village", none) + ", " + state name (``State <fips>`` for codes that
  are not states); a second row with population + 1 when c % 47 = 0 (first
  wins); an extra Puerto Rico row (state "72") when c % 53 = 0
* ``city_points.csv`` — places with population > 100000: status
  ``failed`` and blank coordinates when c % 7 = 0 (and then, when
  c % 3 = 0, the place name of override entry c % 11); ``ok`` with a blank
  longitude when c % 13 = 0; otherwise ``ok`` with the crash-location
  formulas applied to c
* ``pledged_cities.csv`` — no header; a title row, then one numbered row
  per BUILDING customer with c % 19 <> 0 (city = c_name, state name as
  above), then the four spelling-fix names and one row with an unknown
  state
* ``fars_city_codes.csv`` — one row per nation (n, n * 37, n_name) and a
  second row with the lower-case name when n % 5 = 0
* ``boundaries/`` — GeoJSON feature lines per state: the nation L-shape
  with three extra collinear points per edge (a Polygon) or, when n % 4 = 0, a MultiPolygon with an extra 0.5° square
  south of the tile; nation 3 appears twice (first wins)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.functions import dims
from roadstats.functions.exprs import zfill
from roadstats.session import scale_tag, shared_dir
from roadstats.sources import standins as sp
from roadstats.sources.file_heads import array_rows
from roadstats.sources.raw_files import _exists, _fs, _milli_text, _reset

GENERATOR_VERSION = 2

# FIXED VALUES of the generator (see module docstring).
POP_SUFFIXES = [" city", " town", " CDP", " city and borough", " village", ""]
POP_HEADER = ["NAME", "B01003_001E", "state", "place"]
POINT_HEADER = ["state_fips", "place_fips", "place_name", "state_name", "lon", "lat", "status"]
ISLAND_SIZE = 0.5
DENSIFY_STEPS = [0.0, 0.25, 0.5, 0.75]

GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([
        T.StructField("STATEFP", T.StringType()), T.StructField("PLACEFP", T.StringType()),
        T.StructField("NAME", T.StringType()), T.StructField("LSAD", T.StringType())])),
    # kept as raw JSON text: Polygon and MultiPolygon nest differently
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])


def place_root(spark: SparkSession, sf_dir: str) -> str:
    tag = scale_tag(sf_dir)
    return f"{shared_dir(spark)}/roadstats_place_raw/v{GENERATOR_VERSION}/{tag}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sp.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        zfill(F.col("c_nationkey"), 2).alias("state_fips"),
        zfill(F.col("c_custkey"), 5).alias("place_fips"),
        F.floor(F.col("c_acctbal") * F.lit(20.0)).cast("int").alias("population"))
    c = c.join(F.broadcast(dims.state_dim(spark)), "state_fips", "left")
    return c.withColumn("state_label", F.coalesce(
        F.col("state_name"), F.concat(F.lit("State "), F.col("state_fips"))))


def _write_lines(spark: SparkSession, lines: DataFrame, target: str, single: bool) -> None:
    """Write (part_key, ord, line) rows as text, one file per part_key."""
    stage = f"{target}_stage"
    (lines.repartition("part_key").sortWithinPartitions("part_key", "ord")
     .select("part_key", "line").write.mode("overwrite").partitionBy("part_key").text(stage))
    fs, stage_p = _fs(spark, stage)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target))
    for st in fs.listStatus(stage_p):
        name = st.getPath().getName()
        if not name.startswith("part_key="):
            continue
        key = name.split("=", 1)[1]
        for i, part in enumerate(f for f in fs.listStatus(st.getPath())
                                 if f.getPath().getName().startswith("part-")):
            fname = (f"{key}" if single else f"{key}_{i}")
            if not fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(target + "/" + fname)):
                raise OSError(f"could not move {part.getPath()} to {target}/{fname}")
    fs.delete(stage_p, True)


def ensure_place_files(spark: SparkSession, sf_dir: str) -> str:
    root = place_root(spark, sf_dir)
    if _exists(spark, f"{root}/_COMPLETE"):
        return root
    _reset(spark, root)   # an interrupted earlier run leaves no partial files behind
    c = _customers(spark, sf_dir)
    ck = F.col("c_custkey")
    # S5 populations: "[header" , ",[row]" ... , "]" per state file
    suffix = F.element_at(F.array(*[F.lit(s) for s in POP_SUFFIXES]), (ck % 6 + 1).cast("int"))
    name = F.concat(F.col("c_name"), suffix, F.lit(", "), F.col("state_label"))
    row = F.to_json(F.array(name, F.col("population").cast("string"), F.col("state_fips"),
                            F.col("place_fips")))
    base = c.select(F.col("state_fips").alias("part_key"), ck, row.alias("row"),
                    F.to_json(F.array(name, (F.col("population") + 1).cast("string"),
                                      F.col("state_fips"), F.col("place_fips"))).alias("dup"),
                    F.to_json(F.array(F.concat(F.col("c_name"), F.lit(" zona urbana, Puerto Rico")),
                                      F.lit("1000"), F.lit("72"), F.col("place_fips")))
                    .alias("pr"))
    rows = base.select("part_key", (ck * 4).alias("ord"), F.concat(F.lit(","), "row").alias("line")) \
        .unionByName(base.filter(ck % 47 == 0).select(
            "part_key", (ck * 4 + 1).alias("ord"), F.concat(F.lit(","), "dup").alias("line"))) \
        .unionByName(base.filter(ck % 53 == 0).select(
            "part_key", (ck * 4 + 2).alias("ord"), F.concat(F.lit(","), "pr").alias("line")))
    states = c.select(F.col("state_fips").alias("part_key")).distinct()
    head = states.select("part_key", F.lit(-1).cast("long").alias("ord"),
                         F.lit("[" + "[" + ",".join(f'"{h}"' for h in POP_HEADER) + "]")
                         .alias("line"))
    tail = states.select("part_key", F.lit(2 ** 62).cast("long").alias("ord"),
                         F.lit("]").alias("line"))
    _write_lines(spark, head.unionByName(rows).unionByName(tail), f"{root}/populations", True)

    # S6 city points
    big = c.filter(F.col("population") > 100000)
    ov = F.array(*[F.lit(n) for n, _, _ in dims.POINT_OVERRIDES])
    failed = ck % 7 == 0
    pname = F.when(failed & (ck % 3 == 0),
                   F.element_at(ov, (ck % len(dims.POINT_OVERRIDES) + 1).cast("int"))) \
        .otherwise(F.col("c_name"))
    lon_m = F.lit(-125000) + (ck * 7919) % 58000
    lat_m = F.lit(24500) + (ck * 104729) % 24500
    pts = big.select(
        F.lit("points").alias("part_key"), ck.alias("ord"),
        F.concat_ws(",", "state_fips", "place_fips", pname, F.col("state_label"),
                    F.when(failed | (ck % 13 == 0), F.lit("")).otherwise(_milli_text(lon_m)),
                    F.when(failed, F.lit("")).otherwise(_milli_text(lat_m)),
                    F.when(failed, F.lit("failed")).otherwise(F.lit("ok"))).alias("line"))
    pts_head = spark.range(1).select(F.lit("points").alias("part_key"),
                                     F.lit(-1).cast("long").alias("ord"),
                                     F.lit(",".join(POINT_HEADER)).alias("line"))
    _write_lines(spark, pts_head.unionByName(pts), f"{root}/city_points", True)

    # S7 pledged list (no header; title row skipped by the digit rule)
    pl = c.filter((F.col("c_mktsegment") == "BUILDING") & (ck % 19 != 0)).select(
        F.lit("pledged").alias("part_key"), ck.alias("ord"),
        F.concat_ws(",", ck.cast("string"), F.col("c_name"), F.col("state_label")).alias("line"))
    extra = [("Washington DC", "Anywhere"), ("Ft. Lauderdale", "Florida"), ("Macon", "Georgia"),
             ("New York City", "New York"), ("Springfield", "Atlantis")]
    ex = spark.createDataFrame(
        [("pledged", 2 ** 61 + i, f"{900000 + i},{a},{b}") for i, (a, b) in enumerate(extra)],
        "part_key string, ord long, line string")
    title = spark.createDataFrame([("pledged", -1, "Rank,City,State")],
                                  "part_key string, ord long, line string")
    _write_lines(spark, title.unionByName(pl).unionByName(ex), f"{root}/pledged_cities", True)

    # S8 city codes
    n = sp.table(spark, sf_dir, "nation")
    code_rows = n.select(F.lit("codes").alias("part_key"), (F.col("n_nationkey") * 2).alias("ord"),
                         F.concat_ws(",", zfill(F.col("n_nationkey"), 2),
                                     zfill(F.col("n_nationkey") * 37, 4), F.col("n_name"))
                         .alias("line"))
    dup_rows = n.filter(F.col("n_nationkey") % 5 == 0).select(
        F.lit("codes").alias("part_key"), (F.col("n_nationkey") * 2 + 1).alias("ord"),
        F.concat_ws(",", zfill(F.col("n_nationkey"), 2), zfill(F.col("n_nationkey") * 37, 4),
                    F.lower(F.col("n_name"))).alias("line"))
    code_head = spark.createDataFrame(
        [("codes", -1, "state_code,fars_city_code,fars_city_name")],
        "part_key string, ord long, line string")
    _write_lines(spark, code_head.unionByName(code_rows).unionByName(dup_rows),
                 f"{root}/fars_city_codes", True)

    # S9 boundaries: GeoJSON features, one line each, one file per state
    v = sp.polygon_vertices(spark, sf_dir)
    ring = v.groupBy("state_fips", "place_fips", "place_name").agg(
        F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("pts"))
    # each edge gets three interior points on the straight line (removed
    # again by the G10 simplification)
    pts, n_pts = F.col("pts"), F.size("pts")

    def seg(i):
        a = F.element_at(pts, i + 1)
        b = F.element_at(pts, F.when(i + 1 < n_pts, i + 2).otherwise(F.lit(1)))
        return F.array(*[F.array(a["x"] + (b["x"] - a["x"]) * F.lit(t),
                                 a["y"] + (b["y"] - a["y"]) * F.lit(t))
                         for t in DENSIFY_STEPS])
    dense = F.flatten(F.transform(F.sequence(F.lit(0), n_pts - 1), seg))
    closed = F.concat(dense, F.array(dense[0]))
    x0 = F.col("pts")[0]["x"]
    y0 = F.col("pts")[0]["y"]
    sq = F.array(F.array(x0, y0 - 1), F.array(x0 + ISLAND_SIZE, y0 - 1),
                 F.array(x0 + ISLAND_SIZE, y0 - 1 + ISLAND_SIZE),
                 F.array(x0, y0 - 1 + ISLAND_SIZE), F.array(x0, y0 - 1))
    nat = F.col("place_fips").cast("int")
    multi = nat % 4 == 0
    geom = F.when(multi, F.struct(F.lit("MultiPolygon").alias("type"),
                                  F.to_json(F.array(F.array(closed), F.array(sq))).alias("coordinates"))) \
        .otherwise(F.struct(F.lit("Polygon").alias("type"),
                            F.to_json(F.array(closed)).alias("coordinates")))
    feat = ring.select(
        "state_fips", nat.alias("nat"),
        F.concat(F.lit('{"type":"Feature","properties":'),
                 F.to_json(F.struct(F.col("state_fips").alias("STATEFP"),
                                    F.col("place_fips").alias("PLACEFP"),
                                    F.col("place_name").alias("NAME"),
                                    F.lit("25").alias("LSAD"))),
                 F.lit(',"geometry":{"type":"'), geom["type"],
                 F.lit('","coordinates":'), geom["coordinates"], F.lit("}}")).alias("line"))
    lines = feat.select(F.col("state_fips").alias("part_key"), (F.col("nat") * 2).alias("ord"),
                        "line") \
        .unionByName(feat.filter(F.col("nat") == 3).select(
            F.col("state_fips").alias("part_key"), (F.col("nat") * 2 + 1).alias("ord"),
            F.regexp_replace("line", '"LSAD":"25"', '"LSAD":"99"').alias("line")))
    _write_lines(spark, lines, f"{root}/boundaries", False)

    fs, p = _fs(spark, f"{root}/_COMPLETE")
    fs.create(p, True).close()
    return root


# ---------------------------------------------------------------------------
# Scans
# ---------------------------------------------------------------------------

def scan_populations(spark: SparkSession, root: str) -> DataFrame:
    """Every population file (one JSON array of arrays per file), read by blocks; fields are looked up by their
    place in the file's first row."""
    return array_rows(spark, f"{root}/populations", POP_HEADER)


def scan_city_points(spark: SparkSession, root: str) -> DataFrame:
    """Geocoded city points (all strings)."""
    schema = ", ".join(f"{c} string" for c in POINT_HEADER)
    return (spark.read.option("header", True).schema(schema)
            .csv(f"{root}/city_points"))


def scan_pledged(spark: SparkSession, root: str) -> DataFrame:
    """Headerless pledged-city list; rows whose first cell is all digits."""
    df = spark.read.option("header", False).schema("_c0 string, _c1 string, _c2 string") \
        .csv(f"{root}/pledged_cities")
    return df.filter(F.col("_c0").rlike("^[0-9]+$")).select(
        F.col("_c1").alias("city_name"), F.col("_c2").alias("state_name"))


def scan_city_codes(spark: SparkSession, root: str) -> DataFrame:
    """FARS city-code table."""
    return (spark.read.option("header", True)
            .schema("state_code string, fars_city_code string, fars_city_name string")
            .csv(f"{root}/fars_city_codes"))


def scan_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """Boundary features -> vertex table (state, place, name, lsad, part,
    ring, seq, x, y) plus ``load_order``.  Rings are stored open (the
    closing vertex of GeoJSON is dropped)."""
    f = (spark.read.schema(GEOJSON_SCHEMA).option("recursiveFileLookup", True)
         .json(f"{root}/boundaries")
         .select(F.col("properties.STATEFP").alias("state_fips"),
                 F.col("properties.PLACEFP").alias("place_fips"),
                 F.col("properties.NAME").alias("place_name"),
                 F.col("properties.LSAD").alias("place_type"),
                 F.col("geometry.type").alias("gtype"), F.col("geometry.coordinates").alias("c"),
                 F.struct(F.col("_metadata.file_path").alias("file"),
                          F.monotonically_increasing_id().alias("row")).alias("load_order")))
    parts = F.when(F.col("gtype") == "Polygon",
                   F.array(F.from_json("c", "array<array<array<double>>>"))) \
        .otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    p = f.select("*", F.posexplode(parts).alias("part", "rings"))
    r = p.select("*", F.posexplode("rings").alias("ring", "pts"))
    v = r.select("state_fips", "place_fips", "place_name", "place_type", "load_order",
                 "part", "ring", F.size("pts").alias("_n"),
                 F.posexplode("pts").alias("seq", "xy"))
    closes = (F.col("seq") == F.col("_n") - 1) & (F.col("_n") > 1)
    return v.filter(~closes).select(
        "state_fips", "place_fips", "place_name", "place_type", "load_order",
        F.col("part").cast("int"), F.col("ring").cast("int"), F.col("seq").cast("int"),
        F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
