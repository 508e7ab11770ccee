"""Stand-in entities derived from the driver tables.

The reference's inputs (crash and person files, city boundaries,
populations) are not shipped, so each entity is derived from a TPC-H-style
driver table by a fixed rule (documented per function).  Every rule is a
projection or join of the driver tables, so the work grows with them.

Keys: a crash is (st_case, year); in the stand-ins st_case (= o_orderkey)
is already unique, so persons refer to their crash by st_case alone
(``PERSON_CRASH_KEY``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.functions import dims
from roadstats.functions.exprs import zfill
from roadstats.operators.loads import first_wins
from roadstats.operators.subtypes import SUBTYPE_COLS, crash_subtype_counts
from roadstats.session import light_tasks_session, scale_tag, shared_dir
from roadstats.sources.tables import table

PERSON_CRASH_KEY = ("st_case",)
CRASH_KEY = ("st_case", "year")

# FIXED VALUES of the stand-in rules (see FIXTURES.md §B).
PERSON_TYPE_CYCLE = [1, 2, 3, 9, 5, 10, 6, 7, 4, 8, 11, 12, 13, 19, 99, 88]
POLYGON_TEMPLATE = [(0.05, 0.05), (0.95, 0.05), (0.95, 0.45), (0.45, 0.45),
                    (0.45, 0.95), (0.05, 0.95)]
TILE_LON0, TILE_LAT0, TILE_W, TILE_H, TILE_COLS = -125.0, 24.5, 11.6, 4.9, 5
POLYGON_SHIFT = 0.00037
ROUTE_CODE_MOD = 15          # route_code = o_orderkey % 15 + 1 (14, 15 unknown)
# A reading task sorts its person rows to drop duplicates before the shuffle: 16 MB of the compressed file are about
# 130 MB of rows, 128 MB were a GB, which spilled.
PERSON_SPLIT = "16m"
CITY_CODE_STEP = 37          # city code of a nation = nation * 37
TABLE_VERSION = 1            # part of the loaded-table path: bump when a rule changes
LOADED_CRASH_SCHEMA = (
    "st_case bigint, year int, crash_date date, state string, state_name string, "
    "county string, city string, fars_city_name string, fips_city_name string, "
    "place_fips string, route_code int, road_label string, lon double, lat double, "
    "total_fatalities int, motorist_fatalities int, pedestrian_fatalities int, "
    "cyclist_fatalities int, other_fatalities int")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with population and pledge flag, one per customer.

    state_fips = zfill(c_nationkey, 2), place_fips = zfill(c_custkey, 5),
    population = floor(c_acctbal * 20), is_pledged = segment 'BUILDING'.
    """
    c = table(spark, sf_dir, "customer").select(
        zfill(F.col("c_nationkey"), 2).alias("state_fips"),
        zfill(F.col("c_custkey"), 5).alias("place_fips"),
        F.col("c_name").alias("place_name"),
        F.floor(F.col("c_acctbal") * F.lit(20.0)).cast("int").alias("population"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_pledged"),
    )
    c = c.join(F.broadcast(dims.state_dim(spark)), "state_fips", "left")
    c = c.join(F.broadcast(dims.display_name_dim(spark)), "place_name", "left") \
        .withColumn("display_name", F.coalesce("display_name", "place_name"))
    return c.select("state_fips", "place_fips", "place_name", "display_name",
                    "state_name", "population", "is_pledged")


def raw_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows as read from the files, duplicates included.

    st_case = l_orderkey, vehicle_number = l_linenumber, person_number =
    l_suppkey, person_type cycles through the code list by l_partkey % 16,
    injury_severity R -> 4 (fatal), A -> 3, else 0.  ``load_order`` defines
    which duplicate is "first".
    """
    li = table(spark, sf_dir, "lineitem", PERSON_SPLIT)
    cycle = F.array(*[F.lit(x) for x in PERSON_TYPE_CYCLE])
    return li.select(
        F.col("l_orderkey").alias("st_case"),
        F.col("l_linenumber").cast("int").alias("vehicle_number"),
        F.col("l_suppkey").cast("int").alias("person_number"),
        F.element_at(cycle, (F.col("l_partkey") % 16 + 1).cast("int")).alias("person_type"),
        F.when(F.col("l_returnflag") == "R", 4)
         .when(F.col("l_returnflag") == "A", 3).otherwise(0).alias("injury_severity"),
        F.struct(F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_quantity"),
                 F.col("l_shipdate")).alias("load_order"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded person table: first row wins per (crash, vehicle, person)."""
    return first_wins(raw_persons(spark, sf_dir),
                      [*PERSON_CRASH_KEY, "vehicle_number", "person_number"],
                      ["load_order"]).drop("load_order")


def city_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-code table: one code per nation (nation * 37), name = n_name."""
    n = table(spark, sf_dir, "nation")
    return n.select(zfill(F.col("n_nationkey"), 2).alias("state_code"),
                    zfill(F.col("n_nationkey") * CITY_CODE_STEP, 4).alias("fars_city_code"),
                    F.col("n_name").alias("fars_city_name"))


def crash_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash key, state and location only (the input of the spatial join)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    located = (k % 17) != 0
    return o.select(
        k.alias("st_case"),
        F.year("o_orderdate").alias("year"),
        F.when(located, F.lit(-125.0) + ((k * 7919) % 58000).cast("double") / F.lit(1000.0))
         .alias("lon"),
        F.when(located, F.lit(24.5) + ((k * 104729) % 24500).cast("double") / F.lit(1000.0))
         .alias("lat"),
    )


def crash_inputs(sf_dir: str) -> list[str]:
    """The files that ``crashes`` and ``raw_persons`` read and shuffle."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "lineitem")]


def crashes(spark: SparkSession, sf_dir: str, person_table: DataFrame | None = None,
            with_subtypes: bool = True) -> DataFrame:
    """The typed crash table.

    orders ⋈ customer gives state; place_fips is null when o_orderkey % 10 = 0
    or o_custkey % 37 = 0, else zfill(o_custkey, 5).  Subtype counts come
    from A1 over the loaded persons; total_fatalities counts every fatal
    person, unrecognised codes included.
    """
    spark = light_tasks_session(spark, *crash_inputs(sf_dir))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    located = (k % 17) != 0
    base = o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        k.alias("st_case"),
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("crash_date"),
        zfill(F.col("c_nationkey"), 2).alias("state"),
        zfill(F.col("o_custkey") % 1000, 3).alias("county"),
        zfill(F.col("c_nationkey") * CITY_CODE_STEP, 4).alias("city"),
        F.when((k % 10 == 0) | (F.col("o_custkey") % 37 == 0), F.lit(None).cast("string"))
         .otherwise(zfill(F.col("o_custkey"), 5)).alias("place_fips"),
        (k % ROUTE_CODE_MOD + 1).cast("int").alias("route_code"),
        F.when(located, F.lit(-125.0) + ((k * 7919) % 58000).cast("double") / F.lit(1000.0))
         .alias("lon"),
        F.when(located, F.lit(24.5) + ((k * 104729) % 24500).cast("double") / F.lit(1000.0))
         .alias("lat"),
    )
    base = (base.join(F.broadcast(dims.state_dim(spark)).withColumnRenamed("state_fips", "state"),
                      "state", "left")
            .withColumn("state_name", F.coalesce("state_name", F.lit("ERROR")))
            .join(F.broadcast(dims.route_dim(spark)), "route_code", "left")
            .withColumn("road_label", F.coalesce("road_label", F.lit("Unknown"))))
    # N6 with the city-name column absent: code 0000 / >= 9000 ->
    # Unincorporated, else the code-table name, else ERROR.  The code table
    # is derived from nation (25 rows at every scale) -> broadcast.
    codes = city_codes(spark, sf_dir).withColumnRenamed("state_code", "state") \
        .withColumnRenamed("fars_city_code", "city")
    base = base.join(F.broadcast(codes), ["state", "city"], "left").withColumn(
        "fars_city_name",
        F.when((F.col("city") == "0000") | (F.col("city") >= "9000"), F.lit("Unincorporated"))
         .otherwise(F.coalesce("fars_city_name", F.lit("ERROR"))))
    base = base.withColumn("fips_city_name", F.lit(None).cast("string"))
    cols = ["st_case", "year", "crash_date", "state", "state_name", "county", "city",
            "fars_city_name", "fips_city_name", "place_fips", "route_code", "road_label",
            "lon", "lat"]
    base = base.select(*cols)
    if not with_subtypes:
        return base
    p = person_table if person_table is not None else persons(spark, sf_dir)
    counts = crash_subtype_counts(p, PERSON_CRASH_KEY)
    j = base.join(counts, list(PERSON_CRASH_KEY), "left")
    return j.select(
        *cols,
        F.coalesce("fatal_persons", F.lit(0)).alias("total_fatalities"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in SUBTYPE_COLS],
    )


def loaded_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crash table as the analytics read it: ``crashes`` written once
    per scale to ``<shared dir>/roadstats_tables/v<N>/<sf>/crashes``,
    partitioned by ``year`` (the reference loads its crash table once and
    every later stage reads it; so do these).

    The write is range-partitioned on (year, state, st_case), so a year
    holding a third of all rows is spread over many tasks, and sorted by
    state inside each file (row-group statistics prune state filters).
    Readers get year partition pruning (``year >= 2001``, ten-year window).
    A missing ``_SUCCESS`` marker (interrupted write) means it is rewritten.
    """
    tag = scale_tag(sf_dir)
    path = f"{shared_dir(spark)}/roadstats_tables/v{TABLE_VERSION}/{tag}/crashes"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        # no fixed count: partitions by the size of the inputs, of which AQE
        # coalesces small ones
        (crashes(spark, sf_dir).repartitionByRange("year", "state", "st_case")
         .sortWithinPartitions("year", "state", "st_case")
         .write.mode("overwrite").partitionBy("year").parquet(path))
    # explicit schema: no footer-reading job to infer it on every read
    return spark.read.schema(LOADED_CRASH_SCHEMA).parquet(path).select(
        *[c.split(" ")[0] for c in LOADED_CRASH_SCHEMA.split(", ")])


def polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City polygons as a vertex table (state, place, part, ring, seq, x, y).

    One L-shaped polygon per nation on a 5x5 tiling of lon -125..-67,
    lat 24.5..49; every vertex is shifted by +0.00037 deg so no lattice
    point lies on an edge.  Rings are open (the closing edge is implied).
    """
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tmpl = F.array(*[F.struct(F.lit(x).alias("rx"), F.lit(y).alias("ry"))
                     for x, y in POLYGON_TEMPLATE])
    col_i = (F.col("n_nationkey") % TILE_COLS).cast("double")
    row_i = F.floor(F.col("n_nationkey") / TILE_COLS).cast("double")
    v = n.select("n_nationkey", "n_name", F.posexplode(tmpl).alias("seq", "v"))
    return v.select(
        zfill(F.col("n_nationkey"), 2).alias("state_fips"),
        zfill(F.col("n_nationkey"), 5).alias("place_fips"),
        F.col("n_name").alias("place_name"),
        F.lit(0).alias("part"), F.lit(0).alias("ring"),
        F.col("seq").cast("int").alias("seq"),
        (F.lit(TILE_LON0) + col_i * F.lit(TILE_W) + F.col("v.rx") * F.lit(TILE_W)
         + F.lit(POLYGON_SHIFT)).alias("x"),
        (F.lit(TILE_LAT0) + row_i * F.lit(TILE_H) + F.col("v.ry") * F.lit(TILE_H)
         + F.lit(POLYGON_SHIFT)).alias("y"),
    )


# FIXED VALUES of ``footprints``: outer ring, and hole if any, by c_custkey % 6, in hundredths of a degree
# from the block's corner; s = floor(c_acctbal) mod 4.
FOOTPRINT_UNIT = 0.01
FOOTPRINT_FRAME = ((-3, -3, 20, 16), (-2, -2, 14, 13))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose polygons overlap: a vertex table with ``block`` = floor(c_custkey / 6).

    The six customers of a block are, by c_custkey % 6: an L; a square half over it; a square
    within it; the same L again (s even) or its lower bar; a bar that touches the L from the right
    along a part of its side; and a frame around all (with a hole, whose right border the bar may touch).
    """
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.pmod(F.floor("c_acctbal").cast("int"), F.lit(4)).alias("s"))
    k, s = F.col("c_custkey") % 6, F.col("s")

    def rect(x0, y0, x1, y1):
        x0, y0, x1, y1 = (v if isinstance(v, Column) else F.lit(v) for v in (x0, y0, x1, y1))
        return F.array(*[F.array(x.cast("int"), y.cast("int")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])

    ell = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10))])
    rings = (F.when(k == 0, F.array(ell)).when(k == 1, F.array(rect(s + 4, 3, s + 12, 9)))
             .when(k == 2, F.array(rect(1, 1, 3, 3))).when((k == 3) & (s % 2 == 0), F.array(ell))
             .when(k == 3, F.array(rect(0, 0, 10, 5))).when(k == 4, F.array(rect(10, s, 14, s + 4)))
             .otherwise(F.array(*[rect(*r) for r in FOOTPRINT_FRAME])))
    block = F.floor(F.col("c_custkey") / 6)
    v = c.select(zfill(F.col("c_nationkey"), 2).alias("state_fips"), zfill(F.col("c_custkey"), 5).alias("place_fips"),
                 block.alias("block"), F.posexplode(rings).alias("ring", "points"))
    v = v.select("state_fips", "place_fips", "block", "ring", F.posexplode("points").alias("seq", "xy"))
    x0 = F.lit(TILE_LON0) + F.col("block") % 500 * F.lit(0.1)
    y0 = F.lit(TILE_LAT0) + F.floor(F.col("block") / 500) % 200 * F.lit(0.1)
    return v.select("state_fips", "place_fips", "block", F.lit(0).alias("part"), "ring", "seq",
                    (x0 + F.col("xy")[0] * F.lit(FOOTPRINT_UNIT)).alias("x"),
                    (y0 + F.col("xy")[1] * F.lit(FOOTPRINT_UNIT)).alias("y"))


# FIXED VALUES of ``board_places``: a millionth of a degree, a square's side, points on it, and by kind how far its
# middle lies off the straight line.
BOARD_SCALE, BOARD_SIDE, BOARD_STEPS, BOARD_COLS = 1_000_000, 100_000, 4, 50
BOARD_OFFSETS = (0, 50, 150)


def board_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with common borders: customer k is the square (k % 50, k // 50) of a board, as a vertex table.

    Each border has three points between its corners; the middle one lies 0, 50 or 150 millionths of a degree off, by
    (7 column + 13 row) % 3 for the border below a square and (5 column + 11 row) % 3 for the one left of it.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    col, row = F.col("c_custkey") % BOARD_COLS, F.floor(F.col("c_custkey") / BOARD_COLS)
    off = F.array(*[F.lit(o) for o in BOARD_OFFSETS])

    def border(cx, cy, level, back):
        kind = F.pmod(cx * (7 if level else 5) + cy * (13 if level else 11), F.lit(len(BOARD_OFFSETS)))
        far = F.element_at(off, (kind + 1).cast("int"))
        steps = range(BOARD_STEPS, 0, -1) if back else range(BOARD_STEPS)
        points = []
        for i in steps:
            along, aside = F.lit(i * BOARD_SIDE // BOARD_STEPS), far if i * 2 == BOARD_STEPS else F.lit(0)
            x, y = (along, aside) if level else (aside, along)
            points.append(F.array((cx * BOARD_SIDE + x).cast("long"), (cy * BOARD_SIDE + y).cast("long")))
        return points

    ring = F.array(*border(col, row, True, False), *border(col + 1, row, False, False),
                   *border(col, row + 1, True, True), *border(col, row, False, True))
    v = c.select(zfill(F.col("c_nationkey"), 2).alias("state_fips"), zfill(F.col("c_custkey"), 5).alias("place_fips"),
                 F.posexplode(ring).alias("seq", "xy"))
    return v.select("state_fips", "place_fips", F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq",
                    (F.col("xy")[0] / F.lit(BOARD_SCALE)).alias("x"), (F.col("xy")[1] / F.lit(BOARD_SCALE)).alias("y"))


def hotspot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct grid-cell ids for the hotspot operators.

    place = c_nationkey, cx = o_orderkey^2 mod 29 (computed from the residue,
    so it never overflows), cy = o_orderkey*7 mod 5.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    r = F.col("o_orderkey") % 29
    return o.join(c, o.o_custkey == c.c_custkey).select(
        zfill(F.col("c_nationkey"), 2).alias("state_fips"),
        zfill(F.col("c_nationkey"), 5).alias("place_fips"),
        F.col("o_orderkey").alias("st_case"),
        ((r * r) % 29).cast("long").alias("cx"),
        ((F.col("o_orderkey") % 5) * 7 % 5).cast("long").alias("cy"),
    )


def flawed_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded crash table with defects, by k = st_case: twice (k % 31 = 0), no state (37), a date before
    1987 (41), -1 deaths (43), 31 to 35 deaths (47), one death too many for the sum (53), motorists unknown
    (59), a longitude of 200 (61), no date (67), no year (101), no st_case (103).  Of two rules for one
    column the first holds.
    """
    k = F.col("st_case")
    c = loaded_crashes(spark, sf_dir)
    c = c.withColumn("_copy", F.explode(F.when(k % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tot = F.col("total_fatalities")
    return c.withColumns({
        "state": F.when(k % 37 != 0, F.col("state")),
        "crash_date": F.when(k % 41 == 0, F.lit("1986-12-31").cast("date")).when(k % 67 != 0, F.col("crash_date")),
        "total_fatalities": F.when(k % 43 == 0, F.lit(-1)).when(k % 47 == 0, (k % 5 + 31).cast("int"))
        .when(k % 53 == 0, tot + 1).otherwise(tot),
        "motorist_fatalities": F.when(k % 59 != 0, F.col("motorist_fatalities")),
        "lon": F.when((k % 61 == 0) & F.col("lon").isNotNull(), F.lit(200.0)).otherwise(F.col("lon")),
        "year": F.when(k % 101 != 0, F.col("year")),
        "st_case": F.when(k % 103 != 0, k)}).drop("_copy")


#: Rules of ``spread_points``: the years are spread over groups of three more.
SPREAD_GROUPS, SPREAD_STEP = 4, 3


def spread_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash points over more than ten years: year + (st_case % 4) * 3."""
    return crash_points(spark, sf_dir).withColumn(
        "year", (F.col("year") + F.col("st_case") % SPREAD_GROUPS * SPREAD_STEP).cast("int"))


def titled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary features whose names need the display-name table, one per customer: place k has the
    (k % 9)-th of its first six names, others their own; k % 5 = 0 has a later second feature named 'Later'."""
    names = F.array(*[F.lit(n) for n, _ in dims.DISPLAY_NAMES[:6]])
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    orders = F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    f = c.select(k, "c_name", "c_nationkey", F.explode(orders).alias("load_order"))
    return f.select(zfill(F.col("c_nationkey"), 2).alias("state_fips"), zfill(k, 5).alias("place_fips"),
                    F.when(F.col("load_order") == 2, "Later")
                    .when(k % 9 < 6, F.element_at(names, (k % 9 + 1).cast("int")))
                    .otherwise(F.col("c_name")).alias("place_name"), F.lit("25").alias("place_type"), "load_order")
