"""Hotspot grid cells, dissolve and buffer.

* G2/G8: Albers equal-area conic (EPSG:5070 parameters, GRS80) forward and
  inverse as native column expressions (closed form, Snyder 1987).
* G3: snap to a 500 m grid — cell id = rint(x / 500) (half-even), the
  snapped point being the cell centre.
* A11/W5: crash counts per (city, cell) and ``percent_rank`` within the
  city (a window partitioned by city, so cities spread over tasks).
* G4/G5: dissolve hot cells per city by *edge cancellation*: every cell
  emits its 4 directed edges on an integer lattice (250 m units); an
  undirected edge seen twice is interior and dropped.  Area follows from
  the shoelace sum over the kept directed edges — exact integers.
* G7: a mitre buffer of 250 m around axis-aligned cells equals dilation by a
  square: each hot cell covers 4x4 sub-cells of 250 m; distinct sub-cells are
  dissolved the same way.
* G9/U1/E6: rings are assembled by pointer doubling over the boundary edges
  (``overlay``), projected back to lon/lat and emitted as one GeoJSON feature
  per line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators import overlay as ov
from roadstats.operators import spatial as sa
from roadstats.session import reliable_checkpoint

CITY_KEY = ("state_fips", "place_fips")

# FIXED VALUES: EPSG:5070 (NAD83 / Conus Albers) on the GRS80 ellipsoid and
# the hotspot parameters.
A_AXIS = 6378137.0
INV_F = 298.257222101
LAT_1, LAT_2, LAT_0, LON_0 = 29.5, 45.5, 23.0, -96.0
GRID_M = 500
BUFFER_M = 250
HOT_THRESHOLD = 0.85
MIN_YEAR = 2001
PRECISION = 5
SUB_M = 250          # lattice unit for edges (half a cell)

_F = 1.0 / INV_F
E2 = 2 * _F - _F * _F
E = math.sqrt(E2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - (1 / (2 * E)) * math.log((1 - E * s) / (1 + E * s)))


def _m(phi: float) -> float:
    s = math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - E2 * s * s)


_P1, _P2, _P0 = (math.radians(v) for v in (LAT_1, LAT_2, LAT_0))
N_CONE = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
C_CONE = _m(_P1) ** 2 + N_CONE * _q(_P1)
RHO_0 = A_AXIS * math.sqrt(C_CONE - N_CONE * _q(_P0)) / N_CONE


def albers_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) metres in EPSG:5070 from lon/lat degrees (datum shift ignored)."""
    phi = F.radians(lat)
    s = F.sin(phi)
    es = F.lit(E) * s
    q = F.lit(1 - E2) * (s / (F.lit(1.0) - F.lit(E2) * s * s)
                         - F.lit(1 / (2 * E)) * F.log((F.lit(1.0) - es) / (F.lit(1.0) + es)))
    rho = F.lit(A_AXIS) * F.sqrt(F.lit(C_CONE) - F.lit(N_CONE) * q) / F.lit(N_CONE)
    theta = F.lit(N_CONE) * F.radians(lon - F.lit(LON_0))
    return rho * F.sin(theta), F.lit(RHO_0) - rho * F.cos(theta)


def with_albers_inverse(df: DataFrame, x: str = "x", y: str = "y", lon: str = "lon",
                        lat: str = "lat", iterations: int = 8) -> DataFrame:
    """(lon, lat) degrees from EPSG:5070 metres as new columns; latitude
    by a fixed number of iterations, one projection per iteration (each step
    refers to the previous latitude column, so the expression does not grow
    with the iteration count)."""
    dy = F.lit(RHO_0) - F.col(y)
    rho2 = F.col(x) * F.col(x) + dy * dy
    q = (F.lit(C_CONE) - rho2 * F.lit(N_CONE * N_CONE / (A_AXIS * A_AXIS))) / F.lit(N_CONE)
    out = df.withColumn("_q", q).withColumn("_phi", F.asin(F.col("_q") / F.lit(2.0)))
    for _ in range(iterations):
        phi = F.col("_phi")
        s = F.sin(phi)
        es = F.lit(E) * s
        one = F.lit(1.0) - F.lit(E2) * s * s
        out = out.withColumn("_phi", phi + one * one / (F.lit(2.0) * F.cos(phi)) * (
            F.col("_q") / F.lit(1 - E2) - s / one
            + F.lit(1 / (2 * E)) * F.log((F.lit(1.0) - es) / (F.lit(1.0) + es))))
    theta = F.atan2(F.col(x), F.lit(RHO_0) - F.col(y))
    return (out.withColumn(lon, F.degrees(theta / F.lit(N_CONE)) + F.lit(LON_0))
            .withColumn(lat, F.degrees(F.col("_phi"))).drop("_q", "_phi"))


def snap(v: Column, size: int = GRID_M) -> Column:
    """Cell id of a coordinate (half-even rint, so -0.0 becomes 0)."""
    return F.rint(v / F.lit(float(size))).cast("long")


def project_points(crashes: DataFrame, size: int = GRID_M) -> DataFrame:
    """G2 + G3: projected metres and cell ids for located crashes."""
    located = crashes.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    x, y = albers_forward(F.col("lon"), F.col("lat"))
    return located.withColumn("x", x).withColumn("y", y) \
        .withColumn("cx", snap(F.col("x"), size)).withColumn("cy", snap(F.col("y"), size))


def cell_counts(points: DataFrame, key=CITY_KEY) -> DataFrame:
    """Crashes per (city, cell)."""
    return points.groupBy(*key, "cx", "cy").agg(F.count(F.lit(1)).alias("crash_count"))


def rank_cells(counts: DataFrame, threshold: float = HOT_THRESHOLD, key=CITY_KEY) -> DataFrame:
    """percent_rank of crash_count within the city; hot when >= threshold."""
    w = Window.partitionBy(*key).orderBy("crash_count")
    return counts.withColumn("pct_rank", F.percent_rank().over(w)) \
        .withColumn("is_hot", F.col("pct_rank") >= F.lit(threshold))


def _cell_edges(cells: DataFrame, x0: Column, y0: Column, side: int, key) -> DataFrame:
    """4 directed CCW edges of axis-aligned squares with lower-left corner
    (x0, y0) and side ``side`` (lattice units)."""
    s = F.lit(side)
    pts = [(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s)]
    segs = [F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
            for a, b in zip(pts, pts[1:] + pts[:1])]
    return cells.select(*key, F.explode(F.array(*segs)).alias("e")).select(*key, "e.*")


def dissolve_edges(edge_tab: DataFrame, key) -> DataFrame:
    """Boundary of a union of non-overlapping squares: undirected edges that
    occur once (shared sides cancel); keeps the original direction."""
    a = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    b = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    g = edge_tab.groupBy(*key, lo.alias("_a"), hi.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("x1", "y1", "x2", "y2")).alias("_e"))
    return g.filter(F.col("_n") == 1).select(*key, "_e.*")


def core_edges(hot: DataFrame, key=CITY_KEY) -> DataFrame:
    """G4 + G5: dissolved boundary of the hot cells, in 250 m lattice units
    (cell (i, j) spans [2i-1, 2i+1] x [2j-1, 2j+1])."""
    e = _cell_edges(hot, F.col("cx") * 2 - 1, F.col("cy") * 2 - 1, 2, key)
    return dissolve_edges(e, key)


def buffer_subcells(hot: DataFrame, key=CITY_KEY) -> DataFrame:
    """250 m sub-cells covered by the 250 m mitre buffer of hot cells:
    sub-cells 2i-2 .. 2i+1 on each axis, de-duplicated."""
    return (hot.select(*key, "cx", "cy",
                       F.explode(F.sequence(F.col("cx") * 2 - 2, F.col("cx") * 2 + 1)).alias("sx"))
            .select(*key, "sx",
                    F.explode(F.sequence(F.col("cy") * 2 - 2, F.col("cy") * 2 + 1)).alias("sy"))
            .distinct())


def buffer_edges(hot: DataFrame, key=CITY_KEY) -> DataFrame:
    sub = buffer_subcells(hot, key)
    return dissolve_edges(_cell_edges(sub, F.col("sx"), F.col("sy"), 1, key), key)


def edge_area(edge_tab: DataFrame, key, unit_m: int = SUB_M) -> DataFrame:
    """Shoelace area (m²) and edge count of dissolved zones per city."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edge_tab.groupBy(*key).agg(
        (twice * F.lit(unit_m * unit_m) / F.lit(2)).cast("long").alias("area_m2"),
        F.count(F.lit(1)).alias("boundary_edges"))


def zone_summary(hot: DataFrame, key=CITY_KEY) -> DataFrame:
    """Per city: hot cells, dissolved core area, buffered area (G5, G7).  The
    hot set is read three times, so it is computed once."""
    k = list(key)
    hot = reliable_checkpoint(hot.select(*k, "cx", "cy"))
    n = hot.groupBy(*k).agg(F.count(F.lit(1)).alias("hot_cells"))
    core = edge_area(core_edges(hot, k), k).withColumnRenamed("area_m2", "core_area_m2") \
        .withColumnRenamed("boundary_edges", "core_edges")
    buf = edge_area(buffer_edges(hot, k), k).withColumnRenamed("area_m2", "buffer_area_m2") \
        .withColumnRenamed("boundary_edges", "buffer_edges")
    return n.join(core, k, "left").join(buf, k, "left")


# ---------------------------------------------------------------------------
# GeoJSON features
# ---------------------------------------------------------------------------

def zone_features(hot: DataFrame, key=CITY_KEY) -> DataFrame:
    """U1 + G8 + G9: (key, zone_type, feature): one GeoJSON feature (string) per
    city and zone type ('core', 'buffer').  Rings are ranked edge by edge over
    all zones together (``overlay.ring_vertices``), so a zone of any size is
    many tasks' work until its feature is written as one value."""
    k = [*key, "zone_type"]
    hot = reliable_checkpoint(hot.select(*key, "cx", "cy"))
    both = (core_edges(hot, key).withColumn("zone_type", F.lit("core"))
            .unionByName(buffer_edges(hot, key).withColumn("zone_type", F.lit("buffer"))))
    half = both.select(*k, *[(F.col(c) * 2).cast("long").alias(d)
                             for c, d in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))])
    v = ov.ring_vertices(half, k)
    metres = v.withColumns({c: F.col(c) / 2 * F.lit(float(SUB_M)) for c in ("x", "y")})
    v = with_albers_inverse(metres, "x", "y", "_lon", "_lat").drop("x", "y") \
        .withColumnsRenamed({"_lon": "x", "_lat": "y"})
    shapes = sa.geojson_geometries(v, k, PRECISION)
    properties = F.to_json(F.struct("place_fips", "zone_type"))
    return shapes.select(*k, F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"),
                                      F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))
