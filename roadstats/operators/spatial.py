"""Point-in-polygon assignment and polygon operators on vertex tables
(J4/G1, G12, G14, O4; unions are in ``overlay``).

Polygons are rows of a *vertex table* (state_fips, place_fips, part, ring,
seq, x, y); rings may be open or closed (the closing edge is always added;
a repeated first vertex only yields a zero-length edge).  The *edge table*
has one row per directed edge.

Spatial join (``assign_points``) without a nested-loop join:

* every polygon is covered by grid cells, of size ``cell`` where an edge
  passes through (*boundary* cells, found by clipping each edge to each grid
  row it spans) and up to 16 times as wide elsewhere (``cover_cells``); a cell
  without an edge is wholly inside or wholly outside, decided once per cell by
  testing its centre;
* points equi-join the cells on (level, cx, cy) once: points in *interior*
  cells are inside with no further work, points in boundary cells are
  refined by counting crossings of a rightward ray with the polygon's edges
  *of the same grid row* (half-open rule ``(y1 > py) != (y2 > py)``), odd =
  inside; points on an edge are not "within".  The cell brings these edges
  along (a few, as a row is as high as a fine cell), so the point table is
  read once and joined once.

All steps are equi-joins and aggregates, so Spark shuffles on cell / place
keys; a dense cell's points are dealt over ``SALTS`` tasks, each of which gets
the cell and its edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadstats.session import ship_package

PLACE_KEY = ("state_fips", "place_fips")
EPS = 1e-9
#: Levels of cover cells, how much coarser each is than the one below, and parts that a dense cell's points go to.
LEVELS, COARSER, SALTS = 3, 4, 8


def edges(vertices: DataFrame, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Directed edges (x1, y1) -> (x2, y2) per ring, closing edge included."""
    ring = [*key, "part", "ring"]
    w = Window.partitionBy(*ring).orderBy("seq")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        *ring, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(w), F.first("x").over(wall)).alias("x2"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(wall)).alias("y2"))


def _crossing(px: str, py: str, x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[F.Column, F.Column]:
    """(crosses, on_edge) of a rightward ray from (px, py) with an edge."""
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))
    p_x, p_y = F.col(px), F.col(py)
    straddles = (y1 > p_y) != (y2 > p_y)
    # only evaluated where the edge straddles the ray, so y2 != y1
    x_int = F.when(straddles, x1 + (p_y - y1) * (x2 - x1) / (y2 - y1))
    crosses = F.coalesce(straddles & (x_int > p_x), F.lit(False))
    cross = (x2 - x1) * (p_y - y1) - (y2 - y1) * (p_x - x1)
    on_edge = ((cross == 0) & (p_x >= F.least(x1, x2)) & (p_x <= F.greatest(x1, x2))
               & (p_y >= F.least(y1, y2)) & (p_y <= F.greatest(y1, y2)))
    return crosses, on_edge


def edge_rows(edge_tab: DataFrame, cell: float, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Each edge once per grid row its y-range spans (row = floor(y / cell))."""
    lo = F.floor(F.least("y1", "y2") / F.lit(cell))
    hi = F.floor(F.greatest("y1", "y2") / F.lit(cell))
    return edge_tab.select(*key, "x1", "y1", "x2", "y2",
                           F.explode(F.sequence(lo, hi)).alias("cy"))


def boundary_cells(rows: DataFrame, cell: float, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Cells an edge passes through: clip the edge to its row band and take
    the x-range (widened by EPS — a spurious boundary cell only costs a
    refine, a missed one would be wrong)."""
    c = F.lit(cell)
    y0 = F.col("cy") * c
    y1b = (F.col("cy") + 1) * c
    dy = F.col("y2") - F.col("y1")
    ya = F.greatest(y0, F.least("y1", "y2"))
    yb = F.least(y1b, F.greatest("y1", "y2"))
    xa = F.when(dy == 0, F.col("x1")).otherwise(
        F.col("x1") + (ya - F.col("y1")) * (F.col("x2") - F.col("x1")) / dy)
    xb = F.when(dy == 0, F.col("x2")).otherwise(
        F.col("x1") + (yb - F.col("y1")) * (F.col("x2") - F.col("x1")) / dy)
    lo = F.floor((F.least(xa, xb) - F.lit(EPS)) / c)
    hi = F.floor((F.greatest(xa, xb) + F.lit(EPS)) / c)
    return rows.select(*key, "cy", F.explode(F.sequence(lo, hi)).alias("cx")).distinct()


def cover_cells(edge_tab: DataFrame, boundary: DataFrame, cell: float,
                key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """(key, level, cx, cy): cells no edge passes through, as coarse as they come.

    A cell of a level is ``COARSER`` cells of the level below wide.  The coarsest
    level covers the bounding box; below it only cells that an edge passes through
    are split.  So their number grows with the outline, not with the area."""
    k = list(key)
    crossed = [boundary.select(*k, "cx", "cy")]
    for _ in range(LEVELS - 1):
        crossed.append(crossed[-1].select(*k, *[F.floor(F.col(c) / COARSER).alias(c) for c in ("cx", "cy")]).distinct())
    top = F.lit(cell * COARSER ** (LEVELS - 1))
    bb = edge_tab.groupBy(*k).agg(F.min(F.least("x1", "x2")).alias("minx"),
                                  F.max(F.greatest("x1", "x2")).alias("maxx"),
                                  F.min(F.least("y1", "y2")).alias("miny"),
                                  F.max(F.greatest("y1", "y2")).alias("maxy"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / top), F.floor(F.col(hi) / top)))
    cells = bb.select(*k, span("minx", "maxx").alias("cx"), "miny", "maxy").select(*k, "cx", span("miny", "maxy").alias("cy"))
    out = None
    for level in range(LEVELS - 1, -1, -1):
        free = cells.join(crossed[level], [*k, "cx", "cy"], "left_anti").select(*k, F.lit(level).alias("level"), "cx", "cy")
        out = free if out is None else out.unionByName(free)
        child = lambda c: F.explode(F.sequence(F.col(c) * COARSER, F.col(c) * COARSER + COARSER - 1))
        cells = crossed[level].select(*k, child("cx").alias("cx"), "cy").select(*k, "cx", child("cy").alias("cy"))
    return out


def classify_cells(edge_tab: DataFrame, cell: float,
                   key: Sequence[str] = PLACE_KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge rows, boundary cells, interior cells) for a polygon set; interior
    cells have a ``level`` (see ``cover_cells``), boundary cells are of level 0."""
    rows = edge_rows(edge_tab, cell, key)
    boundary = boundary_cells(rows, cell, key)
    size = F.lit(cell) * F.pow(F.lit(float(COARSER)), F.col("level"))
    centres = cover_cells(edge_tab, boundary, cell, key).withColumns(
        {"px": (F.col("cx") + 0.5) * size, "py": (F.col("cy") + 0.5) * size}).withColumn(
        "_row", F.floor(F.col("py") / F.lit(cell)))
    crosses, _ = _crossing("px", "py")
    interior = (centres.join(rows.withColumnRenamed("cy", "_row"), [*key, "_row"], "inner")
                .groupBy(*key, "level", "cx", "cy").agg(F.count_if(crosses).alias("n"))
                .filter(F.col("n") % 2 == 1).select(*key, "level", "cx", "cy"))
    return rows, boundary, interior


def assign_points(points: DataFrame, vertices: DataFrame, point_key: Sequence[str],
                  cell: float = 0.05, key: Sequence[str] = PLACE_KEY,
                  preferred: DataFrame | None = None) -> DataFrame:
    """For each point (lon, lat) strictly within a polygon, the polygon's
    key.  A point inside several polygons takes the ``preferred`` ones first
    (e.g. merged city targets), then the smallest key (deterministic).
    Returns (point_key…, key…)."""
    pk = list(point_key)
    place, key = list(key), [*key, "part"]
    # parity is taken per part: a point in two overlapping parts is inside (holes belong to their part)
    rows, boundary, interior = classify_cells(edges(vertices, place), cell, key)
    # one pass over the points: each meets the cells of every level once, by a salt that
    # spreads a dense cell over tasks
    at = lambda level: F.struct(F.lit(level).alias("level"), *[
        F.floor(F.col(v) / F.lit(cell * COARSER ** level)).alias(c) for v, c in (("lon", "cx"), ("lat", "cy"))])
    pts = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        *pk, "lon", "lat", F.pmod(F.xxhash64(*pk), F.lit(SALTS)).cast("int").alias("_salt"),
        F.explode(F.array(*[at(level) for level in range(LEVELS)])).alias("_at")).select(*pk, "lon", "lat", "_salt", "_at.*")
    # a boundary cell brings its outline's edges of its grid row
    row_edges = rows.groupBy(*key, "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    cells = (interior.select(*key, "level", "cx", "cy").withColumn("_edges", F.lit(None).cast(row_edges.schema["_edges"].dataType))
             .unionByName(boundary.join(row_edges, [*key, "cy"]).select(*key, F.lit(0).alias("level"), "cx", "cy", "_edges"))
             .withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))))
    hits = pts.join(cells, ["level", "cx", "cy", "_salt"], "inner")
    tested = lambda i: lambda e: _crossing("lon", "lat", *[e[c] for c in ("x1", "y1", "x2", "y2")])[i]
    crossed = F.size(F.filter("_edges", tested(0)))
    within = F.col("_edges").isNull() | ((crossed % 2 == 1) & ~F.exists("_edges", tested(1)))
    hits = hits.filter(within).select(*pk, *place)
    key = place
    if preferred is not None:
        pref = preferred.select(*key).withColumn("_pref", F.lit(0))
        hits = hits.join(pref, key, "left") \
            .withColumn("_pref", F.coalesce("_pref", F.lit(1)))
    else:
        hits = hits.withColumn("_pref", F.lit(1))
    best = hits.groupBy(*pk).agg(F.min(F.struct("_pref", *key)).alias("_b"))
    return best.select(*pk, *[F.col(f"_b.{k}").alias(k) for k in key])


def enrich_crash_locations(crashes: DataFrame, assignment: DataFrame,
                           places: DataFrame) -> DataFrame:
    """L7 of J4: located crashes within a place take its place_fips and
    display name; others keep their values (crash state is not checked)."""
    upd = assignment.join(places.select("state_fips", "place_fips", "display_name"),
                          list(PLACE_KEY), "inner") \
        .select("st_case", "year", F.col("place_fips").alias("_pf"),
                F.col("display_name").alias("_dn"), F.lit(True).alias("_m"))
    j = crashes.join(upd, ["st_case", "year"], "left")
    return (j.withColumn("place_fips", F.when(F.col("_m"), F.col("_pf")).otherwise(F.col("place_fips")))
            .withColumn("fips_city_name", F.when(F.col("_m"), F.col("_dn"))
                        .otherwise(F.col("fips_city_name")))
            .select(*crashes.columns))


def extents(vertices: DataFrame, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Bbox from the outer rings (ring 0 of every part)."""
    return vertices.filter(F.col("ring") == 0).groupBy(*key).agg(
        F.min("x").alias("min_lon"), F.max("x").alias("max_lon"),
        F.min("y").alias("min_lat"), F.max("y").alias("max_lat"))


def part_areas(vertices: DataFrame, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Area per polygon part = |outer ring| - sum |holes| (shoelace)."""
    e = edges(vertices, key)
    ring_area = e.groupBy(*key, "part", "ring").agg(
        (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    return ring_area.groupBy(*key, "part").agg(
        F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"),
        F.count(F.lit(1)).alias("n_rings"))


def largest_part(vertices: DataFrame, key: Sequence[str] = PLACE_KEY,
                 only: DataFrame | None = None) -> DataFrame:
    """Keep only the largest part of each place (ties: lowest part id);
    ``only``: of these places alone, others keep all their parts."""
    if only is not None:
        named = only.select(*key).distinct()
        rest = vertices.join(named, list(key), "left_anti")
        return rest.unionByName(largest_part(vertices.join(named, list(key), "left_semi"), key)
                                .select(*rest.columns))
    areas = part_areas(vertices, key)
    best = areas.groupBy(*key).agg(
        F.max_by("part", F.struct(F.col("area"), -F.col("part"))).alias("part"))
    return vertices.join(best, [*key, "part"], "left_semi")


def _douglas_peucker(xs, ys, tol: float):
    """Indices kept by Douglas–Peucker on an open polyline (numpy arrays)."""
    import numpy as np
    n = len(xs)
    keep = np.zeros(n, dtype=bool)
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        seg = np.hypot(dx, dy)
        px, py = xs[a + 1:b] - xs[a], ys[a + 1:b] - ys[a]
        d = np.abs(dx * py - dy * px) / seg if seg > 0 else np.hypot(px, py)
        i = int(np.argmax(d))
        if d[i] > tol:
            m = a + 1 + i
            keep[m] = True
            stack.append((a, m))
            stack.append((m, b))
    return keep


def simplify_rings(vertices: DataFrame, tolerance: float = 0.0001,
                   key: Sequence[str] = PLACE_KEY, min_vertices: int = 3) -> DataFrame:
    """Douglas–Peucker simplification of every ring (open vertex table).

    One ``applyInPandas`` group per ring (a ring is bounded by one polygon
    outline, not by the data volume).  The ring is split at its first vertex
    and at the vertex farthest from it, each half simplified, so the ring
    stays closed; a ring never drops below ``min_vertices`` distinct
    vertices (declared difference: no check for crossings between rings).
    """
    import pandas as pd
    ship_package(vertices.sparkSession)
    ring_key = [*key, "part", "ring"]
    cols = [*ring_key, "seq", "x", "y"]
    schema = vertices.select(*cols).schema

    def simplify(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("seq")
        xs = pdf["x"].to_numpy(dtype=float)
        ys = pdf["y"].to_numpy(dtype=float)
        n = len(xs)
        if n <= min_vertices:
            return pdf[cols]
        far = int(np.argmax(np.hypot(xs - xs[0], ys - ys[0])))
        far = max(far, 1)
        idx_a = np.arange(0, far + 1)
        idx_b = np.append(np.arange(far, n), 0)
        keep = np.zeros(n, dtype=bool)
        keep[idx_a[_douglas_peucker(xs[idx_a], ys[idx_a], tolerance)]] = True
        keep[idx_b[_douglas_peucker(xs[idx_b], ys[idx_b], tolerance)]] = True
        if keep.sum() < min_vertices:
            # put back the farthest-from-chord vertices until the ring is valid
            order = np.argsort(-np.hypot(xs - xs.mean(), ys - ys.mean()))
            for i in order:
                keep[i] = True
                if keep.sum() >= min_vertices:
                    break
        out = pdf[keep]
        return out[cols]

    return vertices.select(*cols).groupBy(*ring_key).applyInPandas(simplify, schema)


def geojson_geometries(vertices: DataFrame, key: Sequence[str] = PLACE_KEY,
                       digits: int | None = None) -> DataFrame:
    """One GeoJSON geometry (JSON text) per place from its vertex table:
    a Polygon for one part, a MultiPolygon otherwise; rings are closed by
    repeating the first vertex.  The nesting is built with ordered
    aggregates per ring, part and place (each bounded by one outline)."""
    x = F.round("x", digits) if digits is not None else F.col("x")
    y = F.round("y", digits) if digits is not None else F.col("y")
    rings = vertices.groupBy(*key, "part", "ring").agg(
        F.sort_array(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y")))).alias("v"))
    rings = rings.select(*key, "part", "ring", F.concat(
        F.transform("v", lambda p: F.array(p["x"], p["y"])),
        F.array(F.array(F.col("v")[0]["x"], F.col("v")[0]["y"]))).alias("coords"))
    parts = rings.groupBy(*key, "part").agg(
        F.sort_array(F.collect_list(F.struct("ring", "coords"))).alias("r"))
    parts = parts.select(*key, "part", F.transform("r", lambda r: r["coords"]).alias("coords"))
    places = parts.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("part", "coords"))).alias("p"))
    polys = F.transform("p", lambda p: p["coords"])
    return places.select(*key, F.when(F.size("p") == 1, F.concat(
        F.lit('{"type":"Polygon","coordinates":'), F.to_json(polys[0]), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'),
                            F.to_json(polys), F.lit("}"))).alias("geometry"))
