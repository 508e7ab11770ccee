"""Literal geometry cases (FIXTURES §C: G3, G5/G7, J4) and projection
round trip (G2/G8)."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from roadstats.operators import hotspots as hs
from roadstats.operators import overlay as ov
from roadstats.operators import spatial as sa
from tests import ring_walk as rw


def _zones(spark, cells):
    hot = spark.createDataFrame([("01", "00001", x, y) for x, y in cells],
                                "state_fips string, place_fips string, cx long, cy long")
    r = hs.zone_summary(hot).collect()[0]
    return r["core_area_m2"], r["buffer_area_m2"]


def test_dissolve_and_buffer_areas(spark):
    assert _zones(spark, [(0, 0)]) == (250000, 1000000)
    assert _zones(spark, [(0, 0), (1, 0)]) == (500000, 1500000)
    assert _zones(spark, [(0, 0), (1, 1)]) == (500000, 1750000)


def test_snap_half_even(spark):
    df = spark.createDataFrame([(250.0,), (750.0,), (-250.0,)], "x double")
    assert [r[0] for r in df.select(hs.snap(F.col("x"))).collect()] == [0, 2, 0]


def test_projection_round_trip(spark):
    pts = [(-125.0, 24.5), (-67.0, 49.0), (-96.0, 23.0), (-155.5, 19.6), (-150.0, 61.2),
           (-80.1, 25.8)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = hs.albers_forward(F.col("lon"), F.col("lat"))
    p = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    back = hs.with_albers_inverse(p, "x", "y", "lon2", "lat2")
    for r in back.select("lon", "lat", "lon2", "lat2", "x", "y").collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
    origin = p.filter((F.col("lon") == -96.0) & (F.col("lat") == 23.0)).first()
    assert abs(origin["x"]) < 1e-6 and abs(origin["y"]) < 1e-6


def test_points_on_edges_are_not_within(spark):
    square = [("01", "00001", 0, 0, i, x, y)
              for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    verts = spark.createDataFrame(
        square, "state_fips string, place_fips string, part int, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 0.0, 0.0), (4, 0.5, 1.0),
                                 (5, 1.5, 0.5), (6, 0.25, 0.75)], "id int, lon double, lat double")
    got = {r["id"] for r in sa.assign_points(pts, verts, ["id"], cell=0.25).collect()}
    assert got == {1, 6}


def test_ring_assembly_corner_touch():
    # two unit squares touching at a corner -> two shells (MultiPolygon)
    edges = pd.DataFrame([(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0),
                          (2, 2, 4, 2), (4, 2, 4, 4), (4, 4, 2, 4), (2, 4, 2, 2)],
                         columns=["x1", "y1", "x2", "y2"])
    geom = rw.geojson_geometry(edges)
    assert geom["type"] == "MultiPolygon" and len(geom["coordinates"]) == 2
    json.dumps(geom)


def test_ring_with_hole():
    # 3x3 block of cells with the centre missing -> one polygon with one hole
    cells = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    rows = []
    for i, j in cells:
        x0, y0 = 2 * i - 1, 2 * j - 1
        p = [(x0, y0), (x0 + 2, y0), (x0 + 2, y0 + 2), (x0, y0 + 2)]
        rows += [(a[0], a[1], b[0], b[1]) for a, b in zip(p, p[1:] + p[:1])]
    e = pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2"])
    key = e.apply(lambda r: tuple(sorted([(r.x1, r.y1), (r.x2, r.y2)])), axis=1)
    e = e[key.map(key.value_counts()) == 1]
    geom = rw.geojson_geometry(e)
    assert geom["type"] == "Polygon" and len(geom["coordinates"]) == 2


def _boundary(cells):
    """Dissolved directed edges of unit cells (lattice side 2), plain Python."""
    seen = {}
    for i, j in cells:
        p = [(2 * i - 1, 2 * j - 1), (2 * i + 1, 2 * j - 1), (2 * i + 1, 2 * j + 1), (2 * i - 1, 2 * j + 1)]
        for a, b in zip(p, p[1:] + p[:1]):
            if (b, a) in seen:
                del seen[b, a]
            else:
                seen[a, b] = True
    return pd.DataFrame([(*a, *b) for a, b in seen], columns=["x1", "y1", "x2", "y2"])


def test_pinch_vertices_give_simple_rings():
    block = {(i, j) for i in range(3) for j in range(3)}
    # the missing corner meets the missing centre in a vertex
    polys = rw.zone_polygons(_boundary(block - {(1, 1), (2, 2)}))
    assert [len(p) for p in polys] == [2] and len(set(polys[0][0][:-1])) == len(polys[0][0]) - 1
    # two holes that touch in a corner
    wide = {(i, j) for i in range(4) for j in range(4)}
    assert [len(p) for p in rw.zone_polygons(_boundary(wide - {(1, 1), (2, 2)}))] == [3]
    # four cells around an empty one touch in corners only: four polygons
    assert [len(p) for p in rw.zone_polygons(_boundary({(0, 1), (1, 0), (2, 1), (1, 2)}))] == [1] * 4
    # an island within a hole
    ring = {(i, j) for i in range(5) for j in range(5)} - {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)}
    assert sorted(len(p) for p in rw.zone_polygons(_boundary(ring | {(2, 2)}))) == [1, 2]


def test_zone_polygons_cover_their_cells():
    r = random.Random(5)
    for share in (0.3, 0.5, 0.6, 0.75, 0.9):
        for size in (4, 9, 14):
            cells = {(i, j) for i in range(size) for j in range(size) if r.random() < share}
            polys = rw.zone_polygons(_boundary(cells))
            for p in polys:
                for ring in p:
                    assert ring[0] == ring[-1] == min(ring) and len(set(ring)) == len(ring) - 1
            assert sum(rw._signed_area(ring) for p in polys for ring in p) == 4 * len(cells)
            for i in range(size):
                for j in range(size):
                    at = (2 * i + 0.25, 2 * j + 0.25)
                    held = [p for p in polys if rw._inside(at, p[0]) and not any(rw._inside(at, h) for h in p[1:])]
                    assert len(held) == ((i, j) in cells)


def _brute_within(px, py, ring):
    """Crossing-number test with the on-edge exclusion (plain Python)."""
    inside, n = False, len(ring)
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return False
        if (y1 > py) != (y2 > py) and x1 + (py - y1) * (x2 - x1) / (y2 - y1) > px:
            inside = not inside
    return inside


def test_assignment_matches_brute_force_with_a_hot_cell(spark):
    import random
    from roadstats.sources import standins as sp
    from tests.conftest import SF_SMALL
    verts = sp.polygon_vertices(spark, SF_SMALL)
    rings = {}
    for r in verts.orderBy("place_fips", "seq").collect():
        rings.setdefault((r["state_fips"], r["place_fips"]), []).append((r["x"], r["y"]))
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(-126, -66), rnd.uniform(24, 50)) for i in range(2000)]
    # a third of all points in one 0.05-degree cell inside a polygon corner
    pts += [(2000 + i, -124.3 + rnd.uniform(0, 0.049), 25.0 + rnd.uniform(0, 0.049))
            for i in range(1000)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double").repartition(8)
    got = {r["id"]: (r["state_fips"], r["place_fips"])
           for r in sa.assign_points(df, verts, ["id"], cell=0.05).collect()}
    want = {}
    for i, x, y in pts:
        hits = sorted(k for k, ring in rings.items() if _brute_within(x, y, ring))
        if hits:
            want[i] = hits[0]
    assert got == want
    assert sum(1 for i in got if i >= 2000) > 0


def _square(place, part, x, y, size, ring=0):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [("01", place, part, ring, i, float(a), float(b)) for i, (a, b) in enumerate(corners)]


SQUARES = "state_fips string, place_fips string, part int, ring int, seq int, x double, y double"


def test_overlapping_parts_and_holes(spark):
    rows = _square("A", 0, 0, 0, 4) + _square("A", 1, 2, 2, 4) + _square("A", 0, 0.5, 0.5, 1, ring=1)
    vertices = spark.createDataFrame(rows, SQUARES)
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.0, 1.0), (3, 5.0, 5.0), (4, 0.25, 3.0), (5, 5.0, 1.0)],
                                   "id int, lon double, lat double")
    for cell in (0.3, 2.5, 10.0):
        got = {r["id"] for r in sa.assign_points(points, vertices, ["id"], cell).collect()}
        assert got == {1, 3, 4}


def test_largest_part_of_named_places(spark):
    rows = [r for p in "AB" for r in _square(p, 0, 0, 0, 1) + _square(p, 1, 5, 5, 3)]
    only = spark.createDataFrame([("01", "A")], "state_fips string, place_fips string")
    got = sa.largest_part(spark.createDataFrame(rows, SQUARES), only=only)
    assert {(r["place_fips"], r["part"]) for r in got.collect()} == {("A", 1), ("B", 0), ("B", 1)}


def test_union_of_identical_and_touching_members(spark):
    rows = _square("A", 0, 0, 0, 1) + _square("B", 0, 0, 0, 1) + _square("C", 0, 1, 0, 1)
    members = spark.createDataFrame([("01", p, "01", "T") for p in "ABC"],
                                    "state_fips string, place_fips string, target_state string, target_place string")
    got = ov.polygon_unions(spark.createDataFrame(rows, SQUARES), members).collect()
    area = sum(r["x1"] * r["y2"] - r["x2"] * r["y1"] for r in got) / 2
    assert len(got) == 6 and area == 2.0


def test_cover_grows_with_the_outline(spark):
    """Twice as wide a polygon has about twice as many cells, not four times; and they are exact."""
    counts = {}
    for size in (4.0, 8.0):
        ring = [(0.013, 0.013), (size, 0.02), (size * .9, size), (0.1, size * .8)]
        rows = [("01", "A", 0, 0, i, x, y) for i, (x, y) in enumerate(ring)]
        e = sa.edges(spark.createDataFrame(rows, SQUARES))
        _, boundary, interior = sa.classify_cells(e, 0.05)
        counts[size] = boundary.count() + interior.count()
        for r in interior.collect():
            side = 0.05 * sa.COARSER ** r["level"]
            corners = [(x * side, y * side) for x in (r["cx"], r["cx"] + 1) for y in (r["cy"], r["cy"] + 1)]
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > -1e-9
                       for a, b in zip(ring, ring[1:] + ring[:1]) for x, y in corners)
    assert counts[8.0] < 2.6 * counts[4.0] and counts[8.0] < 0.3 * (8 / 0.05) ** 2
