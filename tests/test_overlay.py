"""Unions of polygons and rings against other ways to compute them."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadstats.operators import hotspots as hs
from roadstats.operators import overlay as ov
from roadstats.operators import spatial as sa
from tests import ring_walk as rw

SCHEMA = "state_fips string, place_fips string, part int, ring int, seq int, x double, y double"
MEMBERS = "target_state string, target_place string, state_fips string, place_fips string"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def table(spark, polygons):
    """polygons: {place: [[ring, ...], ...]} (parts of rings)."""
    rows = [("01", p, i, j, s, float(x), float(y)) for p, parts in polygons.items()
            for i, rings in enumerate(parts) for j, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def members(spark, groups):
    return spark.createDataFrame([("01", t, "01", p) for t, ps in groups.items() for p in ps], MEMBERS)


def area_of(edges):
    return sum(e["x1"] * e["y2"] - e["x2"] * e["y1"] for e in edges) / 2


def unions(spark, polygons, groups):
    out = {}
    for r in ov.polygon_unions(table(spark, polygons), members(spark, groups)).collect():
        out.setdefault(r["target_place"], []).append(r)
    return out


def test_unions_of_squares(spark):
    polygons = {
        "a": [[rect(0, 0, 1, 1)]], "half": [[rect(.5, 0, 1.5, 1)]], "nested": [[rect(.25, .25, .75, .75)]],
        "same": [[rect(0, 0, 1, 1)[::-1]]], "next": [[rect(1, 0, 2, 1)]], "part": [[rect(1, .5, 2, 1.5)]],
        "corner": [[rect(1, 1, 2, 2)]], "far": [[rect(5, 5, 6, 6)]],
        "frame": [[rect(-1, -1, 3, 3), rect(-.5, -.5, 2.5, 2.5)]], "two": [[rect(0, 0, 1, 1)], [rect(.5, .5, 2, 2)]],
        "tilt": [[[(0, -.5), (1.5, .5), (.5, 1.25)]]],
    }
    groups = {"overlap": ["a", "half"], "inner": ["a", "nested"], "equal": ["a", "same"], "touch": ["a", "next"], "share": ["a", "part"],
              "point": ["a", "corner"], "apart": ["a", "far"], "hole": ["a", "frame"], "self": ["two"], "alone": ["a"],
              "all": ["a", "half", "nested", "same", "next", "part", "corner", "far"]}
    got = {t: area_of(e) for t, e in unions(spark, polygons, groups).items()}
    want = {"overlap": 1.5, "inner": 1.0, "equal": 1.0, "touch": 2.0, "share": 2.0, "point": 2.0, "apart": 2.0, "hole": 16 - 9 + 1,
            "self": 1 + 2.25 - .25, "alone": 1.0, "all": 1 + 1 + 1 + 1}
    assert {t: round(a, 9) for t, a in got.items()} == want


def hull(points):
    points = sorted(set(points))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return half(points) + half(points[::-1])


def clipped(p, q):
    """The part of the convex polygon p within the convex polygon q."""
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1]):
        side = lambda v: (bx - ax) * (v[1] - ay) - (by - ay) * (v[0] - ax)  # noqa: B023, E731
        out = []
        for u, v in zip(p, p[1:] + p[:1]):
            if side(u) >= 0:
                out.append(u)
            if side(u) * side(v) < 0:
                t = side(u) / (side(u) - side(v))
                out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        p = out
    return p


def shoelace(p):
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1]))) / 2 if p else 0.0


def test_unions_of_convex_polygons(spark):
    """Random tilted polygons, three a target: areas by inclusion and exclusion."""
    r = random.Random(7)
    polygons, groups, want = {}, {}, {}
    for t in range(60):
        hulls = [hull([(round(r.uniform(0, 1), 5), round(r.uniform(0, 1), 5)) for _ in range(8)]) for _ in range(3)]
        groups[f"t{t}"] = [f"p{t}.{i}" for i in range(3)]
        polygons |= {f"p{t}.{i}": [[h if i != 1 else h[::-1]]] for i, h in enumerate(hulls)}
        a, b, c = hulls
        ab = clipped(a, b)
        want[f"t{t}"] = sum(map(shoelace, hulls)) - shoelace(ab) - shoelace(clipped(a, c)) - shoelace(clipped(b, c)) + shoelace(clipped(ab, c))
    got = {t: area_of(e) for t, e in unions(spark, polygons, groups).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[t] - want[t]) for t in want) < 1e-5
    # each vertex of a boundary is left as often as it is reached
    e = unions(spark, polygons, {"t0": groups["t0"]})["t0"]
    assert Counter((x["x1"], x["y1"]) for x in e) == Counter((x["x2"], x["y2"]) for x in e)


def test_union_vertices(spark):
    polygons = {"a": [[rect(0, 0, 4, 4), rect(1, 1, 3, 3)]], "b": [[rect(3.5, 0, 6, 2)]], "c": [[rect(1.5, 1.5, 2, 2)]],
                "d": [[rect(10, 10, 11, 11)]]}
    v = ov.union_vertices(table(spark, polygons), members(spark, {"m": "abcd"}))
    areas = {(x["part"], x["n_rings"]): round(x["area"], 9) for x in sa.part_areas(v).collect()}
    assert areas == {(0, 2): 16 - 4 + 4.0, (1, 1): .25, (2, 1): 1.0}
    assert {(r["state_fips"], r["place_fips"]) for r in v.collect()} == {("01", "m")}


def test_merge_places(spark):
    polygons = {"a": [[rect(0, 0, 1, 1)]], "b": [[rect(.5, 0, 1.5, 1)]], "c": [[rect(8, 8, 9, 9)]]}
    v = ov.merge_places(table(spark, polygons), members(spark, {"a": ["a", "b"], "none": ["missing"]}))
    assert {x["place_fips"]: round(x["area"], 9) for x in sa.part_areas(v).collect()} == {"a": 1.5, "b": 1.0, "c": 1.0}


def cycle(ring):
    low = ring.index(min(ring))
    return tuple(ring[low:] + ring[:low])


@pytest.mark.parametrize("seed", [3, 4])
def test_rings_equal_zone_polygons(spark, seed):
    """The rings of dissolved cells, holes that touch shells and each other included, are those that a walk finds."""
    r = random.Random(seed)
    cells = {(r.randint(0, 14), r.randint(0, 14)) for _ in range(260)}
    e = hs.core_edges(spark.createDataFrame([("01", "x", x, y) for x, y in cells], "state_fips string, place_fips string, cx long, cy long"))
    e = e.select("state_fips", "place_fips", *[(F.col(c) * 2).alias(d) for c, d in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))])
    found = {}
    for x in sorted(ov.ring_vertices(e, ["state_fips", "place_fips"]).collect(), key=lambda x: x["seq"]):
        found.setdefault(x["part"], {}).setdefault(x["ring"], []).append((x["x"], x["y"]))
    polys = rw.zone_polygons(e.selectExpr("ax as x1", "ay as y1", "bx as x2", "by as y2").toPandas())
    want = sorted((cycle(p[0][:-1]), sorted(cycle(h[:-1]) for h in p[1:])) for p in polys)
    assert sorted((cycle(p[0]), sorted(cycle(h) for i, h in p.items() if i)) for p in found.values()) == want
    assert sum(len(holes) for _, holes in want) > 3


def test_zone_features(spark):
    """Features of several cities, their holes and pinches included, equal those of the walk, ring by ring."""
    r = random.Random(9)
    cells = {(f"{c:05d}", r.randint(0, 9), r.randint(0, 9)) for c in range(3) for _ in range(110)}
    hot = spark.createDataFrame([("01", *x) for x in cells], "state_fips string, place_fips string, cx long, cy long")
    both = {"core": hs.core_edges(hot).toPandas(), "buffer": hs.buffer_edges(hot).toPandas()}

    def rings(geometry):
        parts = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
        return sorted((cycle([tuple(v) for v in p[0][:-1]]), sorted(cycle([tuple(v) for v in h[:-1]]) for h in p[1:])) for p in parts)
    got = hs.zone_features(hot).collect()
    assert len(got) == 6
    for f in got:
        feature, edges = json.loads(f["feature"]), both[f["zone_type"]]
        want = rw.geojson_geometry(edges[edges["place_fips"] == f["place_fips"]])
        assert feature["type"] == "Feature" and feature["properties"] == {"place_fips": f["place_fips"], "zone_type": f["zone_type"]}
        assert feature["geometry"]["type"] == want["type"] and rings(feature["geometry"]) == rings(want)


def test_one_long_ring(spark):
    """A comb of ten thousand edges is one ring, in order."""
    n = 2500
    points = [(0, -2), (4 * n, -2)] + [p for i in range(n - 1, -1, -1) for p in ((4 * i + 4, 10), (4 * i + 2, 10), (4 * i + 2, 0), (4 * i, 0))]
    rows = [("k", *a, *b) for a, b in zip(points, points[1:] + points[:1])]
    random.Random(3).shuffle(rows)
    e = spark.createDataFrame(rows, "k string, ax long, ay long, bx long, by long")
    got = sorted(ov.assemble_rings(e, ["k"]).collect(), key=lambda x: x["seq"])
    assert {x["n"] for x in got} == {len(points)} and [x["seq"] for x in got] == list(range(len(points)))
    assert all((a["bx"], a["by"]) == (b["ax"], b["ay"]) for a, b in zip(got, got[1:] + got[:1]))


def test_nothing_to_unite(spark):
    v = table(spark, {"a": [[rect(0, 0, 1, 1)]]})
    none = spark.createDataFrame([], MEMBERS)
    assert ov.polygon_unions(v, none).collect() == []
    assert ov.merge_places(v, none).count() == 4
