"""Shared-arc simplification: common vertices stay common, nothing crosses, and the tolerance decides."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from roadstats.operators import arcs as ar
from roadstats.operators import spatial as sa
from tests.test_overlay import rect, shoelace, table

TOLERANCE = 0.01


def rings_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        out.setdefault((r["place_fips"], r["part"], r["ring"]), []).append((r["x"], r["y"]))
    return out


def wiggly(a, b, r, n=30, size=.004):
    """Points from a (included) to b (not), each a little off the straight line."""
    (ax, ay), (bx, by) = a, b
    return [a] + [(round(ax + (bx - ax) * t / n + r.uniform(-size, size), 6), round(ay + (by - ay) * t / n + r.uniform(-size, size), 6))
                  for t in range(1, n)]


def crossing(s, t):
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return side(*s, t[0]) * side(*s, t[1]) < 0 and side(*t, s[0]) * side(*t, s[1]) < 0


def segments(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def test_neighbours_share_every_vertex(spark):
    """A 4 x 4 board whose borders are wiggly: each border is simplified alike on both sides."""
    r, n = random.Random(2), 4
    wave = {}

    def border(a, b):
        if (a, b) not in wave and (b, a) not in wave:
            wave[a, b] = wiggly(a, b, r)
        return wave[a, b] if (a, b) in wave else [a, *wave[b, a][:0:-1]]
    polygons = {}
    for i in range(n):
        for j in range(n):
            c = [(float(x), float(y)) for x, y in rect(i, j, i + 1, j + 1)]
            ring = [p for a, b in zip(c, c[1:] + c[:1]) for p in border(a, b)]
            polygons[f"{i}{j}"] = [[ring if (i + j) % 2 else ring[::-1][5:] + ring[::-1][:5]]]
    got = rings_of(ar.simplify_shared(table(spark, polygons), TOLERANCE))
    assert len(got) == n * n
    total = sum(map(len, got.values()))
    assert total < sum(len(p[0][0]) for p in polygons.values()) / 4
    edges = {}
    for ring in got.values():
        for s in segments(ring):
            edges[frozenset(s)] = edges.get(frozenset(s), 0) + 1
    inner = [e for e, c in edges.items() if c == 2]
    outer = [e for e, c in edges.items() if c == 1]
    # a border inside the board is there twice, one at its rim once, and the rim is where the board ends
    assert len(inner) + len(outer) == len(edges)
    assert all(any(abs(min(p[d] for p in e) - v) < .05 and abs(max(p[d] for p in e) - v) < .05 for d in (0, 1) for v in (0, n)) for e in outer)
    assert abs(sum(map(shoelace, got.values())) - n * n) < 4 * n * TOLERANCE


def test_crossings_are_undone(spark):
    """A thin spike of a neighbour reaches into a bay that simplification would cut off."""
    bay = [(0, 0), (2, 0), (2, 1), (1.2, 1), (1.0, .995), (.8, 1), (0, 1)]
    spike = [(.95, 1.5), (1.0, .9965), (1.05, 1.5)]
    polygons = {"bay": [[bay]], "spike": [[spike]], "free": [[[(5, 5), (6, 5), (6, 6), (5.5, 6.005), (5, 6)]]]}
    plain = rings_of(sa.simplify_rings(table(spark, polygons), TOLERANCE))
    assert any(crossing(s, t) for s in segments(plain["bay", 0, 0]) for t in segments(plain["spike", 0, 0]))
    got = rings_of(ar.simplify_shared(table(spark, polygons), TOLERANCE))
    assert not any(crossing(s, t) for s in segments(got["bay", 0, 0]) for t in segments(got["spike", 0, 0]))
    assert len(got["free", 0, 0]) == 4


def test_overlapping_polygons_are_simplified(spark):
    square = [(0, 0), (1, .001), (2, 0), (2, 1), (2.001, 2), (2, 2.5), (0, 2)]
    other = [(x + 1, y + 1) for x, y in square]
    got = rings_of(ar.simplify_shared(table(spark, {"a": [[square]], "b": [[other]]}), TOLERANCE))
    assert [len(r) for r in got.values()] == [4, 4]


def test_equal_rings_holes_and_slivers(spark):
    r = random.Random(5)
    c = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    ring = [p for a, b in zip(c, c[1:] + c[:1]) for p in wiggly(a, b, r)]
    polygons = {"a": [[ring]], "b": [[ring[::-1][40:] + ring[::-1][:40]]],
                "outer": [[[(x * 9 - 3, y * 9 - 3) for x, y in c], ring]], "sliver": [[[(20, 0), (21, .001), (20.5, .0001)]]],
                "two": [[[(30, 0), (31, 0), (30.5, .002)]], [[(30, 0), (30.5, -.002), (31, 0)]]]}
    got = rings_of(ar.simplify_shared(table(spark, polygons), TOLERANCE))
    assert set(got["a", 0, 0]) == set(got["b", 0, 0]) == set(got["outer", 0, 1]) and 4 <= len(got["a", 0, 0]) < 40
    assert len(got["outer", 0, 0]) == 4 and all(len(ring) >= 3 for ring in got.values())


def test_distance_stays_below_the_tolerance():
    rng = np.random.default_rng(1)
    xs = np.linspace(0, 1, 400)
    ys = np.cumsum(rng.normal(0, .002, 400))
    keep = ar.kept_points(xs, ys, TOLERANCE)
    for a, b in zip(keep, keep[1:]):
        size = math.hypot(xs[b] - xs[a], ys[b] - ys[a])
        off = np.abs((xs[b] - xs[a]) * (ys[a:b] - ys[a]) - (ys[b] - ys[a]) * (xs[a:b] - xs[a])) / size
        assert off.max() <= TOLERANCE


def test_no_polygons(spark):
    none = table(spark, {"a": [[rect(0, 0, 1, 1)]]}).where(F.lit(False))
    assert ar.simplify_shared(none).collect() == []
