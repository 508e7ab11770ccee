"""Rings of a zone by walking its edges in one process: what the distributed assembly is held against."""

from __future__ import annotations

import pandas as pd

from roadstats.operators.hotspots import A_AXIS, C_CONE, E, E2, LON_0, N_CONE, PRECISION, RHO_0, SUB_M


def _rings(edges_pdf: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Chain directed boundary edges into closed simple rings, each from its
    smallest vertex on.  At a vertex with two outgoing edges take the sharpest
    left turn, which keeps shells that touch at a corner apart.  A walk that
    comes back to a vertex of its own closes a ring there, so a hole that
    touches its shell, or another hole, at a corner is a ring of its own."""
    out: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2 in edges_pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False):
        out.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in sorted(out):
        while out[start]:
            path, place, prev = [start], {start: 0}, None
            while True:
                cur = path[-1]
                cands = sorted(out[cur])
                if prev is not None and len(cands) > 1:
                    dx, dy = cur[0] - prev[0], cur[1] - prev[1]
                    cands.sort(key=lambda c: dy * (c[0] - cur[0]) - dx * (c[1] - cur[1]))
                nxt = cands[0]
                out[cur].remove(nxt)
                prev = cur
                if nxt not in place:
                    place[nxt] = len(path)
                    path.append(nxt)
                    continue
                ring = path[place[nxt]:]
                low = ring.index(min(ring))
                rings.append([*ring[low:], *ring[:low], ring[low]])
                for v in ring[1:]:
                    del place[v]
                path = path[:place[nxt] + 1]
                if len(path) == 1:
                    break
    return rings


def _signed_area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def _inside(pt, ring):
    x, y = pt
    c = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            c = not c
    return c


def _to_lonlat(xs, ys):
    """Inverse Albers in numpy for the assembled ring vertices (metres)."""
    import numpy as np
    x = np.asarray(xs, dtype=float)
    y = np.asarray(ys, dtype=float)
    dy = RHO_0 - y
    rho = np.sqrt(x * x + dy * dy)
    theta = np.arctan2(x, dy)
    q = (C_CONE - rho * rho * N_CONE * N_CONE / (A_AXIS * A_AXIS)) / N_CONE
    phi = np.arcsin(q / 2)
    for _ in range(8):
        s = np.sin(phi)
        one = 1 - E2 * s * s
        phi = phi + one * one / (2 * np.cos(phi)) * (
            q / (1 - E2) - s / one + (1 / (2 * E)) * np.log((1 - E * s) / (1 + E * s)))
    return np.degrees(theta / N_CONE) + LON_0, np.degrees(phi)


def zone_polygons(edges_pdf: pd.DataFrame) -> list[list[list[tuple[int, int]]]]:
    """[shell, hole…] of every polygon, in lattice units; a hole belongs to
    the smallest shell around it."""
    rings = _rings(edges_pdf)
    shells = sorted((r for r in rings if _signed_area(r) > 0), key=lambda r: (_signed_area(r), r[0]))
    polys = [[s] for s in shells]
    for h in (r for r in rings if _signed_area(r) < 0):
        # half a unit up and right of its smallest vertex: within the hole, on no edge
        inner = (h[0][0] + 0.5, h[0][1] + 0.5)
        next(p for p in polys if _inside(inner, p[0])).append(h)
    return sorted(polys)


def geojson_geometry(edges_pdf: pd.DataFrame, unit_m: int = SUB_M,
                     precision: int = PRECISION) -> dict:
    polys = zone_polygons(edges_pdf)

    def coords(ring):
        lon, lat = _to_lonlat([p[0] * unit_m for p in ring], [p[1] * unit_m for p in ring])
        return [[round(float(a), precision), round(float(b), precision)] for a, b in zip(lon, lat)]

    parts = [[coords(r) for r in p] for p in polys]
    if len(parts) == 1:
        return {"type": "Polygon", "coordinates": parts[0]}
    return {"type": "MultiPolygon", "coordinates": parts}
