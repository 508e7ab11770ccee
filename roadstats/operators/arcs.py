"""Simplification of boundaries that keeps shared borders shared.

Rings are cut at junctions: vertices with other than two different neighbours, over all
polygons of the table.  What lies between two junctions is an arc, and the rings on both
sides of it name the same arc, whichever way they run.  Each arc is simplified once
(Douglas-Peucker; its ends stay), so neighbours still share every vertex.

Arcs whose simplified course then meets another's elsewhere than in an end are drawn in
full again, and the rest is tested again, until no simplified arc meets another.  Partners
are found by grid cell and decided by exact side-of-line tests (``overlay.meetings``).
Arcs that meet as they are drawn (of polygons that overlap) may meet simplified too.

A task holds one ring (to number its arcs) or one arc at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.overlay import ENDS, UNIT, _whole, meetings
from roadstats.operators.spatial import PLACE_KEY, _douglas_peucker
from roadstats.session import reliable_checkpoint, ship_package

MAX_ROUNDS = 20


def shared_arcs(vertices: DataFrame, key: Sequence[str] = PLACE_KEY) -> tuple[DataFrame, DataFrame]:
    """(uses, arcs): uses(key, part, ring, arc, arc_id, forward) names the arcs of each ring in order; arcs(arc_id, points)
    holds each arc once, points being (hx, hy, x, y) with its ends."""
    ring = [*key, "part", "ring"]
    v = vertices.select(*ring, "seq", "x", "y", _whole(F.col("x")).alias("hx"), _whole(F.col("y")).alias("hy"))
    order = Window.partitionBy(*ring).orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("hx", "hy", "x", "y")
    after = F.coalesce(F.lead(here).over(order), F.first(here).over(whole))
    v = v.withColumns({"here": here, "after": after, "at": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    # vertices that repeat their neighbour draw nothing
    v = reliable_checkpoint(v.where((F.col("here.hx") != F.col("after.hx")) | (F.col("here.hy") != F.col("after.hy")))
                            .select(*ring, "at", "n", "here", "after"))
    point = lambda c: F.struct(F.col(f"{c}.hx").alias("hx"), F.col(f"{c}.hy").alias("hy"))
    both = v.select(point("here").alias("p"), point("after").alias("q"))
    both = both.union(both.select("q", "p")).distinct()
    junctions = both.groupBy("p").agg(F.count(F.lit(1)).alias("d")).where("d <> 2").select(
        F.col("p.hx").alias("jx"), F.col("p.hy").alias("jy"), F.lit(True).alias("cut"))
    v = v.join(junctions, (F.col("here.hx") == F.col("jx")) & (F.col("here.hy") == F.col("jy")), "left").drop("jx", "jy")
    # a ring without a junction is an arc from its least vertex, which equal rings share
    rings = Window.partitionBy(*ring)
    least = F.min(point("here")).over(rings)
    lonely = ~F.coalesce(F.max("cut").over(rings), F.lit(False))
    v = v.withColumn("cut", F.coalesce("cut", F.lit(False)) | (lonely & (point("here") == least)))
    runs = Window.partitionBy(*ring).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumns({"arc": F.sum(F.col("cut").cast("int")).over(runs), "arcs": F.sum(F.col("cut").cast("int")).over(rings)})
    # what comes before the first cut ends the last arc
    v = v.withColumns({"at": F.when(F.col("arc") == 0, F.col("at") + F.col("n")).otherwise(F.col("at")),
                       "arc": F.when(F.col("arc") == 0, F.col("arcs")).otherwise(F.col("arc"))})
    drawn = v.groupBy(*ring, "arc").agg(F.sort_array(F.collect_list(F.struct("at", "here"))).alias("s"),
                                        F.max_by("after", "at").alias("end"))
    points = F.concat(F.transform("s", lambda s: s["here"]), F.array(F.col("end")))
    drawn = drawn.select(*ring, "arc", points.alias("points"))
    drawn = drawn.withColumns({"back": F.reverse("points"), "forward": F.col("points") <= F.reverse("points")})
    drawn = drawn.withColumn("points", F.when(F.col("forward"), F.col("points")).otherwise(F.col("back"))).drop("back")
    at = F.transform("points", lambda p: F.struct(p["hx"].alias("hx"), p["hy"].alias("hy")))
    drawn = reliable_checkpoint(drawn.withColumn("arc_id", F.xxhash64(at, F.size("points"))))
    return drawn.drop("points"), drawn.groupBy("arc_id").agg(F.first("points").alias("points"))


def kept_points(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that stay of an arc; a closed one keeps at least three different vertices."""
    n = len(xs)
    if xs[0] != xs[-1] or ys[0] != ys[-1]:
        return np.flatnonzero(_douglas_peucker(xs, ys, tolerance))
    if n <= 4:
        return np.arange(n)
    far = int(np.argmax(np.hypot(xs - xs[0], ys - ys[0])))
    keep = np.zeros(n, bool)
    keep[:far + 1] |= _douglas_peucker(xs[:far + 1], ys[:far + 1], tolerance)
    keep[far:] |= _douglas_peucker(xs[far:], ys[far:], tolerance)
    if keep.sum() < 4:
        dx, dy = xs[far] - xs[0], ys[far] - ys[0]
        keep[int(np.argmax(np.abs(dx * (ys - ys[0]) - dy * (xs - xs[0]))))] = True
    return np.flatnonzero(keep)


def _simplified(arcs: DataFrame, tolerance: float) -> DataFrame:
    """``arcs`` with ``kept``, the points that stay."""
    ship_package(arcs.sparkSession)

    @F.pandas_udf("array<int>")
    def stay(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([kept_points(np.asarray(x, float), np.asarray(y, float), tolerance) for x, y in zip(xs, ys)])

    index = stay(F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"]))
    return arcs.withColumn("index", index).withColumn(
        "kept", F.transform("index", lambda i: F.element_at("points", i + 1))).drop("index")


def _segments(arcs: DataFrame, course: str) -> DataFrame:
    """(arc_id, ax, ay, bx, by): the segments of ``course``, drawn upwards."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(course) - 1), lambda i: F.struct(
        F.element_at(course, i).alias("a"), F.element_at(course, i + 1).alias("b")))
    s = arcs.select("arc_id", F.explode(pairs).alias("s")).select(
        "arc_id", F.col("s.a.hx").alias("ax"), F.col("s.a.hy").alias("ay"), F.col("s.b.hx").alias("bx"), F.col("s.b.hy").alias("by"))
    down = (F.col("ay") > F.col("by")) | ((F.col("ay") == F.col("by")) & (F.col("ax") > F.col("bx")))
    swap = {c: F.when(down, F.col(o)).otherwise(F.col(c)) for c, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    return s.select("arc_id", *[c.alias(n) for n, c in swap.items()])


def _meeting_arcs(arcs: DataFrame, course: str) -> DataFrame:
    """(p, q), p <= q: arcs whose courses meet elsewhere than in ends (an arc may meet itself)."""
    s = reliable_checkpoint(_segments(arcs, course))
    extent = s.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.col("by") - F.col("ay")))).first()[0]
    distinct = s.select(*ENDS).distinct().withColumns({"cell": F.lit(max(4, int((extent or 0) * 2))).cast("long"), "plane": F.lit(0)})
    met = meetings(distinct, ["plane"]).select(*[f"{side}_{c}" for side in "ab" for c in ENDS])
    named = lambda side: s.select(F.col("arc_id").alias(f"{side}_arc"), *[F.col(c).alias(f"{side}_{c}") for c in ENDS])
    met = met.join(named("a"), [f"a_{c}" for c in ENDS]).join(named("b"), [f"b_{c}" for c in ENDS]).select("a_arc", "b_arc")
    # courses that run along each other
    twice = s.groupBy(*ENDS).agg(F.min("arc_id").alias("a_arc"), F.max("arc_id").alias("b_arc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = s.join(twice.select(*ENDS, "a_arc"), list(ENDS)).select("a_arc", F.col("arc_id").alias("b_arc")).where("a_arc <> b_arc")
    alone = twice.where("a_arc = b_arc").select("a_arc", "b_arc")
    return met.union(others).union(alone).select(F.least("a_arc", "b_arc").alias("p"), F.greatest("a_arc", "b_arc").alias("q")).distinct()


def clashing(arcs: DataFrame) -> DataFrame:
    """(arc_id) of the simplified arcs that meet another one, or themselves, where the arcs as drawn don't."""
    met = reliable_checkpoint(_meeting_arcs(arcs, "kept"))
    if met.isEmpty():
        return met.select(F.col("p").alias("arc_id"))
    both = met.select(F.col("p").alias("arc_id")).union(met.select("q")).distinct()
    drawn = _meeting_arcs(arcs.join(both, "arc_id", "left_semi"), "points")
    new = reliable_checkpoint(met.join(drawn, ["p", "q"], "left_anti"))
    changed = arcs.where(F.size("kept") < F.size("points")).select("arc_id")
    return changed.join(new.select(F.col("p").alias("arc_id")).union(new.select("q")).distinct(), "arc_id", "left_semi")


def simplify_shared(vertices: DataFrame, tolerance: float = 0.0001, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """``vertices`` (key, part, ring, seq, x, y) simplified; neighbours keep every vertex of a common border in common,
    and no two boundaries cross that didn't before.  Rings start at a junction, or at their least vertex."""
    ring = [*key, "part", "ring"]
    uses, arcs = shared_arcs(vertices, key)
    arcs = reliable_checkpoint(_simplified(arcs, tolerance))
    for _ in range(MAX_ROUNDS):
        bad = reliable_checkpoint(clashing(arcs))
        if bad.isEmpty():
            break
        full = arcs.join(bad.withColumn("bad", F.lit(True)), "arc_id", "left")
        arcs = reliable_checkpoint(full.select("arc_id", "points", F.when(F.col("bad"), F.col("points")).otherwise(F.col("kept")).alias("kept")))
    else:  # what still meets is drawn in full
        arcs = arcs.join(clashing(arcs), "arc_id", "left_anti").union(
            arcs.join(clashing(arcs), "arc_id", "left_semi").select("arc_id", "points", F.col("points").alias("kept")))
    course = uses.join(arcs.select("arc_id", "kept"), "arc_id").withColumn(
        "kept", F.when(F.col("forward"), F.col("kept")).otherwise(F.reverse("kept")))
    # an arc's last point is the first of the next
    out = course.select(*ring, "arc", F.posexplode(F.slice("kept", 1, F.size("kept") - 1)).alias("i", "p"))
    order = Window.partitionBy(*ring).orderBy("arc", "i")
    return out.select(*ring, (F.row_number().over(order) - 1).alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
