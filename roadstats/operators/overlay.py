"""Union of polygons and assembly of rings (A13, G6, G9) on edge tables.

Coordinates are whole numbers of half units (a unit is ``UNIT`` degrees), so every
side-of-line test is exact in longs, and the middle of an edge is whole as well.
Polygons of one key must span less than 100 degrees; beyond that the arithmetic
overflows, which Spark reports as an error.

**Union** (``union_boundary``).  Rings are directed with the inside on their left.
Equal edges of a key become one, with ``net`` = directions along it less directions
against it; shared borders have net 0 and go.  Then:

1. Edges are cut where others of the key touch or cross them.  Partners meet in grid
   cells whose size follows the key's mean edge length, so a join on the cell finds
   them.  Crossings are rounded to units, which bends an edge by half a unit at most, so
   cutting is repeated until nothing is left to cut.
2. The winding number on one side of each piece is the sum of the nets to its right in
   its grid row; the other side's differs by the piece's own net.
3. Pieces between winding 0 and above are the boundary of the union.

**Rings** (``assemble_rings``).  Each edge's successor is the outgoing edge at its end
with the sharpest left turn.  Pointer doubling over the successors (each round doubles the
stretch an edge knows) gives every edge the smallest edge of its ring and its distance to
it, in as many rounds as the longest ring's length has binary digits.  No ring, zone or
key is ever one task's group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.spatial import PLACE_KEY, edges
from roadstats.session import reliable_checkpoint

#: Degrees in a unit (about a centimetre on the ground).
UNIT = 1e-7
#: Rounds of cutting, and of pointer doubling (rings of up to 2 ** 40 edges).
MAX_CUTS, MAX_DOUBLINGS = 12, 40

ENDS = ("ax", "ay", "bx", "by")


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Above 0: p is to the left of a -> b; exact."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _whole(v: Column) -> Column:
    return F.round(v / F.lit(UNIT)).cast("long") * 2


def directed_edges(vertices: DataFrame, key: Sequence[str] = PLACE_KEY) -> DataFrame:
    """Edges (key, ax, ay, bx, by) of a vertex table in half units, the inside on their left: ring 0 of a part
    runs against the clock, its other rings with it, whatever way they were drawn."""
    e = edges(vertices, key).select(*key, "part", "ring", _whole(F.col("x1")).alias("ax"), _whole(F.col("y1")).alias("ay"),
                                    _whole(F.col("x2")).alias("bx"), _whole(F.col("y2")).alias("by"))
    # areas from a corner of the ring, so that the products stay small
    low = e.groupBy(*key, "part", "ring").agg(F.min("ax").alias("_x"), F.min("ay").alias("_y"))
    e = e.join(low, [*key, "part", "ring"])
    twice = (F.col("ax") - F.col("_x")) * (F.col("by") - F.col("_y")) - (F.col("bx") - F.col("_x")) * (F.col("ay") - F.col("_y"))
    area = e.groupBy(*key, "part", "ring").agg(F.sum(twice.cast("decimal(38,0)")).alias("_area"))
    e = e.drop("_x", "_y").join(area, [*key, "part", "ring"])
    turn = (F.col("_area") > 0) != (F.col("ring") == 0)
    swap = {c: F.when(turn, F.col(o)).otherwise(F.col(c)) for c, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    return e.select(*key, *[c.alias(n) for n, c in swap.items()])


def _netted(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pieces (key, ax, ay, bx, by, net) drawn upwards (level ones to the right), equal ones added up, net 0 left out."""
    down = (F.col("ay") > F.col("by")) | ((F.col("ay") == F.col("by")) & (F.col("ax") > F.col("bx")))
    swap = {c: F.when(down, F.col(o)).otherwise(F.col(c)) for c, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    up = pieces.where("ax <> bx or ay <> by").select(
        *key, *[c.alias(n) for n, c in swap.items()], F.when(down, -F.col("net")).otherwise(F.col("net")).alias("net"))
    return up.groupBy(*key, *ENDS).agg(F.sum("net").alias("net")).where("net <> 0")


def with_cell_size(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """``pieces`` and ``cell``: twice the mean extent of their key's edges."""
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    size = pieces.groupBy(*key).agg(F.greatest(F.ceil(F.avg(extent) * 2), F.lit(4)).cast("long").alias("cell"))
    return pieces.join(size, list(key))


def _rows_of(pieces: DataFrame) -> DataFrame:
    """Each piece (drawn upwards) once per grid row that it reaches."""
    return pieces.withColumn("cy", F.explode(F.sequence(F.floor(F.col("ay") / F.col("cell")),
                                                        F.floor(F.col("by") / F.col("cell")))))


def in_cells(pieces: DataFrame) -> DataFrame:
    """Each piece (drawn upwards, with ``cell``) once per grid cell that it passes through (cx, cy); two half
    units of margin, as a cell too many costs a test and one too few a crossing."""
    p = _rows_of(pieces)
    ax, ay, bx, by, c = (F.col(n).cast("double") for n in (*ENDS, "cell"))
    lo = F.greatest(ay, F.col("cy") * c)
    hi = F.least(by, (F.col("cy") + 1) * c)
    at = lambda y: F.when(by == ay, ax).otherwise(ax + (y - ay) * (bx - ax) / (by - ay))
    xs = [F.when(by == ay, ax).otherwise(at(lo)), F.when(by == ay, bx).otherwise(at(hi))]
    return p.withColumn("cx", F.explode(F.sequence(F.floor((F.least(*xs) - 2) / c), F.floor((F.greatest(*xs) + 2) / c))))


def meetings(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, a_*, b_*, t1..t4, px, py): pairs of pieces of a key that meet elsewhere than in a common end.

    t1 and t2 tell the sides of b's ends to a, t3 and t4 those of a's ends to b; (px, py) is where they cross,
    rounded, if they do."""
    k = list(key)
    cells = in_cells(pieces.withColumn("id", F.xxhash64(*k, *ENDS)))
    a = cells.select(*k, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("id", *ENDS)])
    b = cells.select(*k, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("id", *ENDS)])
    # ids only order a pair; pieces whose hashes are equal are ordered by their ends
    first = F.struct("a_id", *[f"a_{c}" for c in ENDS]) < F.struct("b_id", *[f"b_{c}" for c in ENDS])
    near = (F.least("a_ax", "a_bx") <= F.greatest("b_ax", "b_bx")) & (F.least("b_ax", "b_bx") <= F.greatest("a_ax", "a_bx")) \
        & (F.col("a_ay") <= F.col("b_by")) & (F.col("b_ay") <= F.col("a_by"))
    both = a.join(b, [*k, "cx", "cy"]).where(first & near).drop("cx", "cy", "a_id", "b_id").distinct()
    ea, eb = [F.col(f"a_{c}") for c in ENDS], [F.col(f"b_{c}") for c in ENDS]
    both = both.withColumns({"t1": _side(*ea, eb[0], eb[1]), "t2": _side(*ea, eb[2], eb[3]),
                             "t3": _side(*eb, ea[0], ea[1]), "t4": _side(*eb, ea[2], ea[3])})
    crosses = (F.signum("t1") * F.signum("t2") < 0) & (F.signum("t3") * F.signum("t4") < 0)
    share = F.col("t3").cast("double") / (F.col("t3").cast("double") - F.col("t4").cast("double"))
    rounded = lambda a0, a1: F.when(crosses, F.round((a0 + (a1 - a0) * share) / 2).cast("long") * 2)
    both = both.withColumns({"px": rounded(ea[0], ea[2]), "py": rounded(ea[1], ea[3])})
    within = [_inside(ea, eb[0], eb[1], "t1"), _inside(ea, eb[2], eb[3], "t2"),
              _inside(eb, ea[0], ea[1], "t3"), _inside(eb, ea[2], ea[3], "t4")]
    return both.where(crosses | within[0] | within[1] | within[2] | within[3])


def _inside(e: list[Column], px: Column, py: Column, side: str) -> Column:
    """Whether p lies on the edge ``e``, other than at its ends."""
    ax, ay, bx, by = e
    return (F.col(side) == 0) & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) & (py >= ay) & (py <= by) \
        & ~((px == ax) & (py == ay)) & ~((px == bx) & (py == by))


def cut_edges(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """``pieces`` (key, ax, ay, bx, by, net) cut until they meet in ends only."""
    k = list(key)
    pieces = reliable_checkpoint(_netted(pieces, k))
    for _ in range(MAX_CUTS):
        met = meetings(with_cell_size(pieces, k), k)
        ea, eb = [F.col(f"a_{c}") for c in ENDS], [F.col(f"b_{c}") for c in ENDS]
        point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        crossing = point(F.col("px"), F.col("py"))

        def cuts(of: str, own: list[Column], other: list[Column], sides: tuple[str, str]) -> DataFrame:
            found = F.array(*[F.when(_inside(own, x, y, s), point(x, y)) for (x, y), s in
                              zip(((other[0], other[1]), (other[2], other[3])), sides)], F.when(F.col("px").isNotNull(), crossing))
            return met.select(*k, *[F.col(f"{of}_{c}").alias(c) for c in ENDS], F.explode(found).alias("at")).where("at is not null")

        at = cuts("a", ea, eb, ("t1", "t2")).union(cuts("b", eb, ea, ("t3", "t4")))
        ends = ((F.col("at.x") == F.col("ax")) & (F.col("at.y") == F.col("ay"))) | (
            (F.col("at.x") == F.col("bx")) & (F.col("at.y") == F.col("by")))
        at = reliable_checkpoint(at.where(~ends).distinct())
        if at.isEmpty():
            return pieces
        along = (F.col("at.x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("at.y") - F.col("ay")) * (F.col("by") - F.col("ay"))
        # the cuts of one edge: as many as other edges meet it
        cut = at.withColumn("along", along).groupBy(*k, *ENDS).agg(
            F.sort_array(F.collect_list(F.struct("along", F.col("at.x").alias("x"), F.col("at.y").alias("y")))).alias("at"))
        joined = pieces.join(cut, [*k, *ENDS], "left")
        stops = F.concat(F.array(point(F.col("ax"), F.col("ay"))),
                         F.transform(F.coalesce("at", F.expr("array()")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))),
                         F.array(point(F.col("bx"), F.col("by"))))
        pairs = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(
            F.element_at("stops", i).alias("a"), F.element_at("stops", i + 1).alias("b")))
        split = joined.withColumn("stops", stops).select(*k, "net", F.explode(pairs).alias("p")).select(
            *k, F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"), "net")
        pieces = reliable_checkpoint(_netted(split, k))
    raise RuntimeError(f"edges still met after {MAX_CUTS} rounds of cutting")


def union_boundary(edge_tab: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges (key, ax, ay, bx, by), the inside on their left, of the union of all polygons of a key.

    ``edge_tab``: directed edges of all member polygons, keyed by the union they belong to."""
    k = list(key)
    pieces = with_cell_size(cut_edges(edge_tab.select(*k, *ENDS, F.lit(1).cast("long").alias("net")), k), k)
    pieces = pieces.withColumns({"mx": ((F.col("ax") + F.col("bx")) / 2).cast("long"),
                                 "my": ((F.col("ay") + F.col("by")) / 2).cast("long")})
    rows = _rows_of(pieces).select(*k, "cy", *[F.col(c).alias(f"o_{c}") for c in ENDS], F.col("net").alias("o_net"))
    probe = pieces.withColumn("cy", F.floor(F.col("my") / F.col("cell")))
    other = [F.col(f"o_{c}") for c in ENDS]
    right = (other[1] <= F.col("my")) & (F.col("my") < other[3]) & (_side(*other, F.col("mx"), F.col("my")) > 0)
    seen = probe.join(rows, [*k, "cy"]).where(right).groupBy(*k, *ENDS).agg(F.sum("o_net").alias("seen"))
    p = pieces.join(seen, [*k, *ENDS], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # a ray to the right, a hair above the middle: it sees the right side of a rising piece, the upper (left) of a level one
    level = F.col("ay") == F.col("by")
    left = F.when(level, F.col("seen")).otherwise(F.col("seen") + F.col("net"))
    beyond = F.when(level, F.col("seen") - F.col("net")).otherwise(F.col("seen"))
    p = p.withColumns({"left": left > 0, "right": beyond > 0}).where("left <> right")
    swap = {c: F.when(F.col("left"), F.col(c)).otherwise(F.col(o)) for c, o in zip(ENDS, ("bx", "by", "ax", "ay"))}
    return p.select(*k, *[c.alias(n) for n, c in swap.items()])


def _ranked(links: DataFrame) -> DataFrame:
    """(id, ring_id, n, seq) of the cycles of ``links`` (id, ptr): the smallest id of the cycle, its length, and the place
    in it, from that id on; by pointer doubling."""
    state = reliable_checkpoint(links.select("id", "ptr", F.col("id").alias("low"), F.lit(0).cast("long").alias("off")))
    for turn_no in range(MAX_DOUBLINGS):
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("low2"), F.col("off").alias("off2"))
        state = reliable_checkpoint(state.join(ahead, "ptr").select(
            "id", F.col("far").alias("ptr"), F.least("low", "low2").alias("low"),
            F.when(F.col("low") <= F.col("low2"), F.col("off")).otherwise(F.col("off2") + F.lit(2 ** turn_no)).alias("off"),
            (F.col("low2") < F.col("low")).alias("moved")))
        if state.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("rings did not close")
    lengths = state.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    return state.join(lengths, "low").select("id", F.col("low").alias("ring_id"), "n",
                                             F.pmod(F.col("n") - F.col("off"), "n").cast("long").alias("seq"))


def assemble_rings(edge_tab: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, ring_id, seq, n, ax, ay, bx, by): the edges of ``edge_tab`` (key, ax, ay, bx, by; the inside on their left,
    each once) in the order of their rings, which are simple; n: edges of the ring.

    Where rings touch in a point, the sharpest left turn keeps shells apart.  It runs a hole that touches its shell, or
    another hole, into one ring with it; such a ring is cut where it comes back to a vertex, and ranked again."""
    k = list(key)
    e = reliable_checkpoint(edge_tab.select(*k, *ENDS).withColumn("id", F.xxhash64(*k, *ENDS)))
    then = e.select(*k, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("nx"), F.col("by").alias("ny"),
                    F.col("id").alias("next"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    out = F.atan2(F.col("ny") - F.col("by"), F.col("nx") - F.col("bx"))
    turn = F.when(back - out <= 0, back - out + 2 * F.pi()).otherwise(back - out)
    links = reliable_checkpoint(e.join(then, [*k, "bx", "by"]).groupBy("id").agg(
        F.min_by("next", F.struct(turn, F.col("next"))).alias("ptr")))
    placed = reliable_checkpoint(e.join(_ranked(links), "id"))

    again = placed.groupBy("ring_id", "ax", "ay").agg(F.count(F.lit(1)).alias("visits")).where("visits > 1")
    again = reliable_checkpoint(again)
    if not again.isEmpty():
        visit = Window.partitionBy("ring_id", "ax", "ay").orderBy("seq")
        whole = visit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        visits = placed.join(again.drop("visits"), ["ring_id", "ax", "ay"]).select(
            "ring_id", F.pmod(F.col("seq") - 1, "n").alias("seq"),  # the edge that comes to the visit goes on as the one before did
            F.coalesce(F.lag("id").over(visit), F.last("id").over(whole)).alias("instead"))
        torn = placed.join(again.select("ring_id").distinct(), "ring_id", "left_semi")
        new = torn.join(visits, ["ring_id", "seq"], "left").select("id", "instead").join(links, "id").select(
            "id", F.coalesce("instead", "ptr").alias("ptr"))
        ranked = _ranked(new)
        placed = placed.join(again.select("ring_id").distinct(), "ring_id", "left_anti").unionByName(e.join(ranked, "id"))
    return placed.select(*k, "ring_id", "seq", "n", *ENDS)


def ring_vertices(edge_tab: DataFrame, key: Sequence[str]) -> DataFrame:
    """Vertex table (key, part, ring, seq, x, y) in half units of the rings of ``edge_tab``: shells in the order of their
    lowest vertex, each with the holes whose smallest shell around them it is."""
    k = list(key)
    placed = reliable_checkpoint(assemble_rings(edge_tab, k))
    corner = placed.groupBy("ring_id").agg(F.min("ax").alias("_x"), F.min("ay").alias("_y"))
    cross = (F.col("ax") - F.col("_x")) * (F.col("by") - F.col("_y")) - (F.col("bx") - F.col("_x")) * (F.col("ay") - F.col("_y"))
    rings = reliable_checkpoint(placed.join(corner, "ring_id").groupBy(*k, "ring_id").agg(
        F.sum(cross.cast("decimal(38,0)")).alias("area"), F.min(F.struct("ay", "ax")).alias("low"),
        F.min(F.struct("seq", "ax", "ay", "bx", "by")).alias("e")))
    shells = rings.where("area > 0")
    holes = rings.where("area < 0").select(*k, F.col("ring_id").alias("hole"), F.col("low").alias("hole_low"),
                                           ((F.col("e.ax") + F.col("e.bx")) / 2).cast("long").alias("mx"),
                                           ((F.col("e.ay") + F.col("e.by")) / 2).cast("long").alias("my"))
    # the middle of a hole's edge lies on no other ring: its crossings with each shell, by grid row
    sized = with_cell_size(placed.select(*k, *ENDS), k).select(*k, "cell").distinct()
    shell_edges = placed.join(shells.select("ring_id", "area"), "ring_id").join(sized, k)
    up = shell_edges.select(*k, "ring_id", "area", "cell", F.when(F.col("ay") <= F.col("by"), F.col("ax")).otherwise(F.col("bx")).alias("ax"),
                            F.least("ay", "by").alias("ay"), F.when(F.col("ay") <= F.col("by"), F.col("bx")).otherwise(F.col("ax")).alias("bx"),
                            F.greatest("ay", "by").alias("by")).where("ay < by")
    probe = holes.join(sized, k).withColumn("cy", F.floor(F.col("my") / F.col("cell")))
    right = (F.col("ay") <= F.col("my")) & (F.col("my") < F.col("by")) & (
        _side(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("mx"), F.col("my")) > 0)
    around = probe.select(*k, "hole", "hole_low", "mx", "my", "cy").join(_rows_of(up).drop("cell"), [*k, "cy"]).where(right) \
        .groupBy(*k, "hole", "hole_low", "ring_id", "area").agg(F.count(F.lit(1)).alias("c")).where("c % 2 = 1") \
        .groupBy(*k, "hole", "hole_low").agg(F.min_by("ring_id", F.struct("area", "ring_id")).alias("shell"))
    by_key = Window.partitionBy(*k).orderBy("low", "ring_id")
    parts = shells.select(*k, F.col("ring_id").alias("shell"), (F.row_number().over(by_key) - 1).alias("part"))
    by_shell = Window.partitionBy(*k, "shell").orderBy("hole_low", "hole")
    numbered = parts.select(*k, F.col("shell").alias("ring_id"), "part", F.lit(0).alias("ring")).unionByName(
        around.join(parts, [*k, "shell"]).select(*k, F.col("hole").alias("ring_id"), "part", F.row_number().over(by_shell).alias("ring")))
    return placed.join(numbered, [*k, "ring_id"]).select(*k, "part", "ring", F.col("seq").cast("int").alias("seq"),
                                                         F.col("ax").alias("x"), F.col("ay").alias("y"))


def in_degrees(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.withColumns({c: F.col(c) / 2 / F.lit(round(1 / UNIT)) for c in columns})


def polygon_unions(vertices: DataFrame, members: DataFrame, key: Sequence[str] = PLACE_KEY,
                   target: Sequence[str] = ("target_state", "target_place")) -> DataFrame:
    """Boundary edges (target, x1, y1, x2, y2) of the union of each target's member polygons.

    ``members``: (target, key), a polygon may belong to several targets.  Members may overlap, contain, equal or
    touch one another, and have holes and several parts."""
    e = directed_edges(vertices.join(members, list(key), "left_semi"), key).join(members, list(key))
    u = union_boundary(e, target)
    return in_degrees(u, ENDS).withColumnsRenamed({"ax": "x1", "ay": "y1", "bx": "x2", "by": "y2"})


def union_vertices(vertices: DataFrame, members: DataFrame, key: Sequence[str] = PLACE_KEY,
                   target: Sequence[str] = ("target_state", "target_place")) -> DataFrame:
    """The unions of ``polygon_unions`` as a vertex table (key, part, ring, seq, x, y), named by their targets."""
    e = directed_edges(vertices.join(members, list(key), "left_semi"), key).join(members, list(key))
    v = in_degrees(ring_vertices(union_boundary(e, target), target), ("x", "y"))
    return v.withColumnsRenamed(dict(zip(target, key)))


def merge_places(vertices: DataFrame, members: DataFrame, key: Sequence[str] = PLACE_KEY,
                 target: Sequence[str] = ("target_state", "target_place")) -> DataFrame:
    """``vertices`` with each target's polygon replaced by the union of its members (those that have one); the members
    stay as they are, and a target without any member polygon keeps its own."""
    merged = reliable_checkpoint(union_vertices(vertices, members, key, target))
    rest = vertices.join(merged.select(*key).distinct(), list(key), "left_anti")
    kinds = dict(vertices.dtypes)
    return rest.unionByName(merged.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (*key, "part", "ring", "seq", "x", "y")]),
                            allowMissingColumns=True)
