"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Rows start in shards dealt by a hash; in each
round every group of linked rows wants the shard that most of it is in, and the moves
into a shard are let through as far as its quota goes.  Rows of a group that stand in
the same shard act together (a cell), so a group of any size is at most ``shards``
cells.  At the end the rows without links, and those beyond a quota, fill the places
left, so that the shards' row counts differ by one at most (law ``rows``).

Defined cases: a null text is an empty one (16 bytes); all empty texts are one group;
equal rows are placed each on its own; null doc_ids are rows like others; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadstats.llm.common import checkpointed, save, sent

#: Rows that one bucket of a numbering holds about.
NUMBERED_TOGETHER = 50_000


def numbered(df: DataFrame, part: str, rows: int, name: str) -> DataFrame:
    """``df`` (with a unique ``row``) and ``name``: numbers without gaps from 0 within each ``part``.

    Rows are numbered within buckets of a hash and moved up by the buckets before
    theirs, so that no part of the table is sorted as a whole.
    """
    buckets = max(1, -(-rows // NUMBERED_TOGETHER))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(F.col(part).alias("__part"), F.col("__bucket").alias("__of")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__part").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    counts = save(counts.select("__part", "__of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")),
                  "shard-buckets")
    own = Window.partitionBy(part, "__bucket").orderBy("row")
    return dealt.join(sent(counts, 24), (F.col(part) == F.col("__part")) & (F.col("__bucket") == F.col("__of"))).withColumn(
        name, F.col("__before") + F.row_number().over(own) - 1).drop("__part", "__bucket", "__of", "__before")


def _by_shard(values: list, shard: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), shard)


def _fill_large(large: list[tuple[int, int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """Shards of the cells (group, cell, rows) of groups that exceed half a shard: at most two per shard exist,
    so these are few.  The largest group first, its cells together while a shard has room."""
    out, sizes = {}, {}
    for g, _, n in large:
        sizes[g] = sizes.get(g, 0) + n
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        shard = max(range(len(room)), key=lambda j: (room[j], -j))
        for _, cell, n in sorted(x for x in large if x[0] == g):
            if room[shard] < n:
                shard = max(range(len(room)), key=lambda j: (room[j], -j))
            out[g, cell] = shard
            room[shard] -= n
    return out


def _share(free: int, coming: int) -> float:
    """The share of the moves to let through by chance so that they rarely exceed the places that are free."""
    if coming <= free:
        return 1.0
    return max(0.0, free - 2 * max(free, 0) ** 0.5) / coming


def propagate(cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """(g, cell, shard) of the cells (g, cell, n) of linked rows, after ``rounds`` of moves under ``quota``."""
    spark, shards = cells.sparkSession, len(quota)
    half = max(1, min(quota) // 2)
    sizes = cells.groupBy("g").agg(F.sum("n").alias("size"))
    cells = save(cells.join(sizes, "g"), "shard-cells")
    # fewer than 2 * shards groups of at most ``shards`` cells each
    large = [(r["g"], r["cell"], r["n"]) for r in cells.where(F.col("size") > half).collect()]
    room = list(quota)
    placed = _fill_large(large, room)
    fixed = spark.createDataFrame([(g, c, s) for (g, c), s in placed.items()], "g bigint, cell int, shard int")

    # what starts in a shard that large groups mostly fill goes elsewhere, a group's rows together
    free = [j for j in range(shards) if room[j] >= half] or list(range(shards))
    other = _by_shard(free, F.pmod(F.xxhash64("g"), F.lit(len(free))).cast("int"))
    state = cells.where(F.col("size") <= half).select("g", "cell", "n", F.when(
        _by_shard([j in free for j in range(shards)], F.col("cell")), F.col("cell")).otherwise(other).alias("shard"))
    for turn in range(rounds):
        # neighbours vote: the shard with most of the group, and among equal ones any, but the same for all
        votes = state.groupBy("g", "shard").agg(F.sum("n").alias("votes"))
        wish = votes.groupBy("g").agg(F.max(F.struct("votes", F.xxhash64("g", "shard", F.lit(turn)).alias("tie"), "shard")).alias(
            "best")).select("g", F.col("best.shard").alias("target"))
        moves = checkpointed(state.join(wish, "g"))
        seen = moves.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()  # at most shards ** 2 rows
        staying, coming = [0] * shards, [0] * shards
        for r in seen:
            (staying if r["shard"] == r["target"] else coming)[r["target"]] += r["n"]
        if not any(coming):
            state = moves
            break
        share = [_share(room[j] - staying[j], coming[j]) for j in range(shards)]
        let = F.pmod(F.xxhash64("g", F.lit(-1 - turn)), F.lit(1 << 20)) < _by_shard(share, F.col("target")) * (1 << 20)
        state = moves.select("g", "cell", "n", F.when(let, F.col("target")).otherwise(F.col("shard")).alias("shard"))
    return state.select("g", "cell", "shard").union(fixed)


def assign(docs: DataFrame, shards: int = 40, rounds: int = 8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard and slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("g")).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "shard-rows")
    total = rows.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    cells = rows.groupBy("g", "cell").agg(F.count("*").alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("size")).where("size > 1").select("g")
    labels = save(propagate(cells.join(linked, "g"), quota, rounds), "shard-labels")

    placed = save(rows.join(labels.select("g", F.col("cell").alias("cell"), F.col("shard").alias("wanted")), ["g", "cell"], "left")
                  .select("row", "doc_id", "size", "text_crc32", "wanted"), "shard-wanted")
    ranked = save(numbered(placed.where("wanted is not null"), "wanted", -(-total // shards), "place"), "shard-ranked")
    stays = F.col("place") < _by_shard(quota, F.col("wanted"))
    held = [0] * shards
    for r in ranked.where(stays).groupBy("wanted").agg(F.count("*").alias("n")).collect():
        held[r["wanted"]] = r["n"]
    ends = [sum(quota[i] - held[i] for i in range(j + 1)) for j in range(shards)]
    rest = placed.where("wanted is null").select("row", "doc_id", "size", "text_crc32").union(
        ranked.where(~stays).select("row", "doc_id", "size", "text_crc32")).withColumn("all", F.lit(0))
    rest = numbered(save(rest, "shard-rest"), "all", total, "place")
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place")))
    rest = rest.withColumn("shard", shard).withColumn(
        "slot", F.col("place") - _by_shard([0, *ends], F.col("shard")) + _by_shard(held, F.col("shard")))
    return ranked.where(stays).select("doc_id", "size", "text_crc32", F.col("wanted").cast("int").alias("shard"),
                                      F.col("place").cast("long").alias("slot")).union(
        rest.select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long")))
