"""Embedding near-dedup by spherical-cap filters.

Two vectors of one label link if their cosine is ``THRESHOLD`` or more.

1. Exact copies of (label, vector) are one class.
2. Filters.  A code is a random rotation, cut into ``BLOCKS`` blocks, with ``WORDS``
   random unit directions in each; a choice of one direction per block is a filter
   (64 ** 4 of them a code).  A vector lies in the caps of all filters whose score
   exceeds its best score less ``MARGIN``.  A filter's score is the sum of its blocks'
   scores, so these are listed block by block, dropping every beginning that has lost
   more than the margin; no other filter is looked at.
3. Filters that hold two classes or more are kept, with their vectors.  A filter with
   more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a unit of
   its own, so that no task holds a large group.
4. Each unit verifies cosines in double precision.  A pair counts in the smallest filter
   that it shares alone, so links are counted once and never written out; of the links
   themselves a spanning forest goes on to the components.

Two vectors with a cosine of 0.98 share no filter with a probability of about 1e-4 at 64
dimensions (tests hold the links against brute force); closer ones less.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries, and
rows without a label, link with nothing and are their own component; vectors of different
lengths never link; a null vec_id never names a component (one made of nulls has none) and
its row isn't kept; repeated ids and rows are vectors like others; other columns are
ignored; an empty table gives an empty result.  Classes are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import connected_components, save, sent

THRESHOLD = 0.98
#: Codes, blocks of a code, directions in a block, and what a filter's score may lack of the best.
CODES, BLOCKS, WORDS, MARGIN = 2, 4, 64, 0.15
#: Classes of a filter that are compared at once, and entries that a task verifies about.
BLOCK, TOGETHER = 1024, 20_000
#: Filters of up to this many classes are compared many at a time.
SMALL = 24


@lru_cache(maxsize=16)
def code(dimension: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, directions by block) of one code; vectors are led into a multiple of ``BLOCKS``, 16 at least."""
    rng = np.random.default_rng([dimension, number])
    width = max(16, -(-dimension // BLOCKS) * BLOCKS)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0][:dimension]
    words = rng.standard_normal((BLOCKS, WORDS, width // BLOCKS))
    # a filter's score over random vectors has variance 1
    return rotation, words / np.linalg.norm(words, axis=2, keepdims=True) * np.sqrt(width / BLOCKS)


def caps(units: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of a code that the rows of ``units`` exceed."""
    rotation, words = code(units.shape[1], number)
    parts = (units @ rotation).reshape(len(units), BLOCKS, -1)
    lost = np.einsum("nbd,bkd->nbk", parts, words, optimize=True)
    lost = lost.max(axis=2, keepdims=True) - lost
    row, so_far, chosen = np.arange(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
    for b in range(BLOCKS):
        total = so_far[:, None] + lost[row, b]
        i, j = np.nonzero(total <= MARGIN)
        row, so_far, chosen = row[i], total[i, j], chosen[i] * WORDS + j
    return row, chosen


def unit_rows(c: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest entry first, so that no square overflows or vanishes."""
    c = c / np.abs(c).max(axis=1, keepdims=True)
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(filter, cls) of every cap that a class (cls, label hash, embedding) lies in."""
    for batch in batches:
        cls, label = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets)
        lengths, flat = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False).astype(float)
        for d in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == d)
            for rows in np.array_split(of, -(-len(of) // 1024)):
                units = unit_rows(flat[offsets[rows][:, None] + np.arange(d)])
                for number in range(CODES):
                    row, chosen = caps(units, number)
                    home = label[rows][row].view(np.uint64) + np.uint64(d * CODES + number)
                    f = _mixed(_mixed(home) + chosen.astype(np.uint64))
                    yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(cls[rows][row])], names=["f", "cls"])


def _first_shared(x: np.ndarray, y: np.ndarray, f: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether ``f`` is the smallest filter that both of each pair (x, y) are held by; held: sorted, one row a class."""
    out = np.ones(len(x), bool)
    step = max(1, 4_000_000 // held.shape[1] ** 2)
    for at in range(0, len(x), step):
        a, b, own = held[x[at:at + step]], held[y[at:at + step]], f[at:at + step]
        a = np.where(a < own[:, None], a, -1)  # filters are >= 0 here: ranks
        out[at:at + step] = ~((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def _pairs(rank: np.ndarray, side: np.ndarray, who: np.ndarray, cut: np.ndarray, units: np.ndarray,
           held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (x, y) of each unit ``cut[i]:cut[i + 1]``, each in the first filter that it shares."""
    sizes = np.diff(cut)
    for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        starts = cut[:-1][sizes == s]
        left, right = np.triu_indices(s, 1)
        step = max(1, 500_000 // (s * s))
        for at in range(0, len(starts), step):
            first = starts[at:at + step]
            rows = who[first[:, None] + np.arange(s)]
            near = np.einsum("rid,rjd->rij", units[rows], units[rows], optimize=True)[:, left, right] >= THRESHOLD
            sides = side[first[:, None] + np.arange(s)]
            # in a unit of two blocks only pairs across them count
            near &= (sides[:, left] != sides[:, right]) | (sides.min(axis=1) == sides.max(axis=1))[:, None]
            r, p = np.nonzero(near)
            x, y, f = rows[r, left[p]], rows[r, right[p]], rank[first][r]
            yes = _first_shared(x, y, f, held)
            yield x[yes], y[yes]
    for i in np.flatnonzero(sizes > SMALL).tolist():
        lo, hi = cut[i], cut[i + 1]
        rows, sides, f = who[lo:hi], side[lo:hi], rank[lo]
        across = sides.min() != sides.max()
        a, b = (rows[sides == sides.min()], rows[sides == sides.max()]) if across else (rows, rows)
        near = units[a] @ units[b].T >= THRESHOLD
        if not across:
            near &= np.triu(np.ones(near.shape, bool), 1)
        # filters below f that both hold: a product of memberships
        before = np.unique(held[rows][(held[rows] >= 0) & (held[rows] < f)])
        if len(before):
            def member(of: np.ndarray) -> np.ndarray:
                m = np.zeros((len(of), len(before) + 1), np.float32)
                at = np.searchsorted(before, held[of])
                fits = (held[of] >= 0) & (held[of] < f)
                m[np.repeat(np.arange(len(of)), held.shape[1]), np.where(fits, at, len(before)).ravel()] = 1
                return m[:, :-1]
            near &= member(a) @ member(b).T == 0
        x, y = np.nonzero(near)
        yield a[x], b[y]


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """(cls, n, root) of the classes with links: rows linked there, and the smallest class in reach there."""
    pdf = pdf.sort_values(["f", "i", "j"], kind="stable", ignore_index=True)
    ids, first, who = np.unique(pdf["cls"].to_numpy(), return_index=True, return_inverse=True)
    vectors = [np.asarray(x, float) for x in pdf["embedding"].iloc[first]]
    units = np.zeros((len(ids), max(map(len, vectors))))
    for k, v in enumerate(vectors):
        units[k, :len(v)] = unit_rows(v[None])[0]
    weight = pdf["weight"].to_numpy()[first]
    lists = [np.asarray(x, np.int64) for x in pdf["filters"].iloc[first]]
    known = np.unique(np.concatenate(lists))
    held = np.full((len(ids), max(map(len, lists))), -1, np.int64)
    for k, x in enumerate(lists):
        held[k, :len(x)] = np.searchsorted(known, x)
    rank = np.searchsorted(known, pdf["f"].to_numpy())
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    cut = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
    n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for x, y in _pairs(rank, pdf["side"].to_numpy(), who, cut, units, held):
        np.add.at(n, x, weight[y])
        np.add.at(n, y, weight[x])
        while True:
            low = np.minimum(root[x], root[y])
            apart = root[x] != root[y]
            if not apart.any():
                break
            np.minimum.at(root, root[x][apart], low[apart])
            np.minimum.at(root, root[y][apart], low[apart])
            while (root[root] != root).any():
                root = root[root]
    linked = n > 0
    return pd.DataFrame({"cls": ids[linked], "n": n[linked], "root": ids[root[linked]]})


def _class_of(d: DataFrame) -> Column:
    """A class's 64-bit id; null for rows that link with nothing."""
    x = lambda v: v.cast("double")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return F.when(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: x(v) != 0.0),
                  F.xxhash64("label", "embedding"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    rows = vectors.select("vec_id", _class_of(vectors).alias("cls"), "label", "embedding")
    classes = save(rows.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.xxhash64(F.first("label")).alias("home"),
        F.first("embedding").alias("embedding")), "caps-classes")
    entries = save(classes.select("cls", "home", "embedding").mapInArrow(_entries, "f bigint, cls bigint"), "caps-entries")
    crowded = save(entries.groupBy("f").agg(F.count("*").alias("m")).where("m > 1")
                   .select("f", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"), "m"), "caps-crowded")
    own = entries.join(sent(crowded.select("f", "parts"), 12), "f").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("f", "parts"))).alias("at"))  # a vector's own filters: some tens
    total = crowded.agg(F.sum(F.col("m") * F.col("parts"))).first()[0] or 0
    tasks = max(8, -(-total // TOGETHER))
    entry = classes.join(own, "cls").select("cls", "weight", "embedding", F.col("at.f").alias("filters"), F.explode("at").alias("x"))
    entry = entry.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("x.parts")).cast("int")).select(
        "cls", "weight", "embedding", "filters", F.col("x.f").alias("f"), "side",
        F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("other"))
    entry = entry.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other")
    found = save(entry.groupBy(F.pmod(F.xxhash64("f", "i", "j"), F.lit(tasks)).alias("task")).applyInPandas(
        lambda pdf: _verified(pdf), "cls bigint, n bigint, root bigint"), "caps-found")

    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    # classes of more than one row or with links; all others stand alone
    grouped = classes.select("cls", "weight", "least").join(counts, "cls", "left").join(
        labels.withColumnRenamed("node", "cls"), "cls", "left").where("weight > 1 or n is not null")
    grouped = save(grouped.select("cls", "least", F.coalesce("component", "cls").alias("component"),
                                  (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "caps-grouped")
    names = save(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "caps-names")
    named = save(grouped.join(sent(names, 16), "component").select("cls", "n_links", "component_id"), "caps-named")
    out = rows.select("vec_id", "cls").join(sent(named.withColumn("known", F.lit(True)), 25), "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
