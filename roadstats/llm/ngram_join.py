"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two texts link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or
more.  Exact copies of a set are one entry.  Steps:

1. Candidates.  Every linked set shares at least a fifth of its size, among its 40 %
   smallest shingle hashes, with some other set (threshold 0.8; see ``_kept``).
   These hashes are sent in packed blocks, by hash range, to where the repeated ones
   are counted; sets below that bound have no partner and stop here.
2. Inverted lists of the candidates.  Lists of a few hashes per set are searched in
   blocks of bounded size, linking most of each group of near copies; the groups
   become components.
3. Every shingle by which linked sets must meet (each set's prefix, rarest shingles
   first) and which still lies in two components gives the pairs across them; they
   are searched too.  Pairs inside a component need no search, as they can't change
   the result, so a large group of near copies isn't expanded into all its pairs.

A search (``t_occurrence``) heap-merges the query's short lists, keeps the sets that
occur often enough there, and probes its long lists for those by binary search.

Defined cases: null and wordless texts have an empty set, link with nothing and are
their own component; texts of fewer than five words are one shingle; equal rows are
in one component; a null doc_id never names a component (one made of nulls only has
none); other columns are ignored.  Sets are told apart by a 64-bit hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadstats.llm.common import connected_components, free_names, give_back, null_safe, save, sent
from roadstats.llm.shingles import WordHashes, shingle_set, signature, words_of

#: Per cent of the union that linked sets share.
THRESHOLD = 80
#: Postings that a task packs at once, and that one hash range holds at most on average.
FLUSH, RANGE = 1_000_000, 2_000_000
#: Hashes of each set whose lists are searched first, sets in a block of these, and sets that one query is held to at once.
FIRST_LISTS, BLOCK, ASKED = 2, 64, 512


def _kept(n: int) -> int:
    """Hashes of a set of ``n`` that stand for it in step 1.

    Linked sets of m = max(n, n') share at least 0.8 m hashes; at most 0.6 m of these
    lie beyond either's cut, so at least 0.2 m >= 0.2 n are repeated before it.
    """
    return n - n * 3 * THRESHOLD // 400


def set_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sig, n_shingles) of every row; sig is null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, sigs = [], []
            for text in batch.column(2):
                values = shingle_set(words_of(text.as_py()), hashes)
                sizes.append(len(values))
                sigs.append(signature(values) if len(values) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sigs, pa.int64()),
                                   pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "sig", "n_shingles"])
        del hashes
        give_back()
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, sig bigint, n_shingles bigint")


def _packed_postings(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, hashes, sigs): blocks of postings of one range of hashes, packed as arrays.

    A hash is held by 32 bits within its range, enough to overcount repeats rarely,
    and never to miss one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        tokens, owners, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, s = np.concatenate(tokens).view(np.uint64), np.concatenate(owners)
            part = ((t >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            t, s, part = t[order].astype(np.uint32), s[order], part[order]
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                yield pa.record_batch([pa.array([int(i)], pa.int64()), pa.array([t[a:b].tobytes()], pa.binary()),
                                       pa.array([s[a:b].tobytes()], pa.binary())], names=["part", "hashes", "sigs"])

        for batch in batches:
            for text in batch.column(0):
                values = shingle_set(words_of(text.as_py()), hashes)
                if not len(values):
                    continue
                sig = signature(values)
                if sig in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(sig)
                kept = values[:_kept(len(values))]
                tokens.append(kept)
                owners.append(np.full(len(kept), sig, np.int64))
                held += len(kept)
                if held >= FLUSH:
                    yield from flush()
                    tokens, owners, held = [], [], 0
        if held:
            yield from flush()
        hashes, seen, tokens, owners = None, None, None, None
        give_back()
    return docs.select("text").mapInArrow(run, "part bigint, hashes binary, sigs binary")


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """(sig, hits): hashes of a range that two sets have, counted for each set."""
    t = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]])
    s = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sigs"]])
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    t, s = t[fresh], s[fresh]
    same = t[1:] == t[:-1]
    again = np.zeros(len(t), bool)
    again[1:] |= same
    again[:-1] |= same
    sigs, hits = np.unique(s[again], return_counts=True)
    del t, s, order, fresh, same, again
    give_back()
    return pd.DataFrame({"sig": sigs, "hits": hits.astype(np.int64)})


def candidate_sets(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(sig, n, tokens) of the sets that pass step 1; one row a set, tokens sorted."""
    sets = signatures.where("sig is not null").groupBy("sig").agg(
        F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    ranges = max(8, -(-total * 2 // 5 // RANGE))
    hits = _packed_postings(docs, ranges).groupBy("part").applyInPandas(_repeated, "sig bigint, hits bigint")
    hits = hits.groupBy("sig").agg(F.sum("hits").alias("hits"))
    chosen = save(sets.join(hits, "sig").where(F.col("hits") * 400 >= F.col("n") * THRESHOLD)
                  .select("sig", "doc_id"), "join-chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for sig, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(words_of(text.as_py()), hashes)
                if len(values) and signature(values) == sig:
                    yield pa.record_batch([pa.array([sig], pa.int64()), pa.array([len(values)], pa.int64()),
                                           pa.array([values], pa.list_(pa.int64()))], names=["sig", "n", "tokens"])
        del hashes
        give_back()
    texts = null_safe(docs.select("doc_id", "text"), sent(chosen, 32), ["doc_id"], "inner").select("sig", "text")
    found = texts.mapInArrow(run, "sig bigint, n bigint, tokens array<bigint>")
    return save(found, "join-sets").dropDuplicates(["sig"])


def t_occurrence(query: np.ndarray, lists: dict[int, np.ndarray], need: int) -> dict[int, int]:
    """{entry: overlap} of the entries that occur in at least ``need`` of the query's inverted lists (DivideSkip).

    The long lists are set aside, and entries must occur need - len(long) times in the
    short ones, which are merged by a heap; then each long list is probed for them by
    binary search.
    """
    own = sorted((lists[t] for t in query.tolist() if t in lists), key=len)
    if len(own) < need:
        return {}
    long = max(0, need - max(1, need // 8))
    short, long = own[:len(own) - long], own[len(own) - long:]
    often = need - len(long)
    entries, total = np.unique(np.fromiter(heapq.merge(*[x.tolist() for x in short]), np.int64), return_counts=True)
    entries, total = entries[total >= often], total[total >= often]
    if long and len(entries):
        # all long lists laid end to end, so that one binary search probes each of them for each entry
        span = 1 + max(int(entries[-1]), max(int(x[-1]) for x in long))
        laid = np.concatenate([x + i * span for i, x in enumerate(long)])
        probes = (np.arange(len(long))[:, None] * span + entries).ravel()
        at = np.minimum(np.searchsorted(laid, probes), len(laid) - 1)
        total = total + (laid[at] == probes).reshape(len(long), -1).sum(axis=0)
    return {e: n for e, n in zip(entries.tolist(), total.tolist()) if n >= need}


def inverted_lists(sets: list[np.ndarray], only: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """{hash: entries that have it, ascending} of the hashes that two entries have; only: of these alone."""
    if only is not None:
        # set by set, so that no copy of all of them is made
        sets = [x[only[np.minimum(np.searchsorted(only, x), len(only) - 1)] == x] for x in sets]
    t, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(t, kind="stable")
    t, owner = t[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
    return {int(t[a]): owner[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1}


def search_block(sets: list[np.ndarray], queries: list[int], spanning: bool) -> list[tuple[int, int]]:
    """Links (i, j) of ``queries`` with all of ``sets``; spanning: none between entries that links already connect, so
    that the search ends when all are."""
    lists = inverted_lists(sets, sets[queries[0]] if len(queries) == 1 else None)
    group, apart = list(range(len(sets))), len(sets)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    links = []
    for q in queries:
        if spanning and apart == 1:
            break
        size = len(sets[q])
        need = -(-size * THRESHOLD // 100)
        for other, shared in t_occurrence(sets[q], lists, need).items():
            union = size + len(sets[other]) - shared
            if other == q or shared * 100 < union * THRESHOLD:
                continue
            a, b = root(q), root(other)
            if a != b or not spanning:
                links.append((q, other))
                apart -= a != b
                group[max(a, b)] = min(a, b)
    return links


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within a block of sets; rows marked ``asks`` are the queries."""
    pdf = pdf.sort_values(["sig", "asks"], ascending=[True, False]).drop_duplicates("sig")
    sigs = pdf["sig"].to_numpy()
    if len(sigs) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    pairs = search_block([np.asarray(x, np.int64) for x in pdf["tokens"]], np.flatnonzero(pdf["asks"]).tolist(), True)
    return pd.DataFrame({"a": [sigs[i] for i, _ in pairs], "b": [sigs[j] for _, j in pairs]}, dtype="int64")


def set_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked sets of ``sets`` (sig, n, tokens)."""
    sets = save(sets, "join-distinct")
    tokens = sets.select("sig", "n", F.explode("tokens").alias("t"))
    lists = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("sig")
    posts = tokens.join(lists, "t").select(
        "sig", "n", "t", "df", F.count("*").over(own).alias("shared"),
        F.row_number().over(own.orderBy("df", "t")).alias("rarity"), F.row_number().over(own.orderBy("t")).alias("place"))
    # too few shingles that any other set has; else the prefix, after the shingles that are the set's alone
    need = F.ceil(F.col("n") * THRESHOLD / 100)
    posts = posts.where(F.col("shared") >= need).withColumn("pos", F.col("rarity") + F.col("n") - F.col("shared"))
    posts = posts.withColumn("prefix", F.col("pos") <= F.col("n") - need + 1)
    posts = save(posts.where(F.col("prefix") | (F.col("place") <= FIRST_LISTS)).select(
        "sig", "n", "t", "pos", "prefix", "place"), "join-posts")

    first = posts.where(F.col("place") <= FIRST_LISTS)
    blocks = first.groupBy("t").agg(F.count("*").alias("in_list")).where("in_list > 1")
    first = first.join(blocks, "t").select("sig", "t", F.pmod(
        F.xxhash64("t", "sig"), F.ceil(F.col("in_list") / BLOCK)).alias("block"))
    links = first.join(sets, "sig").withColumn("asks", F.lit(True)).groupBy("t", "block").applyInPandas(
        _links, "a bigint, b bigint")
    links = save(links, "join-first-links")

    labels = connected_components(links)
    labelled = posts.where("prefix").join(labels, posts["sig"] == labels["node"], "left").select(
        "sig", "n", "t", "pos", F.coalesce("component", "sig").alias("label"))
    split = labelled.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    across = save(labelled.join(split.select("t"), "t"), "join-across")
    # the side whose component is smaller asks, so that few queries meet a large group
    sizes = labels.groupBy("component").agg(F.count("*").alias("members"))
    across = across.join(sizes, across["label"] == sizes["component"], "left").select(
        "sig", "n", "t", "pos", "label", F.struct(F.coalesce("members", F.lit(1)).alias("members"), "label").alias("rank"))
    x, y = across.select("t", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "pos", "rank")]), across.drop("label")
    # two linked sets share so many shingles that the rarest of these lies this early in both
    least = F.ceil((F.col("n") + F.col("n_a")) * THRESHOLD / (100 + THRESHOLD))
    pairs = x.join(y, "t").where((F.col("rank_a") < F.col("rank")) & (F.col("pos") <= F.col("n") - least + 1)
                                 & (F.col("pos_a") <= F.col("n_a") - least + 1))
    pairs = save(pairs.select(F.col("sig_a").alias("a"), F.col("sig").alias("b")).distinct(), "join-pairs")
    asked = pairs.groupBy("a").agg(F.ceil(F.count("*") / ASKED).alias("blocks"))
    pairs = pairs.join(asked, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
    rows = pairs.select("a", "block", F.col("b").alias("sig"), F.lit(False).alias("asks")).union(
        pairs.select("a", "block").distinct().select("a", "block", F.col("a").alias("sig"), F.lit(True)))
    more = rows.join(sets, "sig").withColumnRenamed("a", "query").groupBy("query", "block").applyInPandas(
        _links, "a bigint, b bigint")
    return save(links.union(more), "join-links")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component (a set of it; null without words)
    and component_id, the smallest doc_id in reach by links."""
    signatures = save(set_signatures(docs), "join-signatures")
    labels = connected_components(set_links(candidate_sets(docs, signatures)))
    smallest = signatures.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    grouped = smallest.join(labels, smallest["sig"] == labels["node"], "left").select(
        "sig", "least", F.coalesce("component", "sig").alias("component"))
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    out = signatures.join(named.select("sig", "component", "component_id"), "sig", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.when(
        F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component left: that of the smallest doc_id (a null one comes
    last, then the smallest text hash), and of equal rows one.  All columns stay; texts without words stay."""
    found = save(jaccard_join(docs), "join-components")
    first = found.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x"))
    keys = free_names(docs, "__doc_id", "__text_hash")
    stay = first.select(F.col("x.doc_id").alias(keys[0]), F.col("x.text_hash").alias(keys[1])).union(
        found.where("component is null").select("doc_id", "text_hash")).distinct()
    worded = found.where("component is not null").select("doc_id", "text_hash")
    again = save(worded.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias(keys[0]), F.col("text_hash").alias(keys[1])), "join-equal-rows")
    keyed = docs.withColumns({keys[0]: F.col("doc_id"), keys[1]: F.xxhash64("text")})
    kept = null_safe(keyed, sent(save(stay, "join-stay"), 32), keys, "left_semi")
    once = null_safe(kept, again, keys, "left_anti")
    equal = null_safe(kept, again, keys, "left_semi").dropDuplicates(keys)
    return once.union(equal).drop(*keys)
