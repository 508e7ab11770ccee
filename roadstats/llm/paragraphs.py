"""Substring dedup: paragraph MinHash banding.

A paragraph is a line of at least ``MIN_WORDS`` words, as its set of 5-word shingles.
So that passages are also met inside longer lines and across line breaks, the text's
word sequence (line breaks are blanks) has units besides: ``UNIT`` words from each word
whose shingle hash is the least of some ``WINDOW`` consecutive ones.  Any ``SPAN`` (50)
words in a row that two texts share hold a whole unit of both: that is the shortest span
that is surely met; a shorter one may be.
Equal word sequences (A-Z lower-cased) are one entry.  Each entry's MinHash signature is cut into bands, tuned for
high recall at the similarity asked for.  Of entries that collide in a band each is held
against the first of the bucket and the one before, by exact Jaccard similarity; then
every bucket whose entries still lie in two components is searched with inverted lists,
in blocks of bounded size, until each of its pairs across components is decided
(``across_links``).  Components of what is similar are clusters.
The first paragraph of a cluster stays, the others are to be removed.  A unit that comes
only once in all texts is dropped by an aggregate before anything else of it is computed;
those that come twice are banded, verified and clustered as the lines are, never with lines.  Units of a
cluster that overlap in one text are one member, and its span is theirs; the first member
outside removed lines stays.  A unit's number follows those of its text's lines; units
inside a removed line, and staying ones inside a repeated line, get no row.

Band keys travel in packed blocks, by key range, and only keys that two entries have
leave them.  Defined cases: null, empty and short-lined texts have no paragraphs and no
rows; a paragraph that comes twice in one document is a repeat too; of equal doc_ids
the first paragraph by (doc_id, paragraph, start) stays, equal rows are one document and
get one row a paragraph each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadstats.llm.common import connected_components, null_safe, save, sent
from roadstats.llm.shingles import SHINGLE
from roadstats.llm.word_arrays import Words, in_chunks, mixed, taken

MIN_WORDS, THRESHOLD = 20, 80
#: Words that surely hold a whole unit, words of a unit (whole shingles), and shingles of which the least starts one.
SPAN, UNIT = 50, MIN_WORDS
WINDOW, UNIT_SHINGLES = SPAN - UNIT + 1, UNIT - SHINGLE + 1
#: Hashes that a task holds before it sends them, band keys of a range on average, and bytes of text whose units are.
FLUSH, RANGE, RANGE_BYTES = 1_500_000, 2_000_000, 100_000_000
#: Shingles in a block of a bucket on average, entries of a block that ask before the largest group is left out, and
#: lots of blocks at least.
BLOCK, CENTRAL, LEAST_LOTS = 400_000, 16, 200
_MIX = np.uint64(0xD6E8FEB86659FD93)


def tune_bands(threshold: float, recall: float, most_hashes: int = 80) -> tuple[int, int]:
    """(bands, rows): the longest bands, so the fewest chance collisions, with which a pair at the threshold is met
    with probability ``recall`` within ``most_hashes``."""
    for rows in range(12, 0, -1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most_hashes, 1


BANDS, ROWS = tune_bands(THRESHOLD / 100, 0.999)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose hashes are computed together.
TOGETHER = 4096


def band_keys(tokens: np.ndarray, offsets: np.ndarray, kind: int = 0) -> np.ndarray:
    """Band keys (sets, bands; uint64) of the sets of ``tokens`` (none empty) that begin at ``offsets``; sets of another
    ``kind`` have other keys."""
    x = tokens.view(np.uint64)
    x = x ^ (x >> np.uint64(29))
    sizes = np.diff(np.r_[offsets, len(x)])
    # a long set is hashed in pieces
    pieces = -(-sizes // TOGETHER)
    own = np.cumsum(pieces) - pieces
    starts = np.repeat(offsets - own * TOGETHER, pieces) + np.arange(pieces.sum()) * TOGETHER
    ends, least, i = np.r_[starts[1:], len(x)], np.empty((len(starts), BANDS * ROWS), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + TOGETHER, "right")))
        hashed = _SEEDS[:, None] * x[starts[i]:ends[j - 1]]
        least[i:j] = np.minimum.reduceat(hashed, starts[i:j] - starts[i], axis=1).T
        i = j
    if len(starts) > len(offsets):
        least = np.minimum.reduceat(least, own, axis=0)
    least = least.reshape(len(offsets), BANDS, ROWS)
    key = np.tile(np.arange(1 + kind * BANDS, 1 + (kind + 1) * BANDS, dtype=np.uint64) * _MIX, (len(offsets), 1))
    for i in range(ROWS):
        key = (key ^ least[:, :, i]) * _MIX
        key ^= key >> np.uint64(32)
    return key


class Lines:
    """The lines of ``words`` that have enough words: ``first`` word, ``count`` of words, and ``sig``, a hash of them."""

    def __init__(self, words: Words, shingles: np.ndarray):
        first, count = words.runs(words.line)
        long = count >= MIN_WORDS
        self.first, self.count, self.shingles = first[long], count[long], shingles
        tokens, offsets = self.tokens(np.arange(len(self.first)))
        place = np.arange(len(tokens)) - np.repeat(offsets, self.count - SHINGLE + 1)
        value = mixed(tokens.view(np.uint64) + place.astype(np.uint64) * _MIX)
        self.sig = (np.add.reduceat(value, offsets) if len(offsets) else value).view(np.int64)

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles of the lines ``which``, where each line's begin)."""
        at, offsets = taken(self.first[which], self.count[which] - SHINGLE + 1)
        return self.shingles[at], offsets


def _slide(x: np.ndarray, f: np.ufunc) -> np.ndarray:
    """``f`` over every ``WINDOW`` consecutive values."""
    width = 1
    while width * 2 <= WINDOW:
        x, width = f(x[:-width], x[width:]), width * 2
    return f(x[:-(WINDOW - width)], x[WINDOW - width:]) if width < WINDOW else x


def units(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, sig) of every unit of a text, from its shingle hashes in order; sig: a hash of the unit's words."""
    x = shingles.view(np.uint64)
    if len(x) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, _slide(x, np.minimum), edge]), np.maximum) == x)
    at = at[at + UNIT_SHINGLES <= len(x)]
    sig = np.zeros(len(at), np.uint64)
    for i in range(0, UNIT, SHINGLE):
        sig = (sig ^ x[at + i]) * _MIX
        sig ^= sig >> np.uint64(32)
    return at, sig.view(np.int64)


def all_units(words: Words, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, sig) of every unit of every text of ``words``."""
    at, sigs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, n in zip(*[x.tolist() for x in words.runs(words.text)]):
        if n >= SPAN:
            own, sig = units(shingles[first:first + n - SHINGLE + 1])
            at.append(own + first)
            sigs.append(sig)
    return np.concatenate(at), np.concatenate(sigs)


class Packer:
    """Rows of 64-bit keys packed by range: blocks (part, keys, sigs), a key held by 32 bits in its range."""

    def __init__(self, ranges: int):
        self.ranges, self.keys, self.owners, self.held = ranges, [], [], 0

    def add(self, keys: np.ndarray, sigs: np.ndarray) -> None:
        self.keys.append(keys.ravel())
        self.owners.append(np.repeat(sigs, keys.shape[1]))
        self.held += keys.size

    def blocks(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """What is held, if that is ``least`` keys."""
        if self.held < least:
            return
        k, s = np.concatenate(self.keys), np.concatenate(self.owners)
        self.keys, self.owners, self.held = [], [], 0
        part = ((k >> np.uint64(32)) % np.uint64(self.ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        k, s = k[order].astype(np.uint32), s[order]
        cuts = np.searchsorted(part[order], np.arange(self.ranges + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            yield pa.record_batch([pa.array([int(i)], pa.int64()), pa.array([k[a:b].tobytes()], pa.binary()),
                                   pa.array([s[a:b].tobytes()], pa.binary())], names=["part", "keys", "sigs"])


class Seen:
    """The hashes that a worker has met lately."""

    def __init__(self, most: int = 300_000):
        self.most, self.held = most, set()

    def fresh(self, sigs: np.ndarray) -> np.ndarray:
        """Places of the first of each hash not met."""
        if len(self.held) > self.most:
            self.held.clear()
        out = []
        for i, sig in enumerate(sigs.tolist()):
            if sig not in self.held:
                self.held.add(sig)
                out.append(i)
        return np.array(out, np.int64)


def repeated_units(docs: DataFrame, ranges: int) -> DataFrame:
    """(sig) of the units that come twice or more.  Each task sends a unit's hash once for every so many units it
    reads, packed by range and marked if it came twice there; so no hash can fill a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            sigs, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (sigs.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
            for twice in (False, True):
                own, sent_to = sigs[(counts > 1) == twice], part[(counts > 1) == twice]
                order = np.argsort(sent_to, kind="stable")
                cuts = np.searchsorted(sent_to[order], np.arange(ranges + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    yield pa.record_batch([pa.array([int(i)], pa.int64()), pa.array([twice]),
                                           pa.array([own[order[cuts[i]:cuts[i + 1]]].tobytes()], pa.binary())],
                                          names=["part", "twice", "sigs"])
        for batch in batches:
            for _, texts in in_chunks(batch.column(0)):
                words = Words(texts)
                held.append(all_units(words, words.shingles())[1])
                n += len(held[-1])
                if n >= FLUSH:
                    yield from blocks()
                    held, n = [], 0
        if n:
            yield from blocks()

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.int64) for x in pdf["sigs"]]
        sigs, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = [x for x, t in zip(own, pdf["twice"]) if t]
        return pd.DataFrame({"sig": np.unique(np.concatenate([sigs[counts > 1], *twice]))})
    packed = docs.select("text").mapInArrow(run, "part bigint, twice boolean, sigs binary")
    return save(packed.groupBy("part").applyInPandas(met, "sig bigint"), "paragraph-repeated-units")


def paragraph_table(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, end, n_words, sig, row, word, line) of every paragraph and unit; word and line are
    null for a whole line, else the unit's first word and the line that holds it, -1 if none does."""
    names = ["doc_id", "paragraph", "start", "end", "n_words", "sig", "row", "word", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in in_chunks(batch.column(1)):
                words = Words(texts)
                shingles = words.shingles()
                lines, (at, sigs) = Lines(words, shingles), all_units(words, shingles)
                text, line = words.text[lines.first], words.line[lines.first]
                start, end = words.line_bytes(line)
                of_lines = [line - words.first_line(text), words.points(start, text), words.points(end, text), lines.count, lines.sig]
                own, to = words.text[at], at + UNIT - 1
                head, n = words.runs(own)
                numbers = np.arange(len(at)) - np.repeat(head, n)
                begins, _ = words.runs(words.text)
                word = at - begins[np.searchsorted(begins, at, "right") - 1] if len(at) else at
                inside = np.where(words.line[at] == words.line[to], words.line[at] - words.first_line(own), -1)
                of_units = [words.first_line(own + 1) - words.first_line(own) + numbers, words.points(words.first[at], own),
                            words.points(words.last[to], own), np.full(len(at), UNIT), sigs]
                rows, none = pa.array(np.r_[text, own] + begin), pa.nulls(len(text), pa.int64())
                yield pa.record_batch(
                    [batch.column(0).take(rows), *[pa.array(np.r_[a, b].astype(np.int64)) for a, b in zip(of_lines, of_units)],
                     batch.column(2).take(rows), *[pa.concat_arrays([none, pa.array(x.astype(np.int64))]) for x in (word, inside)]],
                    names=names)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"doc_id {kind}, paragraph bigint, start bigint, end bigint, n_words bigint, sig bigint, row bigint, "
             "word bigint, line bigint")


def _line_bands(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, keys, sigs): packed band keys of every line that is a paragraph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(ranges), Seen()
        for batch in batches:
            for _, texts in in_chunks(batch.column(0)):
                words = Words(texts)
                lines = Lines(words, words.shingles())
                fresh = seen.fresh(lines.sig)
                if len(fresh):
                    packer.add(band_keys(*lines.tokens(fresh)), lines.sig[fresh])
                yield from packer.blocks(FLUSH)
        yield from packer.blocks()
    return docs.select("text").mapInArrow(run, "part bigint, keys binary, sigs binary")


def _set_bands(sets: DataFrame, ranges: int) -> DataFrame:
    """(part, keys, sigs): packed band keys of units, from their sets (sig, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(ranges)
        for batch in batches:
            tokens = batch.column(1)
            if batch.num_rows:
                offsets = tokens.offsets.to_numpy().astype(np.int64)
                packer.add(band_keys(tokens.flatten().to_numpy(), offsets[:-1] - offsets[0], 1), batch.column(0).to_numpy())
            yield from packer.blocks(FLUSH)
        yield from packer.blocks()
    return sets.select("sig", "tokens").mapInArrow(run, "part bigint, keys binary, sigs binary")


def _collisions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b), a < b, with bucket -1: of every bucket's entries each with the first and with the one before.  That
    is all pairs of up to three entries; larger buckets leave as (bucket, entry) as well."""
    k = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
    s = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sigs"]])
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    k, s = k[fresh], s[fresh]
    head = np.r_[True, k[1:] != k[:-1]]
    first = s[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    later = np.flatnonzero(~head)
    pairs = np.unique(np.concatenate([np.stack([first[later], s[later]], 1), np.stack([s[later - 1], s[later]], 1)]), axis=0)
    starts = np.flatnonzero(head)
    sizes = np.diff(np.r_[starts, len(k)])
    large = np.repeat(sizes > 3, sizes)
    bucket = (np.int64(pdf["part"].iloc[0]) << np.int64(32)) | k[large].astype(np.int64)
    return pd.DataFrame({"bucket": np.r_[np.full(len(pairs), -1, np.int64), bucket], "a": np.r_[pairs[:, 0], s[large]],
                         "b": np.r_[pairs[:, 1], s[large]]})


def _decided(sigs: np.ndarray, labels: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int]]:
    """Links that decide every pair of a block of entries whose labels differ.

    The entries that share most ask first, as they join most; then all that lie outside the largest group ask.  So of
    two entries in different groups one has asked, unless links connect them already.
    """
    sigs, at = np.unique(sigs, return_index=True)
    group, tokens = np.unique(labels[at], return_inverse=True)[1], tokens[at]
    if not group.any():
        return []
    sizes = np.array([len(x) for x in tokens])
    owner = np.repeat(np.arange(len(sigs)), sizes)
    token = np.unique(np.concatenate([np.asarray(x, np.int64) for x in tokens]), return_inverse=True)[1]
    lists, ends = owner[np.argsort(token, kind="stable")], np.r_[0, np.cumsum(np.bincount(token))]
    own = np.split(token, np.cumsum(sizes)[:-1])
    weight = np.bincount(owner, np.diff(ends)[token])
    links, anchor = [], None
    for i, q in enumerate(np.argsort(-weight, kind="stable").tolist()):
        if i == CENTRAL:
            anchor = int(np.flatnonzero(group == np.bincount(group).argmax())[0])
        if anchor is not None and group[q] == group[anchor]:
            continue
        shared = np.bincount(np.concatenate([lists[ends[t]:ends[t + 1]] for t in own[q].tolist()]), minlength=len(sigs))
        alike = shared * 100 >= (sizes + sizes[q] - shared) * THRESHOLD
        met = np.flatnonzero(alike & (group != group[q]))
        if len(met):
            joined, at = np.unique(group[met], return_index=True)
            links += [(sigs[q], sigs[j]) for j in met[at].tolist()]
            group[np.isin(group, joined)] = group[q]
            if (group == group[q]).all():
                break
    return links


def _decided_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """``_decided`` of each block (bucket, x, y) of a lot of them."""
    order = np.lexsort((pdf["y"], pdf["x"], pdf["bucket"]))
    pdf = pdf.iloc[order]
    keys = pdf[["bucket", "x", "y"]].to_numpy()
    cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(pdf)]
    sigs, labels, tokens = pdf["sig"].to_numpy(), pdf["label"].to_numpy(), pdf["tokens"].to_numpy()
    links = [x for a, b in zip(cuts[:-1], cuts[1:]) for x in _decided(sigs[a:b], labels[a:b], tokens[a:b])]
    return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])


def across_links(postings: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) of entries that share a bucket of ``postings`` (bucket, sig) but no component of ``labels``; None if
    no bucket spans two.  A bucket is cut into blocks by a salt, and each two of its blocks meet in a task's group;
    blocks are dealt into lots of bounded size on average, as most are small."""
    named = postings.join(labels, postings["sig"] == labels["node"], "left").select(
        "bucket", "sig", F.coalesce("component", "sig").alias("label"))
    named = save(named.join(sets.select("sig", F.size("tokens").alias("n")), "sig"), "paragraph-buckets")
    split = named.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("n"), F.ceil(F.sum("n") / BLOCK).alias("blocks"),
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("sig")).alias("print")).where("low <> high")
    # buckets of the same entries are searched once
    split = save(split.groupBy("size", "print", "low", "high").agg(
        F.min("bucket").alias("bucket"), F.max("blocks").alias("blocks"), F.max("n").alias("n")).select("bucket", "blocks", "n"), "paragraph-split")
    sizes = split.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    if sizes is None:
        return None
    lots = max(LEAST_LOTS, -(-sizes // BLOCK))
    held = named.join(split.drop("n"), "bucket").withColumn("own", F.pmod(F.xxhash64("bucket", "sig"), "blocks"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = save(held.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sig", "label"),
                "paragraph-blocks")
    lot = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(lots)).alias("lot")
    found = sets.join(sent(held, 64), "sig").select(lot, "bucket", "x", "y", "sig", "label", "tokens").groupBy("lot").applyInPandas(
        _decided_blocks, "a bigint, b bigint")
    return save(found.distinct(), "paragraph-across")


def _token_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sig, tokens) of the entries of ``chosen`` (sig, doc_id); tokens: distinct shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            for begin, texts in in_chunks(batch.column(0)):
                words = Words(texts)
                shingles = words.shingles()
                lines, (at, unit) = Lines(words, shingles), all_units(words, shingles)
                sigs, first = np.r_[lines.sig, unit], np.r_[lines.first, at]
                n = np.r_[lines.count - SHINGLE + 1, np.full(len(at), UNIT_SHINGLES)]
                wanted = asked.slice(begin, len(texts)).flatten().to_numpy()
                own = np.flatnonzero(np.isin(sigs, wanted))
                own = own[np.unique(sigs[own], return_index=True)[1]]
                sets = [np.unique(shingles[a:a + k]) for a, k in zip(first[own].tolist(), n[own].tolist())]
                yield pa.record_batch([pa.array(sigs[own]), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "tokens"])
    per_doc = save(chosen.groupBy("doc_id").agg(F.collect_set("sig").alias("wanted")), "paragraph-wanted")
    texts = null_safe(docs.select("doc_id", "text"), sent(per_doc, 80), ["doc_id"], "inner").select("text", "wanted")
    found = save(texts.mapInArrow(run, "sig bigint, tokens array<bigint>"), "paragraph-found")
    # an entry is found twice only where a doc_id comes twice
    asked = per_doc.agg(F.sum(F.size("wanted"))).first()[0] or 0
    return found if found.count() == asked else save(found.dropDuplicates(["sig"]), "paragraph-sets")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs and units of ``docs`` (doc_id, text) that repeat: doc_id, paragraph, start, end (code points), n_words,
    cluster, n_members, keep_doc_id, keep_paragraph, and removed (false for the one that stays)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, -(-size // RANGE_BYTES))
    twice = repeated_units(docs, ranges).select(F.col("sig").alias("unit"))
    # one unit in many texts is one key of the join, whose side of all units Spark may split
    table = paragraph_table(docs)
    known = sent(twice, 16)
    table = table.join(twice.hint("shuffle_hash") if known is twice else known, table["sig"] == twice["unit"], "left").where("line is null or unit is not null")
    table = save(table.drop("unit"), "paragraphs")
    first = F.min(F.struct("doc_id", "paragraph", "start")).alias("first")
    entries = save(table.groupBy("sig").agg(F.count("*").alias("n"), F.count("line").alias("unit"), first), "paragraph-entries")
    unit_sets = _token_sets(docs, entries.where("unit > 0").select("sig", "first.doc_id"))
    postings = entries.count() * BANDS
    ranges = max(8, -(-postings // RANGE))
    packed = _line_bands(docs, ranges).union(_set_bands(unit_sets, ranges))
    met = save(packed.groupBy("part").applyInPandas(_collisions, "bucket bigint, a bigint, b bigint"), "paragraph-met")
    pairs = save(met.where("bucket = -1").select("a", "b").distinct(), "paragraph-pairs")
    asked = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    line_sets = _token_sets(docs, entries.where("unit = 0").join(asked, "sig").select("sig", "first.doc_id"))
    sets = unit_sets.union(line_sets)
    a, b = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), sets.select(
        F.col("sig").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"),
                                                  F.size(F.array_intersect("x", "y")).alias("shared"))
    links = both.where(F.col("shared") * 100 >= (F.col("m") + F.col("n") - F.col("shared")) * THRESHOLD).select("a", "b")
    labels = connected_components(links)
    more = across_links(met.where("bucket >= 0").select("bucket", F.col("a").alias("sig")), labels, sets)
    if more is not None:
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    grouped = entries.join(labels, entries["sig"] == labels["node"], "left").select(
        "sig", "n", F.coalesce("component", "sig").alias("cluster"))
    many = grouped.groupBy("cluster").agg(F.sum("n").alias("n")).where("n > 1").select("cluster")
    named = save(grouped.select("sig", "cluster").join(many, "cluster"), "paragraph-named")
    found = save(table.join(sent(named, 32), "sig").drop("sig"), "paragraph-members")
    lines = _judged(found.where("line is null").withColumn("gone", F.lit(False)))
    lines = save(lines, "paragraph-lines")
    whole = lines.select("row", F.col("paragraph").alias("line"), F.col("removed").alias("line_removed"))
    spans = _unit_members(found.where("line is not null")).join(whole, ["row", "line"], "left")
    spans = _judged(save(spans.withColumn("gone", F.coalesce("line_removed", F.lit(False))), "paragraph-units"))
    shown = ~F.col("gone") & (F.col("line_removed").isNull() | F.col("removed"))
    columns = ["doc_id", "paragraph", "start", "end", "n_words", "cluster", "n_members", "keep_doc_id", "keep_paragraph", "removed"]
    return lines.select(*columns).union(spans.where(shown).select(*columns))


def _unit_members(found: DataFrame) -> DataFrame:
    """Units of one cluster that overlap in one row, taken together."""
    own = Window.partitionBy("cluster", "row").orderBy("word")
    apart = F.coalesce(F.lag("word").over(own) + UNIT <= F.col("word"), F.lit(True)).cast("long")
    chains = found.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(own))
    return chains.groupBy("cluster", "row", "chain").agg(
        F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"),
        F.max("end").alias("end"), (F.max("word") - F.min("word") + UNIT).alias("n_words"),
        F.when(F.min("line") == F.max("line"), F.min("line")).otherwise(-1).alias("line"))


def _judged(members: DataFrame) -> DataFrame:
    """``members`` of clusters that have two, with n_members, the one that stays (of those not ``gone`` if there are
    any, the first) and removed."""
    at = F.struct("doc_id", "paragraph", "start")
    clusters = members.groupBy("cluster").agg(F.count("*").alias("n_members"), F.min(F.struct("gone", at.alias("at"))).alias("keep"))
    clusters = save(clusters.where("n_members > 1"), "paragraph-clusters")
    return members.join(sent(clusters, 64), "cluster").withColumns({
        "keep_doc_id": F.col("keep.at.doc_id"), "keep_paragraph": F.col("keep.at.paragraph"),
        "removed": ~at.eqNullSafe(F.col("keep.at"))})
