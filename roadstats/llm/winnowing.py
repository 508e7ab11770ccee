"""Benchmark decontamination by winnowing.

Every text is a sequence of words; its 4-word hashes are thinned to the smallest
one of each run of 7 (so each stretch of 10 words gives exactly one fingerprint,
the same wherever the stretch occurs).  Documents and benchmark are joined on
fingerprints; in the documents that share one, each fingerprint that matches is
extended to its full 10-word window and compared word for word.  A shared span of
10 words or more can therefore not be missed.  DataFrame functions only.

Defined cases: null and wordless texts have no words and no hits; an item of fewer
than 10 words is one window of its own length (thinning with runs of one), an item
without words none; null and repeated item_ids are kept as they are, a null one is
left out of the digest but counts as a hit; equal documents are judged alike, each
on its own row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import ascii_lower, free_names, null_safe, save
from roadstats.llm.common import sent as sent_rows
from roadstats.llm.line_rules import shifted

WINDOW, GRAM = 10, 4
#: What parts words, in text in which A-Z may still stand.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes of benchmark windows that are broadcast at most; beyond, both sides shuffle.
BROADCAST_BYTES = 64_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def _fingerprints(df: DataFrame, words: str) -> DataFrame:
    """``df`` with ``fp``: for each 10-word window the smallest 4-word hash in it.

    Hashes and minima are built by doubling; entry i belongs to the window that
    starts at word i.  Words are hashed case-folded, so equal windows always have
    equal fingerprints.
    """
    pair = lambda c, by: F.zip_with(c, shifted(c, by), lambda a, b: F.xxhash64(a, b))
    low = lambda c, by: F.zip_with(c, shifted(c, by), lambda a, b: F.least(a, b))
    df = df.withColumn("fp", F.transform(words, lambda x: F.xxhash64(x)))
    for step in (pair, 1), (pair, 2), (low, 1), (low, 2), (low, 3):
        df = df.withColumn("fp", step[0](F.col("fp"), step[1]))
    return df.withColumn("fp", F.slice("fp", F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))))


def _runs(words: str, n: int, of) -> Column:
    """``of`` the (0-based) start and the words of every run of ``n`` words; none in a shorter text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.transform(F.filter(starts, lambda i: i + n <= F.size(words)), lambda i: of(i, F.slice(words, i + 1, F.lit(n))))


def _short_hash(run: Column, n: int) -> Column:
    return F.xxhash64(F.array_join(run, " "), F.lit(n))


def _short_hashes(words: str, lengths: list[int]) -> Column:
    """Hashes of every run of words as long as a short item; mostly there are none."""
    def of_length(n: int) -> Column:
        return _runs(words, n, lambda _, run: _short_hash(run, n))
    return F.concat(F.array().cast("array<bigint>"), *[of_length(n) for n in lengths])


def _windows(words: str, lengths: list[int]) -> Column:
    """(start, len, window, fp) of every window of 10 words, and of every run as long as a short item."""
    def of_length(n: int) -> Column:
        return _runs(words, n, lambda i, run: F.struct(
            i.alias("start"), F.lit(n).alias("len"), F.array_join(run, " ").alias("window"),
            _short_hash(F.transform(run, F.lower), n).alias("fp")))
    ten = F.transform("fp", lambda x, i: F.struct(
        i.alias("start"), F.lit(WINDOW).alias("len"),
        F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("window"), x.alias("fp")))
    return F.concat(ten, *[of_length(n) for n in lengths])


def _exact(df: DataFrame, carried: list[str], lengths: list[int]) -> DataFrame:
    """Windows of whole texts: exact words (A-Z lower-cased) beside fingerprints of case-folded ones."""
    df = df.select(*carried, words_of(ascii_lower(F.col("text"))).alias("words"))
    df = _fingerprints(df.withColumn("folded", F.transform("words", F.lower)), "folded")
    return df.select(*carried, F.inline(_windows("words", lengths)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text): doc_id, text_hash, n_words,
    n_hit (words inside an occurrence of an item's window), ``items`` (sorted ids, as strings) and n_items."""
    items = benchmark.select("item_id", "text").distinct().withColumn(
        "n", F.size(words_of(F.col("text")))).where("n > 0")
    # at most nine lengths below a full window
    lengths = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    long_items = _exact(items.where(F.col("n") >= WINDOW), ["item_id"], [])
    windows = long_items
    for n in lengths:
        windows = windows.union(_exact(items.where(F.col("n") == n), ["item_id"], [n]).where(F.col("len") == n))
    windows = save(windows.drop("start").distinct(), "winnow-items")
    prints = windows.select("fp").distinct().withColumn("match", F.lit(1))
    held = windows.agg(F.sum(F.octet_length("window") + F.lit(64))).first()[0] or 0
    small = held <= BROADCAST_BYTES
    sent = F.broadcast if small else (lambda df: df)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = _fingerprints(keyed.withColumn("words", F.transform(words_of(F.col("text")), F.lower)), "words")
    prints_of = F.array_distinct(F.concat("fp", _short_hashes("words", lengths)) if lengths else F.col("fp"))
    found = found.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), prints_of.alias("fp"))
    found = found.select("doc_id", "text_hash", "n_words", F.explode_outer("fp").alias("fp")).join(
        sent(prints), "fp", "left")
    per_doc = save(found.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.max("match").alias("match")), "winnow-docs")

    # extend the hits: whole windows, compared as text
    matching = save(per_doc.where("match = 1").select("doc_id", "text_hash"), "winnow-matching")
    candidates = null_safe(keyed, sent_rows(matching, 32), ["doc_id", "text_hash"], "left_semi").dropDuplicates(
        ["doc_id", "text_hash"])
    texts = windows.select("fp", "len", "window").distinct()
    hits = save(_exact(candidates, ["doc_id", "text_hash"], lengths).join(sent(texts), ["fp", "len", "window"]).select(
        "doc_id", "text_hash", "start", "len", "window"), "winnow-hits")
    spans = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"),
        F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    spans = spans.select("doc_id", "text_hash", covered.alias("n_hit"))
    matched = hits.select("doc_id", "text_hash", "window").distinct().join(
        sent(windows.select("window", "item_id").distinct()), "window").select(
        "doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct().groupBy(
        "doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"), F.count("*").alias("n_items"))

    keys = ["doc_id", "text_hash"]
    out = null_safe(null_safe(null_safe(keyed.drop("text"), per_doc.drop("match"), keys, "left"), spans, keys, "left"),
                    matched, keys, "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item's window occurs."""
    keys = free_names(docs, "__doc_id", "__text_hash")
    found = decontaminate(docs, benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias(keys[0]), F.col("text_hash").alias(keys[1])).distinct()
    keyed = docs.withColumns({keys[0]: F.col("doc_id"), keys[1]: F.xxhash64("text")})
    return null_safe(keyed, sent_rows(save(found, "winnow-contaminated"), 32), keys, "left_anti").drop(*keys)
