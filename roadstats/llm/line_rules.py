"""Quality rules: cross-document line frequency.

Lines are normalised and hashed, the distinct documents of each line are counted
per host, lines above the limits are taken out, and a document that loses most of
itself that way is rejected.  DataFrame functions only.

Defined cases: a null or blank text has no words and no lines, and fails the base
rules; a null host is a host of its own; equal rows are judged alike, each on its
own row; exact copies of a text are one document in the counts, so that copying
alone does not make a line boilerplate; other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import WHITE_PATTERN, WHITE_SPACE, save

REPEAT_WINDOW = 8


def split_words(text: Column) -> Column:
    """Runs of characters other than the six white-space ones."""
    bare = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, WHITE_PATTERN))


def shifted(values: Column, by: int) -> Column:
    """``values`` without its first ``by`` entries."""
    return F.slice(values, F.lit(by + 1), F.size(values))


def _pair(values: Column, by: int) -> Column:
    return F.zip_with(values, shifted(values, by), lambda a, b: F.xxhash64(a, b))


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from ``words``: window hashes by doubling (1, 2, 4, 8 words);
    only texts in which some hash occurs twice have their windows sorted."""
    w = REPEAT_WINDOW
    df = df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("h", _pair(F.col("h"), 1))
    df = df.withColumn("h", _pair(F.col("h"), 2))
    df = df.withColumn("h", F.slice(_pair(F.col("h"), 4), F.lit(1),
                                    F.greatest(F.col("n_words").cast("int") - (w - 1), F.lit(0))))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("at", F.when(twice, F.sort_array(F.transform(
        "h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn("at", F.sort_array(F.filter(F.transform(
        "at", lambda e, j: F.when((e["h"] == F.get("at", j - 1)["h"]) | (e["h"] == F.get("at", j + 1)["h"]), e["i"])),
        lambda x: x.isNotNull())))
    covered = F.aggregate(
        F.transform("at", lambda x, j: F.least(F.lit(w), F.coalesce(F.get("at", j + 1) - x, F.lit(w)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("h", "at")


def _normalised(line: Column) -> Column:
    one_space = F.regexp_replace(F.btrim(line, F.lit(WHITE_SPACE)), WHITE_PATTERN, " ")
    return F.lower(F.regexp_replace(one_space, "[0-9]+", "0"))


def base_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, text_hash, the base counts and
    ``lines``, the (hash, characters) of every normalised line that has a word."""
    df = docs.select("doc_id", F.col(host).alias("host"), "text")
    df = df.select("doc_id", "host", "text", F.xxhash64("text").alias("text_hash"), split_words(F.col("text")).alias("words"))
    df = df.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"),
                 lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != "").alias("own_lines"))
    df = _with_repeats(df)

    return df.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols",
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("own_lines", lambda x: F.struct(
            F.xxhash64(_normalised(x)).alias("hash"), F.length(_normalised(x)).alias("chars"))).alias("lines"))


def frequent_lines(base: DataFrame, min_docs: int, max_permille: int) -> DataFrame:
    """(host, hash) of the lines above the limits; ``base`` has host, text_hash and lines."""
    # (host, line, text) is distinct before it is counted: a line that a third of all
    # documents share is spread over the texts that have it
    per_text = base.select("host", "text_hash", F.explode(F.array_distinct("lines.hash")).alias("hash")).distinct()
    texts = base.where(F.size("lines") > 0).select("host", "text_hash").distinct().groupBy("host").agg(
        F.count("*").alias("n_texts"))
    counts = per_text.groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    over = counts.join(texts, counts["host"].eqNullSafe(texts["host"])).where(
        F.col("n_docs") * 1000 > F.col("n_texts") * max_permille).select(counts["host"], "hash")
    return save(over, "line-over")


def _lines_gone(base: DataFrame, over: DataFrame, salts: int) -> DataFrame:
    """The rows of ``base``'s lines, with ``row``, that are in ``over``."""
    # rows of a frequent line are dealt by a salt, the few frequent lines repeated for each
    lines = base.select("row", "host", F.inline("lines")).withColumn("salt", F.pmod("row", F.lit(salts)))
    over = over.select(F.col("host").alias("over_host"), F.col("hash").alias("over_hash"),
                       F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])).alias("over_salt"))
    return lines.join(over, (F.col("hash") == F.col("over_hash")) & (F.col("salt") == F.col("over_salt"))
                      & F.col("host").eqNullSafe(F.col("over_host")))


def without_frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = 10, max_permille: int = 5,
                           salts: int = 16) -> DataFrame:
    """(doc_id, text) of every row of ``docs``, the text without the lines that ``line_frequency`` counts as removed;
    other lines, blank ones too, stay as they are, and so does a null text."""
    raw = F.transform(F.split("text", "\n"), lambda x: F.struct(
        x.alias("line"), F.when(F.btrim(x, F.lit(WHITE_SPACE)) != "", F.xxhash64(_normalised(x))).alias("hash")))
    rows = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("text_hash"), raw.alias("raw"))
    rows = rows.withColumn("lines", F.transform(F.filter("raw", lambda x: x["hash"].isNotNull()), lambda x: F.struct(
        x["hash"].alias("hash"))))
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "line-texts")
    gone = _lines_gone(rows, frequent_lines(rows, min_docs, max_permille), salts)
    gone = gone.groupBy("row").agg(F.collect_set("hash").alias("gone"))
    left = F.filter("raw", lambda x: x["hash"].isNull() | F.col("gone").isNull() | ~F.array_contains("gone", x["hash"]))
    return rows.join(gone, "row", "left").select("doc_id", F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("text"))


def line_frequency(docs: DataFrame, host: str = "source", min_words: int = 20, max_repeat_pct: int = 30,
                   min_docs: int = 10, max_permille: int = 5, min_kept_pct: int = 50, salts: int = 16) -> DataFrame:
    """Every row of ``docs`` with its base counts and the verdict.

    A line is above the limits if more than ``min_docs`` distinct texts of its host
    have it and these are more than ``max_permille`` thousandths of that host's
    texts.  A document is depleted if the lines left hold less than
    ``min_kept_pct`` per cent of its characters in lines.  kept: it passes the base
    rules and isn't depleted.
    """
    base = save(base_measures(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-base")

    gone = _lines_gone(base, frequent_lines(base, min_docs, max_permille), salts).groupBy("row").agg(
        F.sum("chars").alias("gone"))
    chars = F.aggregate("lines.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    judged = base.join(gone, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)).alias(
            "base_failed"),
        chars.alias("line_chars"), F.coalesce("gone", F.lit(0)).cast("long").alias("removed_chars"))
    depleted = (F.col("line_chars") - F.col("removed_chars")) * 100 < F.col("line_chars") * min_kept_pct
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~depleted).alias("kept"), "line_chars", "removed_chars")

