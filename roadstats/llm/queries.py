"""The operators' queries, one ``opN_<name>`` each, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.llm import (
    bpe,
    cap_filters,
    conversations,
    line_rules,
    nbsvm,
    ngram_join,
    paragraphs,
    pii,
    secrets,
    sharding,
    url_model,
    whitening,
    winnowing,
)
from roadstats.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return register


SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, text AS raw FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 8)) AS u(p) GROUP BY rid),
l AS (SELECT rid, source, raw, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, source, raw, line, replace(trim(line, {SQL_SPACE}), '', '') AS bare FROM l
       WHERE trim(line, {SQL_SPACE}) <> ''),
ln AS (SELECT rid, source, raw, line, lower(regexp_replace(regexp_replace(bare, '[\\x20\\x09-\\x0D]+', ' ', 'g'),
              '[0-9]+', '0', 'g')) AS norm FROM lw),
texts AS (SELECT source, count(DISTINCT raw) AS n_texts FROM ln GROUP BY source),
freq AS (SELECT source, norm, count(DISTINCT raw) AS n_docs FROM ln GROUP BY source, norm),
bad AS (SELECT f.source, f.norm FROM freq f JOIN texts t ON f.source IS NOT DISTINCT FROM t.source
        WHERE n_docs > 10 AND n_docs * 1000 > n_texts * 5),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup, sum(length(ln.norm)) AS chars,
               coalesce(sum(length(ln.norm)) FILTER (WHERE bad.norm IS NOT NULL), 0) AS gone
        FROM ln LEFT JOIN bad ON ln.source IS NOT DISTINCT FROM bad.source AND ln.norm = bad.norm GROUP BY rid),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(gone, 0) AS BIGINT) AS removed_chars
      FROM d JOIN w USING (rid) LEFT JOIN per USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND NOT ((line_chars - removed_chars) * 100 < line_chars * 50) AS kept,
       line_chars, removed_chars
FROM m
"""


@query(LINE_RULES_SQL)
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_frequency(read(spark, sf_dir, "documents"))


WINNOW_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS t(i) WHERE len(words) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
       FROM d, ns, unnest(range(1, len(words) - n + 2)) AS t(i) WHERE len(words) >= n),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS u(p) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN it USING (rid)
"""


@query(WINNOW_SQL)
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


JOIN_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(words[i:i + least(len(words), 5) - 1], ' ') AS g
      FROM d, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS t(i) WHERE len(words) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""


@query(JOIN_SQL)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op2_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return nbsvm.classify(docs, nbsvm.train(docs, read(spark, sf_dir, "labels")))


@query()
def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query()
def op4_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs)).select(
        "doc_id", *[_of_kind("base", k) for k in pii.KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"))


@query()
def op6_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.withColumn("base", base).select(
        "doc_id", *[_of_kind("base", k) for k in kinds], F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"))


@query()
def op3_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.filter_urls(read(spark, sf_dir, "pages"))


@query()
def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(read(spark, sf_dir, "documents"))


@query()
def op11_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


@query()
def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


@query()
def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(read(spark, sf_dir, "embeddings"))
