"""The registered corpus queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadstats.llm import ngram_join
from roadstats.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SF_SMALL)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {d: set(ngram_join.shingle_set(ngram_join.words_of(t), ngram_join.WordHashes()).tolist()) for d, t in texts.items()}
    group = {d: d for d in texts}
    ids = sorted(texts)
    for _ in range(len(ids)):
        before = dict(group)
        for a in ids:
            for b in ids:
                if a < b and group[a] != group[b] and sets[a] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in ids if group[d] == d)
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert 0 < len(out) < len(ids) and all(r["n_tokens"] >= 0 for r in out)


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_keep_columns(spark, rows):
    """Stages on an empty table and on one with nulls, and with columns named like their own temporary ones."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 200").limit(rows)
    null = docs.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000).limit(3)
    extra = docs.union(null).withColumns({c: F.lit(7) for c in ("__doc_id", "__text_hash", "__right___doc_id", "sig", "component", "row")})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, extra, SF_SMALL)
        assert kept.columns == extra.columns
        got = kept.collect()
        assert all(r["__doc_id"] == r["__text_hash"] == 7 for r in got)
        assert sum(r["text"] is None for r in got) == min(rows, 3), name
