"""From raw documents to token ids: the corpus operators chained.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents``, whatever others there are and whatever their names.

Defined cases: a null text is of quality as an empty one is scored, is no one's duplicate, holds no benchmark or personal
data, and has no tokens; an empty table stays empty through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.llm import bpe, nbsvm, ngram_join, pii, winnowing
from roadstats.llm.common import read, save


#: Words that an encoder holds in the last stage: its workers share their executors with what the stages before left.
HELD_WORDS = 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, predicts to be of quality 1."""
    model = nbsvm.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(nbsvm.score(model, F.col("text")) >= 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are alike to 0.8 or more."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with ``benchmark``."""
    return winnowing.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind."""
    out = docs.withColumn("text", pii.masked(pii.train(docs), F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token count, and digests of its ids and of what they decode to."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), HELD_WORDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("tokens", tokens)]

#: The classifier and the network can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
