"""Corpus pipeline: ``STAGES`` applied to ``documents`` one after the other.

Toxic documents go, one document of each near-duplicate class stays, documents
that hold a benchmark item go, personal data gets surrogates, and what is left
is encoded to token ids and decoded again as a check.  All stages but the last
return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from outcry.llm import bytebpe, decontam, omh, queries, surrogates, toxicity
from outcry.llm.runtime import materialize, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return omh.deduplicate(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced, _ = surrogates.replace(docs, count=None)
    return replaced


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bytebpe.encode(docs, queries.MULTI_RANKS, decoded=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaked),
          ("pii", replace_personal), ("byte_bpe", tokens)]
#: Automata, sketches and merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
