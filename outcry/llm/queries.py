"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytebpe, chat, decontam, merkle, omh, packing, surrogates, tokencount, tokenfile, topk, toxicity, turnrepair, warc
from .runtime import prepare, table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
PACK_END_ID = 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), MULTI_RANKS)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"), MULTI_RANKS)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(table(spark, sf_dir, "documents"), WORD_BPE, END_ID)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced, _ = surrogates.replace(table(spark, sf_dir, "documents"))
    return replaced.select("doc_id", "text", "n_entities")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    said = r"\### Assistant: </turn> ok"
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, :said AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)", args={"said": said})
    return chat.digests(messages.unionByName(extra))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"), BYTE_BPE, PACK_END_ID)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.digests(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_decontaminate, op4_byte_bpe, op5_topk, op6_token_files, op7_warc,
    op8_order_minhash, op9_surrogates, op10_chat, op11_packing, op12_turn_repair, op13_merkle)}
ORACLE_SQL = {"op5_topk": topk.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op12_turn_repair": turnrepair.ORACLE_SQL,
              "op13_merkle": merkle.ORACLE_SQL}
