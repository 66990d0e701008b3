"""Registered queries of the training-data operators, one opN_<name> per operator, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, embeddings, jaccard, mixing, oracles, packing, pii, quality, sharding, toxicity, training_order, trie, warc
from .common import documents, prepare

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op8_quality_rules", oracles.quality_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(documents(spark, sf_dir), carry=["doc_id"]).drop("class_distance", "common_distance")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op3_jaccard", oracles.JACCARD)
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).drop("node", "group_id")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(documents(spark, sf_dir), 40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op5_embeddings", oracles.EMBEDDINGS)
def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.join(documents(spark, sf_dir, "embeddings"))


@query("op7_warc", oracles.WARC)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op9_training_order")
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order(documents(spark, sf_dir))


@query("op12_chat", oracles.CHAT)
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(documents(spark, sf_dir, "conversations"))


@query("op11_trie", oracles.TRIE)
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(documents(spark, sf_dir, "conversations"))


@query("op13_collocations", oracles.COLLOCATIONS)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))
