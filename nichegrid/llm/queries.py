"""The queries of the text operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nichegrid.llm import (
    collocations,
    conversations,
    decontaminate,
    jaccard_join,
    line_dedup,
    lm,
    near_dedup,
    pieces,
    quality_model,
    quality_rules,
    repeats,
    sharding,
    toxicity,
)
from nichegrid.llm.oracles import ORACLES
from nichegrid.llm.tables import table

#: a public vocabulary of the machine that plans the query; never part of this repository
PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(documents)


@_query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


@_query
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.judge(table(spark, folder, "documents"))


@_query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.judge(table(spark, folder, "documents"))


@_query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.judge(table(spark, folder, "documents"))


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), pieces.load(PIECES_PATH))


@_query
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.judge(table(spark, folder, "documents"))


@_query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.judge(table(spark, folder, "conversations"))


@_query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.ranked(table(spark, folder, "documents"))


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
