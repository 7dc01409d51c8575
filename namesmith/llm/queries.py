"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, conversation_repair, license_scan, preference_format, scaled_sketch, toxic_grammar,
)
from .benchmark_leaks import find_leaks
from .block_labeller import extract_text
from .chunk_bpe import token_digest
from .histogram_shards import histogram_shards
from .hyperminhash import near_duplicates
from .pruned_graph import nearest
from .suffix_dedup import repeat_digest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_license_scan", license_scan.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query("op3_preference_format", preference_format.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.preferences_of(table(spark, sf_dir, "conversations"))


@query("op8_histogram_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


@query("op7_hyperminhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), n=2, num=80, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"), texts=True)


@query("op9_toxic_grammar")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = toxic_grammar.learn(docs, table(spark, sf_dir, "labels"))
    return toxic_grammar.score_documents(docs, learned)


@query("op10_chunk_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_benchmark_leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_pruned_graph")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_block_labeller")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op11_collocations", collocations.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_scaled_sketch", scaled_sketch.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair", conversation_repair.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))
