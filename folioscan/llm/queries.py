"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import ads_search, chat_perspectives, cost_packing, fm_decontam, langid_gru, merkle_manifest, piece_table, pii_votes, prefix_trie, quality_gbdt, simhash_ring, substring_dedup, warc_normalise
from folioscan.llm.common import table


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.digest(chat_perspectives.perspectives(table(spark, sf_dir, "conversations")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normalise.digest(warc_normalise.round_trip(table(spark, sf_dir, "pages")))


def op4_langid_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_gru.identify(table(spark, sf_dir, "documents"))


def op5_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.digest(simhash_ring.near_duplicates(table(spark, sf_dir, "documents")))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cost_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontam.digest(fm_decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.digest(pii_votes.find(table(spark, sf_dir, "documents")))


def op10_ads_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads_search.search(table(spark, sf_dir, "embeddings"), ads_search.multiples())


def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.digest(piece_table.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.prove(merkle_manifest.build(table(spark, sf_dir, "documents"), merkle_manifest.lower_fifth))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_substring_dedup, op3_warc_normalise, op4_langid_gru, op5_simhash_ring, op6_cost_packing, op7_fm_decontam, op8_quality_gbdt, op9_pii_votes, op10_ads_search, op11_piece_table, op12_prefix_trie, op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_perspectives": chat_perspectives.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_merkle_manifest": merkle_manifest.ORACLE_SQL}
