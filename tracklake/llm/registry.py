"""Queries ``opN_<name>`` over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from tracklake.llm import bpe_automaton, fingerprints, language_id, line_dedup, minhash, quality_rules, retrieval_packing, suffix_arrays, suffix_trees, warc


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(_docs(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_docs(spark, sf_dir))


def op6_bpe_automaton(spark, sf_dir):
    return bpe_automaton.bpe_digests(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_arrays(spark, sf_dir):
    return suffix_arrays.substring_digests(_docs(spark, sf_dir))


def op4_language_id(spark, sf_dir):
    return language_id.language_id(_docs(spark, sf_dir))


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_docs(spark, sf_dir))


def op7_warc(spark, sf_dir):
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_trees(spark, sf_dir):
    return suffix_trees.passage_digests(_docs(spark, sf_dir))


def op9_retrieval_packing(spark, sf_dir):
    return retrieval_packing.packed(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(_docs(spark, sf_dir), shingle=4)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_suffix_arrays, op4_language_id, op5_fingerprints, op6_bpe_automaton, op7_warc, op8_suffix_trees, op9_retrieval_packing, op10_minhash)}
ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op2_quality_rules": quality_rules.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL}
