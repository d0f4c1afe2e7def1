"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, contamination, conversation_repair, image_copies, jaccard_join, lang_id, licenses, line_dedup, merkle, mixing, quality, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": lang_id.op1_language,
    "op2_lines": line_dedup.op2_lines,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_image_copies": image_copies.op6_image_copies,
    "op7_decontamination": contamination.op7_decontamination,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_repair": conversation_repair.op11_repair,
    "op12_mixture": mixing.op12_mixture,
    "op13_manifest": merkle.op13_manifest,
}

ORACLES: dict[str, str] = {
    "op2_lines": line_dedup.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op7_decontamination": contamination.ORACLE,
}
