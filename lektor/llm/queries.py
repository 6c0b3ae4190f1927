"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lektor.llm import fingerprints, main_text, mixing, near_copies, neighbours, pieces, quality, repeats, token_files, toxicity

ORACLES: dict[str, str] = {"op1_mix": mixing.OP1_SQL, "op7_neighbours": neighbours.OP7_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (mixing.op1_mix, repeats.op2_repeats, toxicity.op3_toxicity, near_copies.op4_near_copies, pieces.op5_pieces, fingerprints.op6_fingerprints, neighbours.op7_neighbours, token_files.op8_token_files, main_text.op9_main_text, quality.op10_quality)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
