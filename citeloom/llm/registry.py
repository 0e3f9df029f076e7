"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import bpe, langid, licences, linededup, lm, media, minhash, mixing, neighbours, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_licences": licences.op5_licences,
    "op6_language": langid.op6_language,
    "op7_language_model": lm.op7_language_model,
    "op8_sharding": sharding.op8_sharding,
    "op9_minhash": minhash.op9_minhash,
    "op10_media": media.op10_media,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": linededup.SQL, "op4_mixing": mixing.SQL, "op5_licences": licences.SQL}
