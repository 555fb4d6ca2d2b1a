"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ann, chat, langid, licenses, linededup, mixing, quality, simhash, spm, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": topk.op1_topk,
        "op2_chat": chat.op2_chat,
        "op3_sentencepiece": spm.op3_sentencepiece,
        "op4_langid": langid.op4_langid,
        "op5_ann": ann.op5_ann,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality": quality.op7_quality,
        "op8_simhash": simhash.op8_simhash,
        "op9_linededup": linededup.op9_linededup,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are tested by brute force."""
    return {
        "op1_topk": topk.OP1_SQL,
        "op2_chat": chat.OP2_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op9_linededup": linededup.OP9_SQL,
        "op10_licenses": licenses.OP10_SQL,
    }
