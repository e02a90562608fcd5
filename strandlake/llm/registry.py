"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strandlake.llm import dartminhash, hilbert, langid, mincut, mixing, packing, pii, quality, rollup, winnow


def queries() -> dict:
    return {
        "op1_main_text": mincut.op1_main_text,
        "op2_token_rollup": rollup.op2_token_rollup,
        "op3_quality": quality.op3_quality, "op4_near_duplicates": dartminhash.op4_near_duplicates, "op5_nearest": hilbert.op5_nearest, "op7_mixing": mixing.op7_mixing, "op8_language": langid.op8_language, "op10_packing": packing.op10_packing, "op6_pii": pii.op6_pii, "op9_fingerprints": winnow.op9_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.OP7_SQL}
