"""The operators' queries and their SQL."""

from __future__ import annotations

from lodestar.llm import decontaminate, interpolated_lm, langid, line_dedup, maxscore, mixing, quality, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality": quality.op4_quality,
    "op5_interpolated_lm": interpolated_lm.op5_interpolated_lm,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_maxscore": maxscore.op7_maxscore,
    "op8_langid": langid.op8_langid,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op7_maxscore": maxscore.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
