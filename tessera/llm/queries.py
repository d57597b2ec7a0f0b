"""The queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import decontaminate, html, lm, mixing, pii, quality, sharding, simhash, tokenids, topk

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_html": html.op2_html,
    "op3_quality": quality.op3_quality,
    "op4_tokens": tokenids.op4_tokens,
    "op5_lm": lm.op5_lm,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_sharding": sharding.op10_sharding,
}

SQL = {"op1_topk": topk.OP1_SQL, "op5_lm": lm.OP5_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op10_sharding": sharding.OP10_SQL}
