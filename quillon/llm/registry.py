"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op01_topk, op02_tokens, op03_mix, op04_jaccard, op05_fingerprints, op06_ring, op07_toxicity, op08_quality, op09_suffix, op10_pack

MODULES = {
    "op1_topk": op01_topk,
    "op2_tokens": op02_tokens,
    "op3_mix": op03_mix,
    "op4_jaccard": op04_jaccard,
    "op5_fingerprints": op05_fingerprints,
    "op6_ring": op06_ring,
    "op7_toxicity": op07_toxicity,
    "op8_quality": op08_quality,
    "op9_suffix": op09_suffix,
    "op10_pack": op10_pack,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
