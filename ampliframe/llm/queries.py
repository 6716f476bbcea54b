"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, line_dedup, lm, minhash, mixing, quality, seekable, sharding, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_deletion_neighbourhood": line_dedup.op1_deletion_neighbourhood,
        "op2_seekable_ids": seekable.op2_seekable_ids,
        "op3_url_trees": url_filter.op3_url_trees,
        "op4_hilbert_sharding": sharding.op4_hilbert_sharding,
        "op5_bottom_k": minhash.op5_bottom_k,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_string_tiling": decontam.op7_string_tiling,
        "op8_hashed_maxent": lm.op8_hashed_maxent,
        "op9_toxic_segments": toxicity.op9_toxic_segments,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_deletion_neighbourhood": line_dedup.OP1_SQL,
        "op5_bottom_k": minhash.OP5_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
    }
