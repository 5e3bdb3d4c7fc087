"""The registered queries of this subpackage: name -> (builder, SQL or None)."""

from __future__ import annotations

from . import alignment, decontamination, jaccard_join, mixing, packing, passages, quality_rules, quality_votes, repeat_index, sharding, token_counts, toxicity, whitening

QUERIES = {
    "op1_mix_sources": (mixing.op1_mix_sources, None),
    "op2_token_counts": (token_counts.op2_token_counts, None),
    "op3_passages": (passages.op3_passages, None),
    "op4_pack": (packing.op4_pack, None),
    "op5_jaccard_join": (jaccard_join.op5_jaccard_join, None),
    "op6_quality_rules": (quality_rules.op6_quality_rules, None),
    "op7_shard": (sharding.op7_shard, None),
    "op8_decontaminate": (decontamination.op8_decontaminate, None),
    "op9_remove_repeats": (repeat_index.op9_remove_repeats, None),
    "op10_toxicity": (toxicity.op10_toxicity, None),
    "op11_whiten": (whitening.op11_whiten, None),
    "op12_align_tokens": (alignment.op12_align_tokens, None),
    "op13_quality_votes": (quality_votes.op13_quality_votes, None),
}
