"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from linestrata.llm import chatformat, decontaminate, linededup, lmscore, packing, quality, sharding, simhash, suffixdedup, tokencount

QUERIES = {
    "op1_winnowed_line_dedup": linededup.op1_winnowed_line_dedup,
    "op2_simhash_bktree": simhash.op2_simhash_bktree,
    "op3_compression_bands": quality.op3_compression_bands,
    "op4_rendezvous_sharding": sharding.op4_rendezvous_sharding,
    "op5_offset_masks": chatformat.op5_offset_masks,
    "op6_masked_pseudo_likelihood": lmscore.op6_masked_pseudo_likelihood,
    "op7_vector_best_fit": packing.op7_vector_best_fit,
    "op8_heap_merge_counts": tokencount.op8_heap_merge_counts,
    "op9_suffix_array_dedup": suffixdedup.op9_suffix_array_dedup,
    "op10_suffix_automaton": decontaminate.op10_suffix_automaton,
}

ORACLES = {
    "op1_winnowed_line_dedup": linededup.ORACLE,
    "op4_rendezvous_sharding": sharding.ORACLE,
    "op10_suffix_automaton": decontaminate.ORACLE,
}
