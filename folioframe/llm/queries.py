"""The corpus queries by name, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from folioframe.llm import chat, covertree, lshforest, mixing, packing, phrases, runs, sharding, spotsigs, superminhash, tokenfile, tokens, toxicity

QUERIES = {
    "op1_chat_snapshots": chat.op1_chat_snapshots,
    "op2_section_tokens": tokens.op2_section_tokens,
    "op3_extendible_shards": sharding.op3_extendible_shards,
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "op5_nnls_packing": packing.op5_nnls_packing,
    "op6_pivotal_mix": mixing.op6_pivotal_mix,
    "op7_addressable_codes": tokenfile.op7_addressable_codes,
    "op8_dual_tree": covertree.op8_dual_tree,
    "op9_nnpu_toxicity": toxicity.op9_nnpu_toxicity,
    "op10_lsh_forest": lshforest.op10_lsh_forest,
    "op11_collocations": phrases.op11_collocations,
    "op12_superminhash": superminhash.op12_superminhash,
    "op13_lyndon_runs": runs.op13_lyndon_runs,
}

ORACLES = {
    "op1_chat_snapshots": chat.ORACLE,
    "op3_extendible_shards": sharding.oracle(),
    "op8_dual_tree": covertree.ORACLE,
    "op11_collocations": phrases.ORACLE,
    "op12_superminhash": superminhash.ORACLE,
}
