"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from panelloom.llm import bpe, chat, exact, fingerprints, licenses, mixture, prefixes, quality, repair, shards, simhash, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_dedup,
        mixture.op2_mixture,
        quality.op3_quality,
        bpe.op4_bpe,
        shards.op5_shards,
        licenses.op6_licenses,
        exact.op7_exact_dedup,
        toxicity.op8_toxicity,
        topk.op9_topk,
        chat.op10_chat_format,
        prefixes.op11_prefix_trie,
        repair.op12_conversation_repair,
        fingerprints.op13_fingerprints,
    )
}

ORACLES = {
    "op2_mixture": mixture.oracle(),
    "op7_exact_dedup": exact.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_prefix_trie": prefixes.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
}
