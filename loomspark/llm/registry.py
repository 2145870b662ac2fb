"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from . import bpe, covertrees, divergence, images, licenses, neighbours, packing, sharding, simhash, suffixes, tokenfiles, toxicity, tries

QUERIES = {
    "op1_token_files": tokenfiles.query,
    "op2_license_scan": licenses.query,
    "op3_toxicity_crf": toxicity.query,
    "op4_stratified_shards": sharding.query,
    "op5_simhash_golay": simhash.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_collision_counting": neighbours.query,
    "op8_mixture_packing": packing.query,
    "op9_image_copies": images.query,
    "op10_byte_bpe": bpe.query,
    "op11_prefix_trie": tries.query,
    "op12_source_divergence": divergence.query,
    "op13_dual_tree_topk": covertrees.query,
}
#: SQL can tell these; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op2_license_scan": licenses.ORACLE, "op7_collision_counting": neighbours.ORACLE, "op11_prefix_trie": tries.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_dual_tree_topk": covertrees.ORACLE}
