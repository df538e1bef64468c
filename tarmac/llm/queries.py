"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from tarmac.llm import bpe, collocations, decontaminate, exact_dedup, hmm, jaccard_join, license_scan, pii, prefix_trie, quality, sharding, simhash_join, token_files

QUERIES = {
    "op1_license_scan": license_scan.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_bpe": bpe.op3,
    "op4_pii": pii.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_token_files": token_files.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_sharding": sharding.op8,
    "op9_hmm": hmm.op9,
    "op10_quality": quality.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_simhash_join": simhash_join.op12,
    "op13_collocations": collocations.op13,
}
SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_collocations": collocations.SQL,
}
