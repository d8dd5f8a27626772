"""The queries of this subpackage and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from panelyard.llm import (
    byte_bpe,
    conversation_repair,
    exact_dedup,
    html_extract,
    mixing,
    ngram_join,
    pii,
    prefix_trie,
    secret_scan,
    simhash_dedup,
    suffix_dedup,
    top_k,
    toxicity,
)

QUERIES = {
    "op1_top_k": top_k.op1_top_k,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_top_k": top_k.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
}
