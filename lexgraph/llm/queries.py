"""Named queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from lexgraph.llm import (decontaminate, filter_audit, html_text, line_dedup, near_dedup, ngram_lm, one_bit_search, packing, preferences,
                          ranked_search, suffix_dedup, toxicity, trie_counts)

QUERIES = {
    "op1_html_text": html_text.query,
    "op2_one_bit_search": one_bit_search.query,
    "op3_packing": packing.query,
    "op4_near_dedup": near_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_ngram_lm": ngram_lm.query,
    "op7_preferences": preferences.query,
    "op8_decontaminate": decontaminate.query,
    "op9_toxicity": toxicity.query,
    "op10_trie_counts": trie_counts.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_ranked_search": ranked_search.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLES = {
    "op5_line_dedup": line_dedup.SQL,
    "op7_preferences": preferences.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
