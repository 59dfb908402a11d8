"""The dealt queries and the SQL that checks them, for ``__spark_entry__``."""

from __future__ import annotations

from tagspark.llm import (
    decontam, html_text, langid, order_minhash, packing, prefix_trie, quality, simhash, suffix_dedup, token_count, token_files, toxicity, whitening,
)

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_token_count": token_count.op2_token_count,
    "op3_token_files": token_files.op3_token_files,
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_language_id": langid.op10_language_id,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE = {"op9_benchmark_decontamination": decontam.ORACLE}
