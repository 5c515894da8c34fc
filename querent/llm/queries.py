"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from querent.llm import bpe_codec, collocations, exact_dedup, html_extract, language, packing, periodic_runs, quality, secret_scan, simhash, substring_dedup, suffix_dedup, topk_search

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_byte_bpe_codec": bpe_codec.op3_byte_bpe_codec,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_exact_topk_search": topk_search.op8_exact_topk_search,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_language_id": language.op13_language_id,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE_OP5,
    "op8_exact_topk_search": topk_search.ORACLE_OP8,
    "op11_phrase_collocations": collocations.ORACLE_OP11,
}
