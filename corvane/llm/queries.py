"""The queries of this subpackage: one a operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import approximate_search, chats, exact_search, language, mixing, near_duplicates, packing, periodic_runs, prefix_trie, quality, token_counts, url_filters, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chats.op1_chat_formatting,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_exact_top_k": exact_search.op4_exact_top_k,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_wavelet_tokens": wavelet.op8_wavelet_tokens,
    "op9_language_id": language.op9_language_id,
    "op10_approximate_neighbours": approximate_search.op10_approximate_neighbours,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_url_filters": url_filters.op13_url_filters,
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": chats.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op4_exact_top_k": exact_search.ORACLE,
    "op6_near_duplicates": near_duplicates.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_url_filters": url_filters.ORACLE,
}
