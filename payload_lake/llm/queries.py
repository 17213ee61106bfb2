"""Registered queries of the llm operators and their DuckDB counterparts."""

from . import block_search, collocations, decontaminate, filter_audit, knn_quality, language_id, line_dedup, near_dedup, perplexity, sentencepieces, shards, suffix_dedup, url_filter

QUERIES = {
    "op1_knn_quality": knn_quality.op1_knn_quality,
    "op2_url_rules": url_filter.op2_url_rules,
    "op3_minhash_forest": near_dedup.op3_minhash_forest,
    "op4_suffix_array": suffix_dedup.op4_suffix_array,
    "op5_ngram_perplexity": perplexity.op5_ngram_perplexity,
    "op6_minimax_shards": shards.op6_minimax_shards,
    "op7_language_id": language_id.op7_language_id,
    "op8_sentencepiece": sentencepieces.op8_sentencepiece,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_bm25_decontamination": decontaminate.op10_bm25_decontamination,
    "op11_collocations": collocations.op11_collocations,
    "op12_block_top_k": block_search.op12_block_top_k,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op2_url_rules": url_filter.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_bm25_decontamination": decontaminate.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_block_top_k": block_search.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
