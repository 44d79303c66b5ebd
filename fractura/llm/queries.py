"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import divergence, jaccard, language, pieces, search, spelling, suffix, tiles, tokens, toxicity, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_vantage_point_search": search.op3_vantage_point_search,
    "op4_multi_index_hashing": search.op4_multi_index_hashing,
    "op5_language_id": language.op5_language_id,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": tokens.op8_best_fit_packing,
    "op9_suffix_array_dedup": suffix.op9_suffix_array_dedup,
    "op10_url_filters": urls.op10_url_filters,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_embedding_near_dedup": tiles.op12_embedding_near_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL: dict[str, str] = {
    "op4_multi_index_hashing": search.OP4_SQL,
    "op10_url_filters": urls.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_embedding_near_dedup": tiles.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
