"""Queries and oracle SQL of the numbered operators."""

from depotspark.llm import byte_bpe, cover_tree, hmm_lm, html_extract, lexical_search, license_scan, line_dedup, mixing, ngram_join, pii, quality_rules, url_filter, vector_codes

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_hmm_lm": hmm_lm.op7_hmm_lm,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_cover_tree": cover_tree.op9_cover_tree,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op6_url_filter": url_filter.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
