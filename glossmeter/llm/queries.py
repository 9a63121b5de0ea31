"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import ann_search, bpe_tree, fill_middle, html_extract, language_id, lexical_search, line_dedup, mixing, ngram_join, quality_rules, suffix_dedup, token_count, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": language_id.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_ann_search": ann_search.op8_ann_search,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_bpe_tree": bpe_tree.op10_bpe_tree,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
