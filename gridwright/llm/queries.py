"""The queries of this package by the names they are registered under, and their DuckDB SQL."""

from __future__ import annotations

from . import bayes_join, context_tree, fair_mix, line_frequency, line_windows, pii_votes, string_tiling, toxicity, url_terms, zip_warc

QUERIES = {
    "op1_zip_warc": zip_warc.op1_zip_warc,
    "op2_line_frequency": line_frequency.op2_line_frequency,
    "op3_pii_votes": pii_votes.op3_pii_votes,
    "op4_string_tiling": string_tiling.op4_string_tiling,
    "op5_bayes_join": bayes_join.op5_bayes_join,
    "op6_url_terms": url_terms.op6_url_terms,
    "op7_fair_mix": fair_mix.op7_fair_mix,
    "op8_line_windows": line_windows.op8_line_windows,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_context_tree": context_tree.op10_context_tree,
}

ORACLES = {
    "op1_zip_warc": zip_warc.ORACLE_SQL,
    "op2_line_frequency": line_frequency.ORACLE_SQL,
    "op6_url_terms": url_terms.ORACLE_SQL,
    "op7_fair_mix": fair_mix.ORACLE_SQL,
    "op8_line_windows": line_windows.ORACLE_SQL,
}
