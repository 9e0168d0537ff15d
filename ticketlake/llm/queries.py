"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from ticketlake.llm import (bagminhash, decontamination, fill_in_middle, licenses, line_templates, pair_alignment, pii,
                            quality_knn, quality_rules, secret_scan, sentencepiece_bpe, site_style, token_counts)

QUERIES = {
    "op1_sentencepiece": sentencepiece_bpe.op1,
    "op2_licenses": licenses.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_pii": pii.op5,
    "op6_quality_knn": quality_knn.op6,
    "op7_main_text": site_style.op7,
    "op8_decontamination": decontamination.op8,
    "op9_bagminhash": bagminhash.op9,
    "op10_line_templates": line_templates.op10,
    "op11_pair_alignment": pair_alignment.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_token_counts": token_counts.op13,
}

# The others can't be said in SQL as a whole (vocabulary merges, automata,
# trained ensembles, DOMs, hashing schemes): tests/llm has the brute-force checks.
ORACLE_SQL: dict[str, str] = {"op12_fill_in_middle": fill_in_middle.SQL}
