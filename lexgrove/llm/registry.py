"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lexgrove.llm import ann, html_wrappers, interpolated_lm, line_rules, packing, partenum, quality_model, recompression, segmentations, url_filter

QUERIES = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_line_rules": line_rules.op2_line_rules,
    "op3_html_wrappers": html_wrappers.op3_html_wrappers,
    "op4_interpolated_lm": interpolated_lm.op4_interpolated_lm,
    "op5_partenum": partenum.op5_partenum,
    "op6_gumbel_segmentations": segmentations.op6_gumbel_segmentations,
    "op7_adaptive_scan": ann.op7_adaptive_scan,
    "op8_harmonic_packing": packing.op8_harmonic_packing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_recompression": recompression.op10_recompression,
}
SQL = {"op2_line_rules": line_rules.ORACLE}
