"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (
    decontaminate,
    html_layout,
    language_crf,
    near_dedup,
    packing,
    phrases,
    quality,
    ranked_search,
    secrets,
    substring_dedup,
    token_counts,
    url_templates,
    warc,
)

QUERIES = {
    "op1_warc": warc.op1,
    "op2_packing": packing.op2,
    "op3_url_templates": url_templates.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_token_counts": token_counts.op5,
    "op6_html_layout": html_layout.op6,
    "op7_decontamination": decontaminate.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_quality_rules": quality.op9,
    "op10_secret_scans": secrets.op10,
    "op11_language_crf": language_crf.op11,
    "op12_phrases": phrases.op12,
    "op13_ranked_search": ranked_search.op13,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
