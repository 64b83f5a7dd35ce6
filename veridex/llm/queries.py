"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from veridex.llm import decontaminate, near_dup, packing, pii, quality_rules, repeats, token_counts, token_files, url_filter, warc_audit

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_repeats": repeats.op2_repeats,
    "op3_token_files": token_files.op3_token_files,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_warc_audit": warc_audit.op5_warc_audit,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_pii": pii.op9_pii,
    "op10_token_counts": token_counts.op10_token_counts,
}
SQL = {"op1_quality_rules": quality_rules.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL}
