"""Queries and comparison SQL of this subpackage, for the entry module."""

from __future__ import annotations

from panelmark.llm.filter_audit import OP12_SQL, op12_filter_audit
from panelmark.llm.language_model import op9_language_model
from panelmark.llm.licenses import op3_license_scan
from panelmark.llm.mixing import OP1_SQL, op1_mix_sources
from panelmark.llm.near_dup import op4_near_duplicates
from panelmark.llm.packing import op8_best_fit_packing
from panelmark.llm.periodic import op11_periodic_runs
from panelmark.llm.pii import op13_personal_data
from panelmark.llm.quality import OP10_SQL, op10_quality_rules
from panelmark.llm.search import OP5_SQL, op5_exact_top_k
from panelmark.llm.substrings import OP6_SQL, op6_repeated_passages
from panelmark.llm.tokens import op2_token_counts
from panelmark.llm.warc import OP7_SQL, op7_warc_round_trip

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_token_counts,
        op3_license_scan,
        op4_near_duplicates,
        op5_exact_top_k,
        op6_repeated_passages,
        op7_warc_round_trip,
        op8_best_fit_packing,
        op9_language_model,
        op10_quality_rules,
        op11_periodic_runs,
        op12_filter_audit,
        op13_personal_data,
    )
}

SQL = {"op1_mix_sources": OP1_SQL, "op5_exact_top_k": OP5_SQL, "op6_repeated_passages": OP6_SQL, "op7_warc_round_trip": OP7_SQL, "op10_quality_rules": OP10_SQL, "op12_filter_audit": OP12_SQL}
