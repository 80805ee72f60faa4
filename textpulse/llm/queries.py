"""The registered queries of this folder, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from textpulse.llm import align, exact, html, leaks, mixing, near, packing, periods, quality, rules, tokens, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        exact.op1_exact_dedup,
        tokens.op2_token_files,
        html.op3_main_text,
        warc.op4_warc,
        near.op5_near_duplicates,
        mixing.op6_mixed_sources,
        quality.op7_quality,
        packing.op8_packed_sequences,
        toxicity.op9_toxicity,
        rules.op10_quality_rules,
        periods.op11_periodic_runs,
        leaks.op12_benchmark_leaks,
        align.op13_token_alignment,
    )
}

ORACLE = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op10_quality_rules": rules.OP10_SQL,
    "op12_benchmark_leaks": leaks.OP12_SQL,
}
