"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from marlstone.llm import chat, class_lm, decontam, exact, histogram, html_text, jaccard, line_dedup, mixing, quality, repeats, runs, token_counts


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_html_text": html_text.op2_html_text,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_suffix_dedup": repeats.op4_suffix_dedup,
        "op5_class_lm": class_lm.op5_class_lm,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_exact_dedup": exact.op11_exact_dedup,
        "op12_quantile_histogram": histogram.op12_quantile_histogram,
        "op13_word_runs": runs.op13_word_runs,
    }


def oracle_sql() -> dict:
    return {"op1_chat_format": chat.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_quality_rules": quality.ORACLE, "op9_decontaminate": decontam.ORACLE, "op11_exact_dedup": exact.ORACLE}
