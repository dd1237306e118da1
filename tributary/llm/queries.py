"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, html, jaccard, lines, quality, sentencepiece, substrings, token_files

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        sentencepiece.op2_sentencepiece,
        chat.op3_chat,
        lines.op4_line_dedup,
        substrings.op5_suffix_array,
        sentencepiece.op6_token_counts,
        jaccard.op7_ngram_jaccard,
        token_files.op8_token_files,
        decontamination.op9_decontamination,
        html.op10_html,
    )
}

SQL = {
    "op1_quality": quality.OP1_SQL,
    "op3_chat": chat.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op7_ngram_jaccard": jaccard.OP7_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
}
