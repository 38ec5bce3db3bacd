"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, ballkmeans, decontam, html_text, jaccard, jpeg, line_dedup, mixing, pii, quality, quality_rules, secrets, toxicity

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality": quality.op8_quality,
    "op9_media_columns": jpeg.op9_media_columns,
    "op10_pii_redaction": pii.op10_pii_redaction,
    "op11_ball_kmeans": ballkmeans.op11_ball_kmeans,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {
    "op1_benchmark_decontamination": decontam.OP1_SQL,
    "op2_source_mixing": mixing.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_ngram_jaccard": jaccard.OP5_SQL,
    "op11_ball_kmeans": ballkmeans.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
}
