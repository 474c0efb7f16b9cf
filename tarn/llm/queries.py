"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tarn.llm import decontaminate, exact_dedup, jaccard, language, line_dedup, packing, quality, sentence_dedup, url_filter, warc

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_substring_dedup": sentence_dedup.op4_substring_dedup,
    "op5_warc_fixity": warc.op5_warc_fixity,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_language_id": language.op8_language_id,
    "op9_packing": packing.op9_packing,
    "op10_url_filters": url_filter.op10_url_filters,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_substring_dedup": sentence_dedup.OP4_SQL,
    "op5_warc_fixity": warc.OP5_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
}
