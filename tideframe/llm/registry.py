"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from tideframe.llm import decontam, jaccard, licences, packing, quality, secrets, substrings, topk, toxicity, urls

QUERIES = {
    "op1_topk_search": topk.op1,
    "op2_url_filters": urls.op2,
    "op3_quality_classifier": quality.op3,
    "op4_ngram_jaccard_join": jaccard.op4,
    "op5_benchmark_decontamination": decontam.op5,
    "op6_license_scans": licences.op6,
    "op7_secret_scans": secrets.op7,
    "op8_substring_dedup": substrings.op8,
    "op9_packing": packing.op9,
    "op10_toxicity": toxicity.op10,
}
ORACLES = {"op1_topk_search": topk.ORACLE, "op4_ngram_jaccard_join": jaccard.ORACLE, "op7_secret_scans": secrets.ORACLE, "op8_substring_dedup": substrings.ORACLE}
