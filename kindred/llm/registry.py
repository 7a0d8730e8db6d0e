"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroid, decontaminate, langid, lmscore, mixing, neardup, quality, secretscan, suffixdup, topk, toxicity, urlfilter, variants

QUERIES = {
    "op1_lm_score": lmscore.op1_lm_score,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_suffix_dedup": suffixdup.op3_suffix_dedup,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_secret_scan": secretscan.op7_secret_scan,
    "op8_mixing": mixing.op8_mixing,
    "op9_topk_search": topk.op9_topk_search,
    "op10_language_id": langid.op10_language_id,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_centroid": centroid.op12_centroid,
    "op13_quality": quality.op13_quality,
}
ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": neardup.ORACLE_OP2,
    "op9_topk_search": topk.ORACLE_OP9,
    "op11_spelling_variants": variants.ORACLE_OP11,
    "op12_centroid": centroid.ORACLE_OP12,
    "op13_quality": quality.ORACLE_OP13,
}
