"""Queries of this subpackage and their DuckDB SQL, for the registry."""

from __future__ import annotations

from . import ann, centroids, decontam, fim, langid, license_scan, line_dedup, ngram_join, packing, pii, topk_search, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_pii": pii.op3_pii,
    "op4_language_id": langid.op4_language_id,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLES = {
    "op9_decontamination": decontam.ORACLE,
    "op11_topk_search": topk_search.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_centroid_clustering": centroids.ORACLE,
}
