"""The registered queries of this subpackage and the DuckDB SQL for their rows."""

from __future__ import annotations

from ddlscope.llm import (
    alignment, centroids, fingerprints, html_extract, licenses, line_dedup, minhash, nearest, packing, sentencepieces, suffix_dedup, token_files, toxicity,
)

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_block_nearest": nearest.op3_block_nearest,
    "op4_shared_prefix_pieces": sentencepieces.op4_shared_prefix_pieces,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_wavelet_tokens": token_files.op6_wavelet_tokens,
    "op7_weighted_fingerprints": fingerprints.op7_weighted_fingerprints,
    "op8_counterfactual_toxicity": toxicity.op8_counterfactual_toxicity,
    "op9_minhash_dedup": minhash.op9_minhash_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_license_scan": licenses.op13_license_scan,
}

#: Only where SQL can express the operator; tests/llm holds the others against brute force.
ORACLE_SQL = {
    "op3_block_nearest": nearest.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op12_centroid_clusters": centroids.ORACLE_SQL,
    "op13_license_scan": licenses.ORACLE_SQL,
}
