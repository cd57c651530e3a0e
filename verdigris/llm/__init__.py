"""Operators for preparing training data at scale.  Nothing else in the library imports this subpackage."""

from . import byte_bpe, centroids, jaccard_join, license_scan, line_dedup, mixing, neighbours, packing, prefix_trie, quality_rules, substring_dedup, subword, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_classifier": subword.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_centroids": centroids.op12_centroids,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_quality_rules": quality_rules.oracle(),
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_centroids": centroids.oracle(),
}
