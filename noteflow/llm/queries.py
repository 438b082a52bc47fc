"""The queries of this folder and their DuckDB SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import byte_bpe, decontamination, fingerprints, hard_negatives, language_id, license_scan, line_dedup, pii_surrogates, prefix_trie, projection_forest, simhash_dedup, substring_dedup, toxicity

ALL = {
    f.__name__: f
    for f in (
        pii_surrogates.op1_pii_surrogates,
        substring_dedup.op2_substring_dedup,
        language_id.op3_language_id,
        decontamination.op4_decontamination,
        byte_bpe.op5_byte_bpe,
        license_scan.op6_license_scan,
        fingerprints.op7_fingerprints,
        line_dedup.op8_line_dedup,
        simhash_dedup.op9_simhash_dedup,
        toxicity.op10_toxicity,
        projection_forest.op11_projection_forest,
        hard_negatives.op12_hard_negatives,
        prefix_trie.op13_prefix_trie,
    )
}
SQL = {
    "op6_license_scan": license_scan.OP6_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
