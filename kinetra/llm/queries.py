"""Registered queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact_dedup, html_extract, license_scan, near_dedup, periodic_runs, pii, quality, secrets, sentence_pieces, sharding, toxicity, whitening

QUERIES = {
    "op1_html_extraction": html_extract.op1,
    "op2_sentence_pieces": sentence_pieces.op2,
    "op3_minhash_near_dedup": near_dedup.op3,
    "op4_secret_scan": secrets.op4,
    "op5_sharding": sharding.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_quality_classifier": quality.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_license_scan": license_scan.op9,
    "op10_pii": pii.op10,
    "op11_embedding_whitening": whitening.op11,
    "op12_toxicity": toxicity.op12,
    "op13_periodic_runs": periodic_runs.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op3_minhash_near_dedup": near_dedup.OP3_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op8_decontamination": decontaminate.OP8_SQL}
