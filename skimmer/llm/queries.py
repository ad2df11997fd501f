"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from skimmer.llm import conversation_repair, decontaminate, language_id, license_scan, lm_score, nearest, pieces, secret_scan, sharding, simhash, token_file, toxicity, whitening

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_piece_sampling": pieces.query,
    "op3_toxicity": toxicity.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_nearest_neighbours": nearest.query,
    "op6_secret_scan": secret_scan.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_license_scan": license_scan.query,
    "op9_token_file": token_file.query,
    "op10_language_id": language_id.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_whitening": whitening.query,
    "op13_sharding": sharding.query,
}

ORACLES: dict[str, str] = {
    "op6_secret_scan": secret_scan.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
}
