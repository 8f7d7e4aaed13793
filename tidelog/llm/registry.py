"""Queries of this subpackage, by the names the driver uses."""

from __future__ import annotations

from . import decontaminate, hypergeometric_shards, jaccard_join, language_id, media_mpeg, packing, pii_bilstm, quality_crf, secret_owners, toxicity_nb

QUERIES = {
    "op1_latent_decontamination": decontaminate.query,
    "op2_quality_crf": quality_crf.query,
    "op3_language_hierarchy": language_id.query,
    "op4_secret_owners": secret_owners.query,
    "op5_mpeg_audio": media_mpeg.query,
    "op6_best_fit_packing": packing.query,
    "op7_hypergeometric_shards": hypergeometric_shards.query,
    "op8_pii_bilstm_crf": pii_bilstm.query,
    "op9_toxicity_nb": toxicity_nb.query,
    "op10_ngram_jaccard": jaccard_join.query,
}
ORACLE_SQL: dict[str, str] = {"op4_secret_owners": secret_owners.ORACLE_SQL}
