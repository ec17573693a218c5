"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard, licences, packing, quality, repair, secrets, sharding, substrings, urls

QUERIES = {
    "op1_ngram_likelihood_ratio": quality.op1_ngram_likelihood_ratio,
    "op2_repair_token_files": repair.op2_repair_token_files,
    "op3_bayesian_jaccard_join": jaccard.op3_bayesian_jaccard_join,
    "op4_blob_ledger_secrets": secrets.op4_blob_ledger_secrets,
    "op5_fm_index_decontamination": decontaminate.op5_fm_index_decontamination,
    "op6_weighted_hash_tree": sharding.op6_weighted_hash_tree,
    "op7_boosted_url_filter": urls.op7_boosted_url_filter,
    "op8_canonical_digest_licences": licences.op8_canonical_digest_licences,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_seed_and_extend": substrings.op10_seed_and_extend,
}
SQL = {
    "op5_fm_index_decontamination": decontaminate.OP5_SQL,
    "op6_weighted_hash_tree": sharding.op6_sql(),
    "op8_canonical_digest_licences": licences.op8_sql(),
    "op10_seed_and_extend": substrings.OP10_SQL,
}
