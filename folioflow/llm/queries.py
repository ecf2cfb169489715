"""The queries of this package and their SQL, for the driver's registry."""

from __future__ import annotations

from folioflow.llm import alignment, divergence, exact_dedup, language_id, mixing, near_dup, ngram_lm, packing, quality, substring_dedup, toxicity, warc_audit, wav_fingerprint

QUERIES = {
    "op1_ngram_jaccard_join": near_dup.query,
    "op2_warc_merkle_audit": warc_audit.query,
    "op3_wav_fingerprint": wav_fingerprint.query,
    "op4_suffix_array_dedup": substring_dedup.query,
    "op5_byte_gru_language": language_id.query,
    "op6_random_indexing_quality": quality.query,
    "op7_sum_of_squares_packing": packing.query,
    "op8_toxicity_chain": toxicity.query,
    "op9_source_mix": mixing.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_elias_fano_lm": ngram_lm.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_source_divergence": divergence.query,
}

ORACLE_SQL = {
    "op2_warc_merkle_audit": warc_audit.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
