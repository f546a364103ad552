"""The training-data queries and, where SQL can express them, their DuckDB equivalents."""

from inkwell.llm import ann, bpe, flac, licenses, lm, mixing, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_flac_media": flac.op4_flac_media,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_nearest": ann.op9_nearest,
    "op10_mix_sources": mixing.op10_mix_sources,
}
ORACLES = {
    "op5_secret_scan": secrets.ORACLE,
    "op8_license_scan": licenses.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
}
