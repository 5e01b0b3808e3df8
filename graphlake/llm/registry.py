"""The subpackage's queries and their SQL, for the entry module."""

from graphlake.llm import ann, hpylm, langid, lzprint, minhash, mixing, packing, pii, substring, toxicity

QUERIES = {
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op3_lm_scoring": hpylm.op3_lm_scoring,
    "op10_pii": pii.op10_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_language_id": langid.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op8_packing": packing.op8_packing,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op5_document_fingerprints": lzprint.op5_document_fingerprints,
    "op4_substring_dedup": substring.op4_substring_dedup,
}
SQL = {
    "op2_mixing": mixing.SQL,
    "op4_substring_dedup": substring.SQL,
}
