"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import byte_bpe, dialogue, exact_dedup, language, near_dedup, ngram_join, packing, periods, pii, quality, repeats, secrets, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_pii_surrogates": pii.op5_pii_surrogates,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_dialogue_repair": dialogue.op11_dialogue_repair,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL}
