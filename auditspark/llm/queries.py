"""Registration of the training-data operators."""

from auditspark.llm import decontaminate, dialogue, divergence, exact, jaccard, langid, packing, pages, secrets, sharding, simhash, tokens, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_simhash": simhash.op6_simhash,
    "op7_html_extraction": pages.op7_html_extraction,
    "op8_sharding": sharding.op8_sharding,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_jaccard_join": jaccard.op12_jaccard_join,
    "op13_conversation_repair": dialogue.op13_conversation_repair,
}

ORACLES = {
    "op4_exact_dedup": exact.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
