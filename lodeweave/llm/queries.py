"""The queries of this package, and their SQL where SQL can express them."""

from lodeweave.llm import chat, divergence, fingerprints, html_text, language, licenses, mixing, ngram_join, packing, secret_scan, topk, toxicity, variants

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_block_labeller": html_text.op3_block_labeller,
    "op4_pivot_topk": topk.op4_pivot_topk,
    "op5_weighted_fingerprints": fingerprints.op5_weighted_fingerprints,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_perspectives": chat.op7_perspectives,
    "op8_jaccard_join": ngram_join.op8_jaccard_join,
    "op9_toxic_spans": toxicity.op9_toxic_spans,
    "op10_config_packing": packing.op10_config_packing,
    "op11_language_tags": language.op11_language_tags,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {"op4_pivot_topk": topk.ORACLE, "op7_perspectives": chat.ORACLE, "op8_jaccard_join": ngram_join.ORACLE, "op13_source_divergence": divergence.ORACLE}
