"""The queries of this package, and SQL that says the same where SQL can."""

from __future__ import annotations

from . import additive, bpe, chaining, chunks, divergence, hilbert, jaccard, licences, mixing, repair, runs, subword, urls

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_substring_dedup": chaining.op4_substring_dedup,
    "op5_quality_classifier": additive.op5_quality_classifier,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_toxicity": subword.op7_toxicity,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_hilbert_neighbours": hilbert.op9_hilbert_neighbours,
    "op10_quality_rules": divergence.op10_quality_rules,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_sentencepiece": chunks.op12_sentencepiece,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLE_SQL = {
    "op1_url_filter": urls.OP1_SQL,
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op10_quality_rules": divergence.OP10_SQL,
}
