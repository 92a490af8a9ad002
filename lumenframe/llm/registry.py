"""Queries and SQL of the corpus operators, as __spark_entry__ lists them."""

from __future__ import annotations

from . import decontamination, jaccard_join, mixing, periodic_runs, pii, prefix_trie, quality_classifier, quality_rules, quotes, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_pii_surrogates": pii.op8_pii_surrogates,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quote_links": quotes.op10_quote_links,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

#: Where SQL can state the result; the rest are tested against brute force.
ORACLE_SQL = {
    "op1_decontaminate": decontamination.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_ngram_jaccard": jaccard_join.OP7_SQL,
    "op11_periodic_runs": periodic_runs.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
