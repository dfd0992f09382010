"""The corpus queries by name, and the SQL they must agree with."""

from __future__ import annotations

from sessionloom.llm import contamination, html, mixing, negatives, neighbours, ngram_join, oracles, phrases, pii, quality, secrets, sharding, substrings, vectors

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_candidate_boosting": pii.op2_candidate_boosting,
    "op3_randomness_battery": secrets.op3_randomness_battery,
    "op4_factorisation_machine": quality.op4_factorisation_machine,
    "op5_tag_path_ratios": html.op5_tag_path_ratios,
    "op6_feistel_shards": sharding.op6_feistel_shards,
    "op7_cover_sample_suffixes": substrings.op7_cover_sample_suffixes,
    "op8_stable_hashing": vectors.op8_stable_hashing,
    "op9_seeded_alignment": contamination.op9_seeded_alignment,
    "op10_pareto_mix": mixing.op10_pareto_mix,
    "op11_pruned_graph_search": neighbours.op11_pruned_graph_search,
    "op12_shared_list_negatives": negatives.op12_shared_list_negatives,
    "op13_best_first_phrases": phrases.op13_best_first_phrases,
}
#: The others learn, align or hash in ways SQL has no words for; tests compare them with plain versions.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op7_cover_sample_suffixes": oracles.SUBSTRINGS,
    "op8_stable_hashing": oracles.VECTORS,
    "op10_pareto_mix": oracles.MIX,
    "op12_shared_list_negatives": oracles.NEGATIVES,
    "op13_best_first_phrases": oracles.PHRASES,
}
