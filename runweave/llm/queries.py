"""Queries of the training-data operators, by the names under which the entry point registers them."""

from __future__ import annotations

from . import contamination, fill_in_middle, filter_audit, fixity, jaccard_join, language, language_model, licenses, neighbour_graph, packing, pii, quality, sharding

QUERIES = {
    "op1_tokenizer_fertility": quality.op1_tokenizer_fertility,
    "op2_merkle_fixity": fixity.op2_merkle_fixity,
    "op3_log_frequency_bloom": language_model.op3_log_frequency_bloom,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_minhash": licenses.op5_license_minhash,
    "op6_signature_tree_join": jaccard_join.op6_signature_tree_join,
    "op7_boosted_pii": pii.op7_boosted_pii,
    "op8_simhash_decontamination": contamination.op8_simhash_decontamination,
    "op9_permutation_sharding": sharding.op9_permutation_sharding,
    "op10_language_id": language.op10_language_id,
    "op11_filter_interactions": filter_audit.op11_filter_interactions,
    "op12_wavelet_fim": fill_in_middle.op12_wavelet_fim,
    "op13_nn_descent": neighbour_graph.op13_nn_descent,
}

#: DuckDB SQL for those whose rows SQL can express.
ORACLES: dict[str, str] = {
    "op2_merkle_fixity": fixity.ORACLE,
    "op5_license_minhash": licenses.ORACLE,
    "op11_filter_interactions": filter_audit.ORACLE,
    "op12_wavelet_fim": fill_in_middle.ORACLE,
}
