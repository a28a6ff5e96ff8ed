"""The operators' queries over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontaminate, divergence, embednear, langid, licenses, linefreq, packing, quality, simhash, surrogates, tokenfiles, urlgraph

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_ftrl": quality.op2_quality_ftrl,
    "op3_line_frequency": linefreq.op3_line_frequency,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_simhash_bk_tree": simhash.op5_simhash_bk_tree,
    "op6_link_graph": urlgraph.op6_link_graph,
    "op7_language_compression": langid.op7_language_compression,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_token_id_files": tokenfiles.op9_token_id_files,
    "op10_license_rules": licenses.op10_license_rules,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_embedding_caps": embednear.op12_embedding_caps,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op3_line_frequency": linefreq.OP3_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_embedding_caps": embednear.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
