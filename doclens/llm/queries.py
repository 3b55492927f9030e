"""Queries of the training-data operators over the given tables, and their SQL where SQL can say it."""

from doclens.llm import boilerplate, chat, decontaminate, divergence, fingerprint, language, mixing, repair, sharding, simhash, suffixes, toxicity, warc

QUERIES = {
    "op1_temperature_mix": mixing.query,
    "op2_site_lines": boilerplate.query,
    "op3_positional_bytes": simhash.query,
    "op4_containment_search": decontaminate.query,
    "op5_byte_network": language.query,
    "op6_ftrl_toxicity": toxicity.query,
    "op7_paragraph_sketch": fingerprint.query,
    "op8_hilbert_shards": sharding.query,
    "op9_reply_trees": chat.query,
    "op10_deep_shallow": suffixes.query,
    "op11_dictionary_warc": warc.query,
    "op12_source_divergence": divergence.query,
    "op13_checkpoint_repair": repair.query,
}
SQL: dict[str, str] = {
    "op2_site_lines": boilerplate.SQL,
    "op4_containment_search": decontaminate.SQL,
    "op9_reply_trees": chat.SQL,
    "op11_dictionary_warc": warc.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_checkpoint_repair": repair.SQL,
}
