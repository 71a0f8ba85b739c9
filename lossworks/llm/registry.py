"""The corpus operators' queries, by the names they are registered under, and their SQL twins where SQL has one."""

from __future__ import annotations

from lossworks.llm import media, mixing, ngram_join, packing, phrases, pieces, pii, quality_model, quality_rules, sharding, suffix_dedup, urls, whitening

QUERIES = {
    "op1_quality_gam": quality_model.op1,
    "op2_line_frequency": quality_rules.op2,
    "op3_mixing": mixing.op3,
    "op4_packing": packing.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_kd_sharding": sharding.op7,
    "op8_iso_media": media.op8,
    "op9_url_rules": urls.op9,
    "op10_pii_surrogates": pii.op10,
    "op11_phrases": phrases.op11,
    "op12_sentencepiece": pieces.op12,
    "op13_whitening": whitening.op13,
}

ORACLE_SQL = {
    "op2_line_frequency": quality_rules.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op11_phrases": phrases.OP11_SQL,
}
