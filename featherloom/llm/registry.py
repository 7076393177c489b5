"""Queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import alignment, chat, language_model, minhash, mixing, negatives, neighbours, packing, quality, sharding, suffix_dedup, toxicity, url_filter


def queries():
    return {
        "op1_url_reputation": url_filter.op1,
        "op2_minhash_dedup": minhash.op2,
        "op3_length_buckets": packing.op3,
        "op4_chat_prefixes": chat.op4,
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_rendezvous_shards": sharding.op6,
        "op7_pivotal_mix": mixing.op7,
        "op8_lexicon_automata": toxicity.op8,
        "op9_ngram_ratio": quality.op9,
        "op10_anisotropic_search": neighbours.op10,
        "op11_recurrent_lm": language_model.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_token_alignment": alignment.op13,
    }


def oracle_sql():
    return {
        "op1_url_reputation": url_filter.op1_sql(),
        "op2_minhash_dedup": minhash.op2_sql(),
        "op4_chat_prefixes": chat.op4_sql(),
        "op5_suffix_dedup": suffix_dedup.op5_sql(),
        "op10_anisotropic_search": neighbours.op10_sql(),
        "op12_hard_negatives": negatives.op12_sql(),
    }
