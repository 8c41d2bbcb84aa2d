"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import binary_records, decontam, importance, infill, licenses, mixing, neardup, oracle, pii, quality, sharding, substrings, toxicity, urls


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_lsh_forest": neardup.op2,
        "op3_fm_index_repeats": substrings.op3,
        "op4_rendezvous_shards": sharding.op4,
        "op5_license_classifier": licenses.op5,
        "op6_crf_personal_data": pii.op6,
        "op7_suffix_automaton": decontam.op7,
        "op8_risk_controlled_rules": quality.op8,
        "op9_deobfuscated_toxicity": toxicity.op9,
        "op10_binary_records": binary_records.op10,
        "op11_bloom_cascade": urls.op11,
        "op12_fill_in_middle": infill.op12,
        "op13_importance_resampling": importance.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": oracle.OP1, "op2_lsh_forest": oracle.OP2, "op3_fm_index_repeats": oracle.OP3, "op7_suffix_automaton": oracle.OP7, "op11_bloom_cascade": oracle.OP11,
        "op12_fill_in_middle": oracle.OP12,
    }
