"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import chat, decontamination, itq, langid, line_dedup, packing, secrets, set_join, toxicity, url_rules


def queries() -> dict:
    return {
        "op1_line_chunks": line_dedup.query,
        "op2_snapshot_collapse": chat.query,
        "op3_forest_secrets": secrets.query,
        "op4_compression_toxicity": toxicity.query,
        "op5_spaced_seed_decontamination": decontamination.query,
        "op6_size_aware_jaccard": set_join.query,
        "op7_bayes_language": langid.query,
        "op8_power_of_two_packing": packing.query,
        "op9_itq_near_duplicates": itq.query,
        "op10_url_association_rules": url_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_snapshot_collapse": chat.SQL}
