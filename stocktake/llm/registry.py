"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, jaccard_join, licenses, line_dedup, merkle, mixing, pii, quotes, runs, sharding, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_chat_formatting": quotes.op10_chat_formatting,
    "op11_runs": runs.op11_runs,
    "op12_licenses": licenses.op12_licenses,
    "op13_merkle": merkle.op13_merkle,
}


def oracles() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle(),
        "op6_decontamination": decontaminate.oracle(),
        "op8_sharding": sharding.oracle(),
        "op9_line_dedup": line_dedup.oracle(),
        "op10_chat_formatting": quotes.oracle(),
        "op11_runs": runs.oracle(),
        "op13_merkle": merkle.oracle(),
    }
