"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from importlib import import_module

from .oracles import SQL

#: Query name, module of its operator.
NAMES = {
    "op2_png_media_columns": "media",
    "op3_kneser_ney_scores": "lm",
    "op4_orc_token_ids": "tokens",
    "op1_skipping_jaccard_join": "jaccard",
    "op10_island_packing": "packing",
    "op5_quality_weighted_mix": "mixing",
    "op6_bloom_cascade_urls": "urls",
    "op7_line_frequency_rules": "quality",
    "op8_bloom_line_dedup": "linededup",
    "op9_stratified_interleave": "sharding",
    "op11_merkle_dag_manifest": "manifest",
    "op12_two_tier_token_counts": "tokencount",
    "op13_k2_treap_search": "treap",
}


def _query(module: str, n: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"pathloom.llm.{module}"), f"op{n}")(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module, name[2:].split("_")[0]) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in NAMES}
