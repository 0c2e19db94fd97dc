"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: Query name to module; each module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_nb_svm": "nb_svm",
    "op2_url_filter": "url_filter",
    "op3_mpegts": "mpegts",
    "op4_mixing": "mixing",
    "op5_html_extract": "html_extract",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_piece_lattice": "piece_lattice",
    "op8_ngram_join": "ngram_join",
    "op9_quality_rules": "quality_rules",
    "op10_gru": "gru",
}


def queries() -> dict:
    return {name: import_module(f"skyloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"skyloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
