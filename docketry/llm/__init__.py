"""Operations of a large-scale training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations

from importlib import import_module

#: module, query name
OPERATORS = (
    ("gif", "op1_gif"),
    ("maxscore", "op2_maxscore"),
    ("secret_scan", "op3_secrets"),
    ("simhash", "op4_simhash"),
    ("toxicity", "op5_toxicity"),
    ("quality", "op6_quality"),
    ("packing", "op7_packing"),
    ("mixing", "op8_mixing"),
    ("warc", "op9_warc"),
    ("sharding", "op10_sharding"),
    ("prefix_trie", "op11_prefix_trie"),
    ("decontamination", "op12_decontamination"),
    ("spelling", "op13_spelling"),
)


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, for those that SQL can express."""
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE", None) for module, name in OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
