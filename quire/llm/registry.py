"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: query name -> module with query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_ann_graph": "ann",
    "op2_url_filter": "urlfilter",
    "op3_html_wrapper": "htmlwrap",
    "op4_language_id": "langid",
    "op5_mixing": "mixing",
    "op6_toxicity": "toxicity",
    "op7_quality": "quality",
    "op8_neardup": "neardup",
    "op9_token_counts": "tokencount",
    "op10_decontamination": "decontam",
}


def _module(name: str):
    return importlib.import_module(f"quire.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in MODULES if getattr(_module(name), "SQL", None)}
