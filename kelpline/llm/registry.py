"""Queries of the training-data operators and the corpus pipeline."""

from __future__ import annotations

import importlib

import corpus_pipeline

_QUERIES = {
    "op1_toxicity": "toxicity",
    "op2_minhash_neardup": "neardup",
    "op3_decontaminate": "decontaminate",
    "op4_secrets": "secrets",
    "op5_fingerprints": "fingerprint",
    "op6_pii": "pii",
    "op7_best_fit_packing": "packing",
    "op8_language_id": "langid",
    "op9_licenses": "licenses",
    "op10_warc": "warc",
    "op11_periodic_runs": "periodic",
    "op12_fill_in_middle": "fim",
    "op13_url_filter": "urlfilter",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"kelpline.llm.{module}"), name) for name, module in _QUERIES.items()}
    return {**found, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from kelpline.llm import decontaminate, fim, licenses, urlfilter, warc

    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    parts = {"op3_decontaminate": decontaminate, "op9_licenses": licenses, "op10_warc": warc, "op12_fill_in_middle": fim, "op13_url_filter": urlfilter}
    return {**{name: module.oracle() for name, module in parts.items()}, **whole}
