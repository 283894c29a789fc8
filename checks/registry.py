"""All queries by name: (callable, SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["structure", "corpus", "retrieval", "ranking", "questions", "answers"]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"checks.{m}").Q)
    return out


def flagship(spark, sf_dir):
    return all_queries()["flagship"][0](spark, sf_dir)
