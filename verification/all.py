"""Imports every family, which registers its queries."""

import importlib

FAMILIES = ("dedupe", "retention", "scalars", "gaps", "genres", "localize", "playback", "inventory", "match",
            "streams", "documents")
for family in FAMILIES:
    importlib.import_module(f"verification.{family}")

from verification.registry import oracle_sql, queries  # noqa: E402,F401
