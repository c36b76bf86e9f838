"""All named queries with their checking SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ["logs", "documents", "search", "graph", "entities", "rca", "metrics", "stats", "incidents", "streams", "knowledge", "files"]


def catalog() -> dict:
    """name -> (function of session and folder, SQL text or None)."""
    out = {}
    for area in AREAS:
        for name, spec in import_module(f"opsloom.plans.{area}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = spec
    return out
