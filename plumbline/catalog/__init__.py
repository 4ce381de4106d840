"""Registered queries: each name maps to a Spark builder and its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = [
    "scores",
    "calibration",
    "ranking",
    "manifests",
    "duplicates",
    "splits",
    "grids",
    "pixels",
    "fits",
    "intervals",
    "streams",
]


def all_entries() -> dict[str, tuple[Query, str | None]]:
    entries: dict[str, tuple[Query, str | None]] = {}
    for family in FAMILIES:
        for name, entry in import_module(f"{__name__}.{family}").ENTRIES.items():
            if name in entries:
                raise ValueError(f"query {name} is registered twice")
            entries[name] = entry
    return entries
