"""Condition registries: YAML or JSON files with a ``conditions`` list."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.pixels import CONDITIONS, Condition, load_conditions

REGISTRY = "path string, position int, name string, degradation_type string, severity int, parameters map<string,double>, lists map<string,array<double>>"


def _parsed(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # only YAML files need it

        return yaml.safe_load(text) or {}


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, text in zip(batch["path"], batch["value"]):
            rows = []
            for position, row in enumerate(_parsed(text).get("conditions") or []):
                values = row.get("parameters") or {}
                plain = {k: float(v) for k, v in values.items() if not isinstance(v, (list, tuple))}
                lists = {k: [float(x) for x in v] for k, v in values.items() if isinstance(v, (list, tuple))}
                rows.append((path, position, str(row["name"]), str(row["degradation_type"]), int(row["severity"]), plain, lists))
            yield pd.DataFrame(rows, columns=["path", "position", "name", "degradation_type", "severity", "parameters", "lists"])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per condition of the registry files under ``path``, read by Spark, so from any store it reaches."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(_rows, REGISTRY)


def read_conditions(spark: SparkSession, path: str, expected: int = len(CONDITIONS)) -> tuple[Condition, ...]:
    """The checked conditions of a registry: ``expected`` unique names, one clean row of severity 0.

    No more than one row beyond ``expected`` comes to the driver.
    """
    listed = read_registry(spark, path).orderBy("path", "position").limit(expected + 1).collect()
    rows = []
    for r in listed:
        whole = {k: int(v) if k == "kernel_size" else v for k, v in r["parameters"].items()}
        rows.append({"name": r["name"], "degradation_type": r["degradation_type"], "severity": r["severity"], "parameters": {**whole, **{k: tuple(v) for k, v in r["lists"].items()}}})
    return load_conditions(rows, expected)
