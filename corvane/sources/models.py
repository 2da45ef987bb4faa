"""Trained models in a folder: their tables as Parquet, and what else they are as one row of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(folder: str, kind: str, tables: dict[str, DataFrame], settings: dict | None = None, mode: str = "error") -> None:
    """Writes a model: each of its tables under its name, and its kind and settings (anything that JSON can say)."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")
    note = json.dumps({"kind": kind, "tables": sorted(tables), "settings": settings or {}})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/_model")


def load(spark: SparkSession, folder: str, kind: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and settings of a model; an error if it is not of the kind that is asked for."""
    note = json.loads(spark.read.text(f"{folder}/_model").first()[0])
    if kind is not None and note["kind"] != kind:
        raise ValueError(f"{folder} has a model of kind {note['kind']}, not {kind}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in note["tables"]}, note["settings"]
