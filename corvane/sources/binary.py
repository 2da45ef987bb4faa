"""Headerless and lightly headed binary files: vectors, labels, ordinates, matrices and tracer fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, content); files are the unit of work, so large data should be in many."""
    return ship(spark).read.format("binaryFile").load(path).select("path", "content")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, x): a 4-byte dimension D, then rows of D 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = int(np.frombuffer(content, "<i4", 1)[0])
                x = np.frombuffer(content, "<f4", (len(content) - 4) // 4 // d * d, 4)
                n = len(x) // d
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, d), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), rows], names=["path", "id", "x"])

    return _files(spark, path).mapInArrow(run, "path string, id long, x array<float>")


def read_values(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """(path, id, v): labels (32-bit ints) or ordinates, confidences and errors (32-bit floats), numbered from 0."""
    form, arrow = {"int": ("<i4", pa.int32()), "float": ("<f4", pa.float32())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(content, form, len(content) // 4)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(v, arrow)], names=["path", "id", "v"])

    return _files(spark, path).mapInArrow(run, f"path string, id long, v {kind}")


def read_sparse(spark: SparkSession, path: str, value: str = "<f4") -> DataFrame:
    """(path, m, n, i, j, v): a header m, n, number of elements (32-bit ints), then records i, j, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, n, size = np.frombuffer(content, "<i4", 3).tolist()
                r = np.frombuffer(content, np.dtype([("i", "<i4"), ("j", "<i4"), ("v", value)]), size, 12)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * size), pa.array([m] * size, pa.int32()), pa.array([n] * size, pa.int32()), pa.array(r["i"].astype("i8")), pa.array(r["j"].astype("i8")), pa.array(r["v"].astype("f8"))],
                    names=["path", "m", "n", "i", "j", "v"],
                )

    return _files(spark, path).mapInArrow(run, "path string, m int, n int, i long, j long, v double")


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, row): a header of the number of columns, then rows of 32-bit floats."""
    return read_vectors(spark, path).select("path", F.col("id").alias("i"), F.col("x").cast("array<double>").alias("row"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(path, step, cell, q): a 4-byte number of cells, then that many floats for each step."""
    return read_vectors(spark, path).select("path", F.col("id").alias("step"), F.posexplode("x").alias("cell", "q"))


def read_big_endian_fields(spark: SparkSession, path: str, words: int) -> DataFrame:
    """(path, record, header, data): records of `words` 32-bit header integers, the first of which is the number of
    32-bit floats that follow; all big-endian, each part between its length in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, k, rows = 0, 0, []
                while at + 4 <= len(content):
                    size = int(np.frombuffer(content, ">i4", 1, at)[0])
                    header = np.frombuffer(content, ">i4", words, at + 4).astype("i4")
                    at += size + 8
                    size = int(np.frombuffer(content, ">i4", 1, at)[0])
                    data = np.frombuffer(content, ">f4", size // 4, at + 4).astype("f4")
                    at += size + 8
                    rows.append((name, k, header.tolist(), data.tolist()))
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())))], names=["path", "record", "header", "data"])

    return _files(spark, path).mapInArrow(run, "path string, record int, header array<int>, data array<float>")


def vectors_bytes(x: np.ndarray) -> bytes:
    """The content of a vector file."""
    return np.array([x.shape[1]], "<i4").tobytes() + np.ascontiguousarray(x, "<f4").tobytes()


def sparse_bytes(m: int, n: int, elements: list[tuple[int, int, float]]) -> bytes:
    return np.array([m, n, len(elements)], "<i4").tobytes() + np.array(elements, np.dtype([("i", "<i4"), ("j", "<i4"), ("v", "<f4")])).tobytes()
