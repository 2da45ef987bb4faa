"""Grid containers: files of named axes and of variables on them, read and written by ranges of bytes.

A file has, little-endian: the number of variables (64 bits); each one's name as a length (64 bits) and its bytes; then each variable in turn: how many axes it is
on and these axes' numbers among the variables (64 bits each), its type (32 bits) and its values. An axis has its own length (32 bits) before its values; a
variable on axes has as many values as their lengths multiplied, the first axis running fastest. The files have to be on a file system that the driver and all executors mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

#: The types of axes and of variables on axes by their numbers, and an undefined variable. Times are a year and the days since it began.
TIME = np.dtype([("year", "<i4"), ("", "<i4"), ("day", "<f8")])
AXIS_TYPES = {101: np.dtype("<f4"), 102: np.dtype("<f8"), 103: np.dtype("<i4"), 104: np.dtype("<i8"), 105: TIME}
GRID_TYPES = {201: np.dtype("<f4"), 202: np.dtype("<f8"), 203: np.dtype("<i4"), 211: np.dtype("<f4"), 212: np.dtype("<f8"), 213: np.dtype("<i4")}
UNDEFINED = 0

SQL = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "long"}


@dataclass(frozen=True)
class Variable:
    name: str
    axes: tuple[int, ...]
    kind: np.dtype | None
    sizes: tuple[int, ...]
    offset: int

    @property
    def n(self) -> int:
        return int(np.prod(self.sizes, dtype=np.int64))

    @property
    def schema(self) -> str:
        values = "year int, day double" if self.kind == TIME else f"v {SQL[self.kind.str]}"
        return ", ".join(f"i{k} long" for k in range(len(self.sizes))) + ", " + values


def header(path: str) -> dict[str, Variable]:
    """The variables of a file with their places; only what lies between the values is read."""
    out: list[Variable] = []
    with open(path, "rb") as f:
        number = lambda form="<q": struct.unpack(form, f.read(struct.calcsize(form)))[0]
        names = [f.read(number()).decode() for _ in range(number())]
        for name in names:
            axes = tuple(number() for _ in range(number()))
            code = number("<i")
            if axes:
                kind, sizes = GRID_TYPES[code], tuple(out[a].n for a in axes)
            elif code == UNDEFINED:
                out.append(Variable(name, (), None, (0,), f.tell()))
                continue
            elif code in AXIS_TYPES:
                kind, sizes = AXIS_TYPES[code], (number("<i"),)
            else:
                raise ValueError(f"variable {name} has the type {code}, which has no reader")
            out.append(Variable(name, axes, kind, sizes, f.tell()))
            f.seek(out[-1].n * kind.itemsize, os.SEEK_CUR)
    return {v.name: v for v in out}


def mounted(folder: str) -> str:
    """The path of a folder of the local or a mounted file system; an error for any other."""
    scheme, _, rest = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"containers need a mounted file system, not {folder}")
    return "/" + rest.lstrip("/")


@dataclass
class Page(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], header(options["path"])[options["variable"]]
        self.page, self.low, self.high = int(options.get("page", 50_000_000)), 0, self.variable.sizes[-1]

    def pushFilters(self, filters):  # noqa: N802
        """Keeps from comparisons of the slowest index which of its values can be asked for; Spark still applies them."""
        slow = (f"i{len(self.variable.sizes) - 1}",)
        for f in filters:
            if getattr(f, "attribute", None) == slow and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high = min(self.high, f.value + 1 - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Page]:
        """Whole steps of the slowest axis, as many as fit in a page; parts of a step where one is larger than a page."""
        v = self.variable
        step, most = v.n // max(v.sizes[-1], 1), max(1, self.page // v.kind.itemsize)
        each = most // step * step if step and step <= most else most
        first, last = self.low * step, max(self.low, self.high) * step
        return [Page(a, min(a + each, last)) for a in range(first, last, each)] or [Page(0, 0)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        v = self.variable
        names = [x.split()[0] for x in v.schema.split(", ")]
        for at in range(page.first, page.last, 1_000_000):
            n = min(1_000_000, page.last - at)
            values = np.fromfile(self.path, dtype=v.kind, count=n, offset=v.offset + at * v.kind.itemsize)
            place = np.unravel_index(np.arange(at, at + n), v.sizes, order="F")
            columns = [*place, *((values["year"], values["day"]) if v.kind == TIME else (values,))]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


class GridContainer(DataSource):
    """format("grid_container"), with options path, variable and page (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "grid_container"

    def schema(self) -> str:
        return header(self.options["path"])[self.options["variable"]].schema

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_variable(spark: SparkSession, path: str, variable: str, page: int = 50_000_000) -> DataFrame:
    """(i0, i1, ..., v): a variable's or an axis' values by their indices; a time axis has year and day.

    Only the variable's bytes are read, in pages of at most `page` bytes (whole steps of its last axis where they fit); of the steps that a filter on the
    last index leaves out, none."""
    ship(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridContainer)
    return spark.read.format("grid_container").options(path=path, variable=variable, page=str(page)).load()


def write_container(spark: SparkSession, path: str, axes: dict[str, list[float]], variables: dict[str, tuple[list[str], DataFrame]], page: int = 1_000_000) -> None:
    """Writes axes (doubles, or ints as 64-bit ones) and variables on them, each (names of its axes, frame i0, i1, ..., v) with float, double or int values.

    The driver writes what lies between the values and makes the file as long as it will be; tasks write the values to their places, a page of `page`
    values each, so a task that is run again writes the same bytes. Values without a row are 0. The path is overwritten.
    """
    ship(spark)
    names = [*axes, *variables]
    codes, places = {"float": 201, "double": 202, "int": 203}, {}
    with open(path, "wb") as f:
        f.write(struct.pack("<q", len(names)))
        for name in names:
            f.write(struct.pack("<q", len(name.encode())) + name.encode())
        for values in axes.values():
            whole = all(isinstance(x, int) for x in values)
            f.write(struct.pack("<qii", 0, 104 if whole else 102, len(values)) + np.array(values, dtype="<i8" if whole else "<f8").tobytes())
        for name, (on, df) in variables.items():
            kind = df.schema["v"].dataType.simpleString()
            f.write(struct.pack(f"<{len(on) + 1}qi", len(on), *(names.index(a) for a in on), codes[kind]))
            sizes = [len(axes[a]) for a in on]
            places[name] = f.tell(), sizes, GRID_TYPES[codes[kind]]
            f.truncate(f.tell() + int(np.prod(sizes, dtype=np.int64)) * places[name][2].itemsize)
            f.seek(0, os.SEEK_END)
    for name, (_, df) in variables.items():
        offset, sizes, kind = places[name]
        flat, stride = F.lit(0).cast("long"), 1
        for k, n in enumerate(sizes):
            flat, stride = flat + F.col(f"i{k}") * stride, stride * n
        pages = df.select(flat.alias("_at"), "v").withColumn("_page", F.floor(F.col("_at") / page))
        pages.groupBy("_page").applyInPandas(_putter(path, page, offset, kind, stride), "n long").agg(F.sum("n")).collect()


def _putter(path: str, page: int, offset: int, kind: np.dtype, total: int):
    def put(some: pd.DataFrame) -> pd.DataFrame:
        first = int(some["_page"].iloc[0]) * page
        values = np.zeros(min(page, total - first), dtype=kind)
        values[some["_at"].to_numpy() - first] = some["v"].to_numpy()
        with open(path, "r+b") as f:
            f.seek(offset + first * kind.itemsize)
            f.write(values.tobytes())
        return pd.DataFrame({"n": [len(some)]})

    return put
