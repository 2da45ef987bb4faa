"""Text formats: sparse and dense training rows, measurements, contours, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(column: str = "value"):
    return F.split(F.trim(column), r"\s+")


def read_svm(spark: SparkSession, path: str, dimensions: int | None = None, missing: float = 0.0) -> DataFrame:
    """(label, x) from lines `label i:v ...` with indices from 1; features that a line doesn't have are `missing`."""
    f = spark.read.text(path).where("trim(value) <> ''").select(_fields().alias("f"))
    pairs = F.transform(F.slice("f", 2, F.size("f")), lambda p: F.struct((F.get(F.split(p, ":"), F.lit(0)).cast("int") - 1).alias("k"), F.get(F.split(p, ":"), F.lit(1)).cast("double").alias("v")))
    rows = f.select(F.get("f", F.lit(0)).cast("double").alias("label"), F.map_from_entries(pairs).alias("m"))
    if dimensions is None:
        dimensions = (rows.agg(F.max(F.array_max(F.map_keys("m")))).first()[0] or -1) + 1
    return rows.select("label", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(float(missing)))).alias("x"))


def write_svm(df: DataFrame, path: str) -> None:
    """(label, x) as lines; zeros are left out."""
    parts = F.filter(F.transform("x", lambda v, k: F.when(v != 0, F.concat((k + 1).cast("string"), F.lit(":"), v.cast("string")))), lambda s: s.isNotNull())
    df.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(parts, " ")).alias("value")).write.text(path)


def read_lvq(spark: SparkSession, path: str, header: bool = True, labelled: bool = True) -> DataFrame:
    """(x, label) from lines `x1 ... xD class`; a header line has D alone."""
    f = spark.read.text(path).where("trim(value) <> ''").select(_fields().alias("f"))
    if header:
        f = f.where(F.size("f") > 1)
    n = F.size("f") - int(labelled)
    label = F.element_at("f", -1).alias("label") if labelled else F.lit(None).cast("string").alias("label")
    return f.select(F.slice("f", F.lit(1), n).cast("array<double>").alias("x"), label)


def read_svm_output(spark: SparkSession, path: str) -> DataFrame:
    """(label, p) from prediction lines; a first line `labels ...` names the classes."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith("labels")).select(_fields().alias("f")).select(F.get("f", F.lit(0)).cast("double").alias("label"), F.slice("f", F.lit(2), F.size("f")).cast("array<double>").alias("p"))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """(t, lon, lat, q, qerr): a date in the first 23 characters, then four numbers."""
    rest = F.split(F.trim(F.substring("value", 24, 1_000_000)), r"\s+")
    numbers = {c: F.get(rest, F.lit(k)).try_cast("double") for k, c in enumerate(("lon", "lat", "q", "qerr"))}
    return spark.read.text(path).where("trim(value) <> ''").select(dates.parse(F.trim(F.substring("value", 1, 23))).alias("t"), *(v.alias(c) for c, v in numbers.items()))


def write_measurements(df: DataFrame, path: str) -> None:
    date = F.rpad(F.date_format("t", "yyyy/MM/dd-HH:mm:ss"), 23, " ")
    df.select(F.concat(date, F.format_string(" %12.6f %12.6f %14.7g %14.7g", "lon", "lat", "q", "qerr")).alias("value")).write.text(path)


def read_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) from lines of three numbers; others, such as a header of dimensions alone, have no value."""
    f = spark.read.text(path).select(_fields().alias("f")).where("size(f) = 3")
    return f.select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.col("f")[2].cast("double").alias("v"))


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat) lines of one contour for each file, in the order of their numbers `seq`."""
    f = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("seq")).where("trim(value) <> ''")
    return f.select(F.col("file_path").alias("rec"), "seq", _fields().getItem(0).cast("double").alias("lon"), _fields().getItem(1).cast("double").alias("lat"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(j, ave, std) from lines of two numbers."""
    f = spark.read.text(path).select(_fields().alias("f"), F.monotonically_increasing_id().alias("j")).where("size(f) = 2")
    return f.select("j", F.col("f")[0].cast("double").alias("ave"), F.col("f")[1].cast("double").alias("std"))
