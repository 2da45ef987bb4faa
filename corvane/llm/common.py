"""What the text operators share: the shared folder, saved intermediates, the documents table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The white space that the contracts name, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, a temporary one if all of Spark is this process, else an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Workspace:
    """Intermediates written as Parquet in the shared folder, so that a lost executor costs no lineage.

    `save` writes and rereads a frame; `drop` deletes what is no longer needed. What a returned frame still
    reads stays, under one folder for each application.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvane_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._corvane_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it none of the frame's columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def with_summary(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", least: int = 1000, most: int = 10_000) -> DataFrame:
    """The rows with their group's other columns, a join on `keys` in which no large group meets in one task.

    Groups of more than max(`least`, `total` / `most`) of the `total` rows, at most `most` groups, are broadcast; the rows of all
    others are joined by shuffle. With `how` = "left", rows without a group have nulls.
    """
    large = max(least, total // most)
    mark, added = fresh(rows, "_met"), [c for c in groups.columns if c not in keys]
    met = rows.join(F.broadcast(groups.where(F.col(size) > large).withColumn(mark, F.lit(True))), keys, "left")
    others = met.where(F.col(mark).isNull()).select(*rows.columns).join(groups.where(F.col(size) <= large), keys, how)
    return met.where(F.col(mark)).select(*rows.columns, *added).unionByName(others.select(*rows.columns, *added))
