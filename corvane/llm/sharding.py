"""Contiguous shards of near equal bytes, from global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty


def balanced_shards(df: DataFrame, n_shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows, in the order of `id_col`, to `n_shards` contiguous shards of near equal size.

    A row's size is its text's UTF-8 bytes plus `overhead`. Rows are dealt by range to partitions, each
    partition's total gives its offset, and a row's place is that offset plus the sum within its partition.
    The row goes to the shard that holds its middle byte, so a shard misses its target by one row at most.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Null text: no bytes. Null ids come first. Repeated rows are kept, each with a place of its own; rows
    of one id are ordered by checksum, then size. Other columns are ignored. An empty table gives no rows.
    Only the totals of partitions and shards are broadcast: a row for each partition, or for each shard.
    """
    ws, text = Workspace(df.sparkSession, "shards"), text_or_empty(text_col)
    slim = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["doc_id", "text_crc32", "size", "_tie"]
    placed = ws.save(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = (
        placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_all"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    twice_middle = 2 * (F.col("_bytes_before") + F.sum("size").over(inside)) - F.col("size")
    ranked = ws.save(
        placed.join(F.broadcast(offsets), "_part").select(
            "doc_id", "size", "text_crc32",
            (F.col("_rows_before") + F.count("*").over(inside) - 1).alias("_rank"),
            F.least(F.lit(n_shards - 1), F.floor(twice_middle * n_shards / (2 * F.col("_all")))).cast("int").alias("shard"),
        )
    )
    ws.drop(placed)
    first = ranked.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
