"""Exact duplicates by distributed most-significant-digit radix partitioning; texts are compared by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Workspace, fresh, text_or_empty, with_summary

#: Bytes of the first digit; each next digit is WIDEN times as wide.
FIRST_BYTES, WIDEN = 64, 16
#: Hash buckets of groups that go on: texts in no such bucket aren't moved. More buckets only move less.
BUCKETS = 1 << 20


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def radix_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of equal texts of every row, and the row of each group that stays.

    Texts are equal if they are identical without white space. The key of a text is its byte length, then
    its bytes. Rows are partitioned by the length and the first 64 bytes; groups of several rows that go
    on are partitioned by the next 1 KiB, 16 KiB and so on, until each group is one row or has ended. Only
    such groups' bytes are moved after the first digit, and no digest takes part in the comparison.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of a group, the row with the most code
    points in its original text stays, then the one with the smallest id.

    Null text counts as empty; all empty texts are one group. Repeated rows (same id and text) are rows of
    one group, each marked kept if its id is keep_id. A null id sorts after others. Other columns are ignored.
    An empty table gives no rows. A very long text is moved as a whole in the rounds after the first, if another has its length and
    first bytes. A group of any size is only counted, with partial sums before the shuffle, and joined to its one-row
    summary, which is broadcast for large groups (see with_summary).
    """
    ws = Workspace(df.sparkSession, "radix")
    text = text_or_empty(text_col)
    base = df.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("_n"), normalised(text).alias("_norm"))
    base = base.withColumns({"_bytes": F.col("_norm").cast("binary"), "_len": F.octet_length("_norm")})
    first = F.substring("_bytes", 1, FIRST_BYTES)
    slim = ws.save(base.select("doc_id", "_n", "_len", first.alias("_digit"), F.sha2("_bytes", 256).alias("text_sha256")))

    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("_best")
    groups = slim.groupBy("_len", "_digit").agg(F.count("*").alias("group_size"), best)
    several = ws.save(groups.where("group_size > 1").withColumn("_group", F.monotonically_increasing_id()))

    def finished(rows: DataFrame) -> DataFrame:
        keep = F.col("_best.doc_id")
        return rows.select("doc_id", keep.alias("keep_id"), "group_size", keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")

    joined = with_summary(slim, several, ["_len", "_digit"], "group_size", slim.count(), "left")
    alone = joined.where("_best is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    out = alone.unionByName(finished(joined.where(F.col("_best").isNotNull() & (F.col("_len") <= FIRST_BYTES))))

    bucket = F.pmod(F.xxhash64("_len", "_digit"), F.lit(BUCKETS)).cast("int")
    going = several.where(F.col("_len") > FIRST_BYTES).select("_len", "_digit", "_group", "group_size")
    texts = base.select("doc_id", "_n", "_len", first.alias("_digit"), "_bytes").withColumn("_bucket", bucket)
    near = texts.join(F.broadcast(going.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").select("doc_id", "_n", "_len", "_digit", "_bytes")
    moved = with_summary(near, going, ["_len", "_digit"], "group_size", slim.count())
    active = ws.save(moved.select("doc_id", "_n", "_len", "_group", F.sha2("_bytes", 256).alias("text_sha256"), F.substring("_bytes", FIRST_BYTES + 1, 2**31 - 1).alias("_rest")))
    done, width = FIRST_BYTES, FIRST_BYTES * WIDEN
    while total := active.count():
        digit = active.withColumn("_digit", F.substring("_rest", 1, width))
        groups = ws.save(
            digit.groupBy("_group", "_digit").agg(F.count("*").alias("group_size"), best).withColumn("_next", F.monotonically_increasing_id())
        )
        joined = with_summary(digit, groups, ["_group", "_digit"], "group_size", total)
        done += width
        over = (F.col("group_size") == 1) | (F.col("_len") <= done)
        out = out.unionByName(finished(ws.save(joined.where(over).select("doc_id", "_best", "group_size", "text_sha256"))))
        following = ws.save(
            joined.where(~over).select("doc_id", "_n", "_len", F.col("_next").alias("_group"), "text_sha256", F.substring("_rest", width + 1, 2**31 - 1).alias("_rest"))
        )
        ws.drop(active)
        ws.drop(groups)
        active, width = following, width * WIDEN
    return out


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, that radix_groups() keeps; of repeated rows (same id, equal text) one stays. Rows without an id stay."""
    kept = radix_groups(df, id_col, text_col).where("kept and doc_id is not null")
    own, other, sha = fresh(df, "_id"), fresh(df, "_kept"), fresh(df, "_sha")
    keep = kept.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(other)).distinct()
    there = df.where(F.col(id_col).isNotNull()).withColumn(sha, F.sha2(normalised(text_or_empty(text_col)).cast("binary"), 256))
    rows = there.join(keep, (F.col(id_col) == F.col(own)) & (F.col(sha) == F.col(other)), "left_semi").dropDuplicates([id_col, sha])
    return rows.drop(sha).unionByName(df.where(F.col(id_col).isNull()))
