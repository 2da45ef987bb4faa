"""Repeated runs of lines: a suffix array over line identities by distributed prefix doubling (DataFrame operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty, with_summary

#: Lines of a run that counts as repeated, and characters from which a line alone is one.
MIN_LINES, LONG_LINE = 3, 150
#: Hash buckets of documents: those in no bucket of a set aren't moved. More buckets only move less.
BUCKETS = 1 << 20


def bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def number(x: Column) -> Column:
    """A whole number as 8 bytes in its order."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def placed_lines(df: DataFrame, ws: Workspace, long_line: int, id_col: str, text_col: str) -> DataFrame:
    """d, doc_id, key, lines of every different document; d rises with doc_id, then key, a hash of the text.

    lines: the number i, identity and length over `long_line` of each line that isn't blank, trimmed.
    """
    text = text_or_empty(text_col)
    trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line")))
    found = F.transform(F.filter(trimmed, lambda x: x["line"] != ""), lambda x: F.struct(x["i"].alias("i"), F.unhex(F.md5(x["line"].cast("binary"))).alias("id"), (F.length(x["line"]) >= long_line).alias("long")))
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), found.alias("lines")).where(F.size("lines") > 0)
    in_order = docs.dropDuplicates(["doc_id", "key"]).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    return ws.save(in_order.withColumn("d", F.monotonically_increasing_id()))


def suffix_levels(placed: DataFrame, ws: Workspace, min_lines: int, to_end: bool = True) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Prefix doubling: (width, places) for each width of window, and the ranks of all suffixes.

    A suffix is a place (d, n) with the lines from there to the document's end. Its rank at a width is the same as that of
    another if their first lines, `width` many, are the same, and else in the order of these lines: ranks are
    bytes, to which each round appends the place of the suffix among those that shared its rank. Suffixes that share their
    rank with no other, or have ended, keep it. places: d, n, left (lines to the end), rank,
    size (suffixes that share the rank: the interval of the suffix array with that common prefix) and first, the
    least place of these; only of suffixes that shared the rank before. Widths double up to `min_lines`, which is one of them, and from there on.
    """
    ended = F.unhex(F.lit(""))
    lines = placed.select("d", F.size("lines").alias("_all"), F.posexplode("lines").alias("n", "_line"))
    lines = lines.select("d", "n", (F.col("_all") - F.col("n")).alias("left"), F.col("_line.id").alias("rank"), F.col("_line.long").alias("long"))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.struct("d", "n")).alias("first"))

    total = placed.select(F.sum(F.size("lines"))).first()[0] or 0
    found = with_summary(lines, summed(lines, "rank").where("size > 1"), ["rank"], "size", total, "left")
    now = ws.save(found.withColumn("size", F.coalesce("size", F.lit(1))))
    width, levels, final = 1, [], []
    while True:
        levels.append((width, now))
        more = (F.col("size") > 1) & (F.col("left") > width)
        final.append(now.where(~more).select("d", "n", "rank"))
        active = now.where(more)
        total = active.count() if to_end or width < min_lines else 0
        if not total:
            return levels, reduce(DataFrame.unionByName, [*final[:-1], now.select("d", "n", "rank")])
        step = min(width, min_lines - width) if width < min_lines else width
        every = reduce(DataFrame.unionByName, [*(x.withColumns({"left": F.lit(None).cast("int")}) for x in final), active.select("d", "n", "rank", "left")])
        near = every.join(F.broadcast(active.select(bucket("d").alias("_bucket")).distinct()), bucket("d") == F.col("_bucket"), "left_semi")
        after = F.coalesce(F.lead("rank", step).over(Window.partitionBy("d").orderBy("n")), ended)
        pairs = ws.save(near.withColumn("second", after).where("left is not null"))
        groups = summed(pairs, "rank", "second").repartitionByRange("rank", "second").sortWithinPartitions("rank", "second")
        groups = ws.save(groups.withColumn("_new", F.concat("rank", number(F.monotonically_increasing_id()))))
        now = ws.save(with_summary(pairs, groups, ["rank", "second"], "size", total).select("d", "n", "left", F.col("_new").alias("rank"), "size", "first"))
        ws.drop(pairs)
        ws.drop(groups)
        width += step


def copies(levels: list[tuple[int, DataFrame]], width: int) -> DataFrame:
    """d, n, first of windows of `width` lines that are equal to an earlier one."""
    places = dict(levels).get(width)
    if places is None:
        return levels[0][1].where("false").select("d", "n", "first")
    return places.where((F.col("size") > 1) & (F.col("left") >= width) & (F.struct("d", "n") != F.col("first"))).select("d", "n", "first")


def repeated_runs(df: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal runs of at least `min_lines` lines that are copies: doc_id, line, n_lines, of_doc_id, of_line.

    Each window of `min_lines` lines that is equal to an earlier one is a copy of the first such; copies that follow
    each other as their originals do make one run, which is maximal: the windows before and after it aren't copies of
    the lines before and after the original. Lines count from 0 among all lines of a text. See line_dedup for
    nulls, repeats, empty tables and clashing names.
    """
    ws = Workspace(df.sparkSession, "runs")
    placed = placed_lines(df, ws, LONG_LINE, id_col, text_col)
    levels, _ = suffix_levels(placed, ws, min_lines, to_end=False)
    apart = Window.partitionBy("d", "first.d", F.col("n") - F.col("first.n")).orderBy("n")
    windows = copies(levels, min_lines).withColumn("_run", F.col("n") - F.row_number().over(apart))
    runs = windows.groupBy("d", F.col("first.d").alias("_d"), (F.col("n") - F.col("first.n")).alias("_by"), "_run").agg(F.min("n").alias("n"), F.count("*").alias("_n"))
    docs = placed.select("d", "doc_id", F.col("lines.i").alias("_at"))
    own = runs.join(docs, "d").select("_d", "doc_id", F.element_at("_at", F.col("n") + 1).alias("line"), (F.col("_n") + min_lines - 1).alias("n_lines"), (F.col("n") - F.col("_by")).alias("_n"))
    return own.join(docs.select(F.col("d").alias("_d"), F.col("doc_id").alias("of_doc_id"), "_at"), "_d").select("doc_id", "line", "n_lines", "of_doc_id", F.element_at("_at", F.col("_n") + 1).alias("of_line"))


def suffix_array(df: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, rank of the suffix that begins at each line that isn't blank: the suffix array is their order by rank.
    Suffixes of the same lines share a rank; others compare as their lines do, in an order of the lines' own."""
    ws = Workspace(df.sparkSession, "suffixes")
    placed = placed_lines(df, ws, LONG_LINE, id_col, text_col)
    _, ranks = suffix_levels(placed, ws, min_lines)
    return ranks.join(placed.select("d", "doc_id", F.col("lines.i").alias("_at")), "d").select("doc_id", F.element_at("_at", F.col("n") + 1).alias("line"), "rank")


def line_dedup(df: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the later copies of repeated runs of lines: doc_id, text, n_lines, removed_lines.

    Lines are compared without white space at their ends, by md5; blank lines are not part of runs and stay. A
    run is repeated if it occurs at two places and has at least `min_lines` lines, or is one line of at least
    `long_line` characters. The occurrence that comes first by document id, then line, stays; a line of
    any later one goes. The suffix array of all documents' lines comes from prefix doubling (see suffix_levels); its
    intervals of a common prefix of `min_lines` lines are the repeated runs: every longer one is made of them, each
    deeper interval lies within one.

    Null text: null, no lines. A null id comes first in the order. Repeated rows (same id and text) are one document and
    don't count as copies of each other; rows of one id with different texts are different documents, in the
    order of a hash of the text. A very long text is one row of line identities, and its lines are ranked like all
    others. Other columns are ignored. An empty table gives no rows. A line or run that occurs anywhere is grouped with partial minima
    and joined to its one-row summary, which is broadcast for large groups. Only texts that may lose lines are moved.
    """
    ws = Workspace(df.sparkSession, "lines")
    placed = placed_lines(df, ws, long_line, id_col, text_col)
    levels, _ = suffix_levels(placed, ws, min_lines)
    alone = levels[0][1].where("long and size > 1").where(F.struct("d", "n") != F.col("first")).select("d", "n", F.lit(1).alias("width"))
    windows = alone.unionByName(copies(levels, min_lines).select("d", "n", F.lit(min_lines).alias("width")))
    gone = windows.groupBy("d").agg(F.collect_set(F.struct("n", "width")).alias("_windows"))
    places = F.array_distinct(F.flatten(F.transform("_windows", lambda x: F.sequence(x["n"], x["n"] + x["width"] - 1))))
    removed = gone.join(placed.select("d", "doc_id", "key", F.col("lines.i").alias("_at")), "d").select("doc_id", "key", F.array_sort(F.transform(places, lambda n: F.element_at("_at", n + 1))).alias("_gone"))
    removed = ws.save(removed)

    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text_col).cast("string").alias("text"))
    some = F.broadcast(removed.select(bucket("doc_id", "key").alias("_bucket")).distinct())
    untouched = docs.join(some, bucket("doc_id", "key") == F.col("_bucket"), "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("_gone"))
    near = docs.join(some, bucket("doc_id", "key") == F.col("_bucket"), "left_semi")
    joined = near.alias("d").join(removed.alias("r"), [F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("d.key") == F.col("r.key")], "left").select("d.doc_id", "d.text", "r._gone")
    every = untouched.unionByName(joined).withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    # what stays are the slices between one line that goes and the next
    bounds = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_gone") + 1), lambda k: F.slice("_lines", F.element_at(bounds, k) + 2, F.element_at(bounds, k + 1) - F.element_at(bounds, k) - 1)))
    return every.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("removed_lines"),
    )
