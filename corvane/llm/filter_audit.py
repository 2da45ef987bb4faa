"""What each of several filters removes, in every order in which they can be applied."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty, with_summary

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)

#: FIRST[mask, order]: the step (from 0) whose filter is the first that a document failing the filters of `mask` fails; STEPS for none.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for m in range(MASKS)])
#: AGAIN[mask, order, step]: whether such a document fails the step's filter too, after an earlier one removed it.
AGAIN = np.array([[[m >> FILTERS.index(f) & 1 and FIRST[m, k] < s for s, f in enumerate(o)] for k, o in enumerate(ORDERS)] for m in range(MASKS)], dtype=np.int64)

#: Parts whose sums a task holds before it hands them on.
PARTS = 500


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few different words), C (many capitals), D (symbols)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 200, 100 * different.cast("long") < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")]


def masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, kind) of each row: a bit for each filter it fails, and 1 if it is labelled good plus 2 if labelled toxic.

    Filter E, a text that a smaller id has, compares texts by SHA-256 and length over the whole table. Groups of more than one are joined with their
    smallest id, large ones by broadcast (see common.with_summary).
    """
    ws, text = Workspace(df.sparkSession, "audit"), text_or_empty(text_col)
    bits = sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text"))))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = ws.save(rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").alias("length"), bits.alias("mask")))
    same = rows.groupBy("digest", "length").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
    met = with_summary(rows, ws.save(same), ["digest", "length"], "size", rows.count(), "left")
    e = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    marks = labels.groupBy(F.col("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    kind = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("bad", F.lit(0))
    return met.join(marks, "doc_id", "left").select("part", (F.col("mask") + e).cast("int").alias("mask"), kind.cast("int").alias("kind"))


SUMS = ("removed", "redundant", "good_lost", "toxic_lost")


def removals(cells: np.ndarray) -> list[np.ndarray]:
    """SUMS by order and step, flat, of cells[mask, kind], how many documents there are of each."""
    step = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST
    lost = lambda n: np.bincount(step.ravel(), np.repeat(n, len(ORDERS)), len(ORDERS) * (STEPS + 1)).reshape(-1, STEPS + 1)[:, :STEPS].astype(np.int64).ravel()
    n = cells.sum(axis=1)
    return [lost(n), np.tensordot(n, AGAIN, 1).ravel(), lost(cells[:, 1] + cells[:, 3]), lost(cells[:, 2] + cells[:, 3])]


def partial_sums(batches):
    """Of batches (part, mask, kind): (part, at, n, sums..., alone) for each part and each of the 600 places `at` of order and step."""
    held: dict[str, np.ndarray] = {}

    def out():
        places = len(ORDERS) * STEPS
        for part, cells in held.items():
            alone = [int(cells[1 << FILTERS.index(f)].sum()) for o in ORDERS for f in o]
            columns = [pa.array([part] * places, pa.string()), pa.array(range(places), pa.int32()), pa.array([int(cells.sum())] * places, pa.int64())]
            columns += [pa.array(x, pa.int64()) for x in (*removals(cells), alone)]
            yield pa.record_batch(columns, names=["part", "at", "n", *SUMS, "alone"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        at = parts.indices.to_numpy().astype(np.int64) * (MASKS * 4) + batch.column(1).to_numpy() * 4 + batch.column(2).to_numpy()
        for name, cells in zip(names, np.bincount(at, minlength=len(names) * MASKS * 4).reshape(-1, MASKS, 4), strict=True):
            held[name] = held[name] + cells if name in held else cells
        if len(held) > PARTS:
            yield from out()
            held = {}
    yield from out()


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters remove from each part of a table in each of their 120 orders and each step.

    A text fails A: under 200 words `[^\\x20\\x09-\\x0D]+`; B: fewer than half of its words are different; C: over 2 % of its characters are A-Z; D: it has
    one of `#$%&*|`; E: a smaller id of the table has the same text. Returns part, filter_order, step (1 to 5), kept (after the step), removed (by it),
    redundant (fail its filter but were removed before), unique_fails (fail only its filter), good_lost and toxic_lost (removed by it, labelled so),
    shapley (the sum of its filter's `removed` over all orders); zeros included.

    Each task counts its documents by part, mask of failures and label, looks up the first failure of every mask in every order, and adds removals by
    order and step; Spark adds the tasks' sums. A document is read once, not once for each order.

    Null text is empty; an empty text fails A, and E if it isn't the first. A null part is ''. A row with a null id is never a later copy nor an earlier one. Repeated rows
    count each; rows of one id are no copies of each other. Of several labels of an id, any counts; labels with a null id are ignored. Other
    columns are ignored, whatever their names. A very long text takes memory in proportion to its length. An empty table gives no rows.
    """
    sums = masks(df, labels, id_col, text_col, part_col).mapInArrow(partial_sums, "part string, at int, n long, removed long, redundant long, good_lost long, toxic_lost long, alone long")
    rows = sums.groupBy("part", "at").agg(*(F.sum(c).alias(c) for c in ("n", *SUMS)), F.sum("alone").alias("unique_fails"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("at") / STEPS) + 1).cast("int"))
    rows = rows.withColumns({"filter_order": order, "step": (F.col("at") % STEPS + 1).cast("int")}).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    upto = Window.partitionBy("part", "filter_order").orderBy("step")
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.sum("removed").over(upto)).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
