"""Quality: per-document perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Length of n-grams of characters, and bits of a character in a context. A character is its code point plus 1; 0 is before the text.
ORDER, BITS = 4, 21
#: The quantile of trusted rows' perplexity that sets a language's threshold, and the slack over it.
QUANTILE, SLACK = 0.99, 1.1
#: Ids of trusted rows up to which they are broadcast to find their texts; more are joined by shuffle.
BROADCAST = 1_000_000
#: Bytes of text that are scored together, on average; less where whole rows are kept beside their scores.
BLOCK_BYTES, ROW_BLOCK_BYTES = 16 << 20, 4 << 20
#: Bits a character that a text of n characters may be over its threshold, times the root of n: the mean of few characters varies.
SHORT = 6.0
#: Characters of a piece in which different n-grams are counted, and how far a text of n characters may be under its least variety, times the root of n.
PIECE, SHORT_VARIETY = 1024, 0.6
#: Characters of texts that numpy works on at once.
AT_ONCE = 1 << 18


def batched(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE characters."""
    first = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= AT_ONCE:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The context, ORDER - 1 characters in one number, and the character, at each place of the texts."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    spaced = np.zeros(len(points) + (ORDER - 1) * len(texts), dtype=np.int64)
    at = np.arange(len(points)) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), lengths)
    spaced[at] = points + 1
    context = np.zeros(len(points), dtype=np.int64)
    for k in range(ORDER - 1, 0, -1):
        context = context << BITS | spaced[at - k]
    return context, points + 1


def keys(context: np.ndarray, character: np.ndarray) -> np.ndarray:
    """One mixed number for each n-gram."""
    x = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + character.astype(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def different(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of texts, contexts and characters, and their counts."""
    found = []
    for a, b in batched(texts):
        context, character = grams(texts[a:b])
        _, first, n = np.unique(keys(context, character), return_index=True, return_counts=True)
        found.append((context[first], character[first], n))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    context, character, n = (np.concatenate(x) for x in zip(*found, strict=True))
    _, first, of = np.unique(keys(context, character), return_index=True, return_inverse=True)
    return context[first], character[first], np.bincount(of, weights=n, minlength=len(first)).astype(np.int64)


class Model:
    """Interpolated modified Kneser-Ney: for each order, the counts (context, character, n) and sums of contexts, as
    tables that are joined by n-gram and by context.

    The highest order has counts; lower orders count in how many contexts they continue; the lowest is interpolated with an even
    share for all characters and one more. Discounts, one for counts of 1, of 2 and of 3 or more, come from each order's counts of counts.
    """

    def __init__(self, counts: DataFrame, ws: Workspace):
        """counts: context, character, n of the highest order."""
        self.orders = []
        table = ws.save(counts)
        for order in range(ORDER, 0, -1):
            of = [F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]
            n = [max(1, x or 0) for x in table.agg(*of).first()]
            y = n[0] / (n[0] + 2 * n[1])
            less = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
            taken = F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])
            sums = ws.save(table.groupBy("context").agg(F.sum("n").alias("_all"), (F.sum(taken) / F.sum("n")).alias("_back")))
            self.orders.append((order, table.select("context", "character", (F.col("n") - taken).alias("_rest")), sums))
            if order > 1:
                shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 2)) - 1))
                table = ws.save(table.groupBy(shorter.alias("context"), "character").agg(F.count("*").alias("n")))
        self.even = 1 / (1 + table.count())

    def chances(self, wanted: DataFrame) -> DataFrame:
        """context, character and log2 of their chance, for different n-grams. Each order is two joins; what has a context of one character or none is
        at most as long as there are characters, and is broadcast."""
        rows = wanted.withColumn("_chance", F.lit(self.even))
        for order, table, sums in reversed(self.orders):
            small = F.broadcast if order <= 2 else lambda x: x
            own = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            rows = rows.withColumn("_own", own)
            rows = rows.join(small(sums.withColumnRenamed("context", "_own")), "_own", "left")
            one = F.broadcast if order == 1 else lambda x: x
            rows = rows.join(one(table.withColumnsRenamed({"context": "_own"})), ["_own", "character"], "left")
            mixed = F.coalesce(F.col("_rest") / F.col("_all"), F.lit(0.0)) + F.col("_back") * F.col("_chance")
            rows = rows.select("context", "character", F.coalesce(mixed, "_chance").alias("_chance"))
        return rows.select("context", "character", F.log2("_chance").cast("float").alias("log_chance"))


def varieties(texts: list[str]) -> np.ndarray:
    """Each text's mean, by size, of log(different n-grams) / log(n-grams) in its pieces: near 1 in prose of any
    language or script, as characters count by code point, and low where a word or sentence repeats. 1 for texts without two n-grams."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < ORDER:
        return np.ones(len(texts))
    mixed = np.zeros(len(points) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        mixed = (mixed + points[k : len(mixed) + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    pieces = np.maximum(1, -(-lengths // PIECE))
    piece = (np.cumsum(pieces) - pieces)[text] + place // PIECE
    inside = text[: len(mixed)] == text[ORDER - 1 :]
    piece, of = piece[: len(mixed)][inside].astype(np.uint64), np.repeat(np.arange(len(texts)), pieces)
    bits = np.uint64(int(len(of)).bit_length())
    keys = np.sort(piece << (np.uint64(64) - bits) | mixed[inside] >> bits)
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    different = np.bincount((keys[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(of))
    size = np.bincount(piece.astype(np.int64), minlength=len(of))
    size[size < 2] = 0
    share = np.log(np.maximum(different, 1)) / np.log(np.maximum(size, 2))
    whole = np.bincount(of, weights=size, minlength=len(texts))
    return np.divide(np.bincount(of, weights=share * size, minlength=len(texts)), whole, out=np.ones(len(texts)), where=whole > 0)


def scored(df: DataFrame, model: Model, emit: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What `emit` makes of the rows of `df` with their perplexities per character (1 for an empty text), lengths and varieties.

    Rows are dealt to blocks by a hash. A block's different n-grams are looked up in the model, by joins on n-gram and context, and come
    back to the block; so what is moved is each text once, and an n-gram once for each block that has it.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    names, text_at = df.columns, df.columns.index(text_col)
    dealt = df.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("_block", F.pmod(F.xxhash64(*(f"c{k}" for k in range(len(names)))), F.lit(1 + size // block_bytes)))

    def texts_of(table: pa.Table) -> list[str]:
        return ["" if x is None else str(x) for x in table.column(text_at).to_pylist()]

    def ask(table: pa.Table) -> pa.Table:
        context, character, _ = different(texts_of(table))
        block = table.column("_block").slice(0, 1).to_pylist() * len(context)
        return pa.table({"_block": pa.array(block, pa.int64()), "context": context, "character": character})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(table)
        known = keys(answers.column("context").to_numpy(), answers.column("character").to_numpy())
        order = np.argsort(known)
        known, chance = known[order], answers.column("log_chance").to_numpy()[order].astype(np.float64)
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        total, variety = np.zeros(len(texts)), np.ones(len(texts))
        for a, b in batched(texts):
            full = np.flatnonzero(lengths[a:b])
            if len(full):
                each = chance[np.searchsorted(known, keys(*grams(texts[a:b])))]
                total[a + full] = np.add.reduceat(each, (np.cumsum(lengths[a:b]) - lengths[a:b])[full])
            variety[a:b] = varieties(texts[a:b])
        return emit(table.drop_columns(["_block"]).rename_columns(names), np.exp2(-total / np.maximum(lengths, 1)), lengths, variety)

    asked = dealt.groupBy("_block").applyInArrow(ask, "_block long, context long, character long")
    chances = model.chances(asked.select("context", "character").distinct())
    answers = asked.join(chances, ["context", "character"])
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, schema)


def perplexities(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, n_chars, the perplexity per character of every whole text, 1 for an empty one, and its variety."""
    lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
    slim = df.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))

    def emit(table: pa.Table, perplexity: np.ndarray, lengths: np.ndarray, variety: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": table.column("doc_id"), "lang": table.column("lang"), "n_chars": lengths, "perplexity": perplexity, "variety": variety})

    return scored(slim, model, emit, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang string, n_chars long, perplexity double, variety double", "text")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Model, DataFrame]:
    """The model of half of the trusted rows, and the other half: doc_id, lang, text."""
    ws = Workspace(df.sparkSession, "quality")
    trusted = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).where("_label = 1")
    chosen = ws.save(trusted.select("_id", (F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)) == 0).alias("_model")))
    if chosen.count() <= BROADCAST:
        chosen = F.broadcast(chosen)
    lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
    texts = df.select(F.col(id_col).alias("_id"), lang.alias("lang"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(chosen, "_id").dropDuplicates(["_id"])

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in different([x or "" for x in batch.column(0).to_pylist()])], names=["context", "character", "n"])

    counted = rows.where("_model").select("_text").mapInArrow(counts_of, "context long, character long, n long")
    model = Model(counted.groupBy("context", "character").agg(F.sum("n").alias("n")), ws)
    return model, rows.where("not _model").select(F.col("_id").alias("doc_id"), "lang", F.col("_text").alias("text"))


def limits_of(own: DataFrame, quantile: float, slack: float) -> tuple[DataFrame, tuple[float, float]]:
    """Each language's limits and the limits of all, from trusted rows that the model hasn't seen, with their scores."""
    at = F.expr(f"percentile(perplexity, {float(quantile)})") * slack
    least = F.expr(f"percentile(variety, {1 - float(quantile)})") / slack
    most, few = own.agg(at, least).first()
    overall = (float("inf"), 0.0) if most is None else (float(most), float(few))
    limits = own.where("lang is not null").groupBy("lang").agg(at.alias("threshold"), least.alias("least"), F.count("*").alias("_n")).where("_n >= 20").select("lang", "threshold", "least")
    return limits, overall


def quality(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and accepted (perplexity at most the threshold, and no repeated text) of every whole text.

    Trusted text is that of all rows labelled 1. Half of them, by a hash of the id, make the model: n-grams of ORDER characters, each any code
    point, are counted over all partitions and kept as tables (see Model). The other half, which the model hasn't seen,
    sets each language's limit: `slack` times the `quantile` of its perplexities. A text's threshold is
    its language's limit, raised by SHORT / sqrt(n_chars) bits for the chance variation of short texts. Text that repeats a word or
    a sentence is easy to foresee; so a text's variety (see varieties) must not be less than its language's least
    one, the 1 - `quantile` quantile of the trusted rows by `slack`, less SHORT_VARIETY / sqrt(n_chars). A language with
    fewer than 20 such rows, and a null one, get the limit of all rows.

    Null or empty text: perplexity 1, accepted. A very long text takes memory in proportion to its length, in one task. Rows with a null
    label, and labels without a document, are
    not trusted; of several labels for an id the lowest counts. Repeated rows each get a score. Without any
    trusted row all texts are accepted. Other columns are ignored. An empty table gives no rows.
    """
    model, unseen = fit(df, labels, id_col, text_col, label_col)
    found = Workspace(df.sparkSession, "perplexity").save(perplexities(df, model, id_col, text_col))
    limits, overall = limits_of(found.join(unseen.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]), quantile, slack)
    scores = found.join(F.broadcast(limits), "lang", "left")
    limit = F.coalesce("threshold", F.lit(overall[0]))
    least = F.coalesce("least", F.lit(overall[1])) - SHORT_VARIETY / F.sqrt(F.greatest("n_chars", F.lit(1)))
    limit = limit * F.pow(F.lit(2.0), SHORT / F.sqrt(F.greatest("n_chars", F.lit(1))))
    return scores.select("doc_id", "lang", "n_chars", "perplexity", limit.alias("threshold"), ((F.col("perplexity") <= limit) & (F.col("variety") >= least) | (F.col("n_chars") == 0)).alias("accepted"))


def accepted_only(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `df`, all columns, that quality() accepts; each is scored and kept or not where its block is.

    Null and empty texts stay; repeated rows and null ids stay or go by their text; an empty table gives no rows; columns of any name are kept as
    they are. The limits of languages are few: each has 20 trusted rows at least.
    """
    model, unseen = fit(df, labels, id_col, text_col, label_col)
    limits, overall = limits_of(Workspace(df.sparkSession, "perplexity").save(perplexities(unseen, model)), quantile, slack)
    limit = {r["lang"]: (r["threshold"], r["least"]) for r in limits.collect()}

    def emit(table: pa.Table, perplexity: np.ndarray, lengths: np.ndarray, variety: np.ndarray) -> pa.Table:
        langs = table.column("lang").to_pylist() if "lang" in table.column_names else [None] * table.num_rows
        most, least = np.array([limit.get(x, overall) for x in langs]).reshape(-1, 2).T
        root = np.sqrt(np.maximum(lengths, 1))
        return table.filter(pa.array((perplexity <= most * 2.0 ** (SHORT / root)) & (variety >= least - SHORT_VARIETY / root) | (lengths == 0)))

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return scored(df, model, emit, fields, text_col, ROW_BLOCK_BYTES)
