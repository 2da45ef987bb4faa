"""Phrases that occur together more often than their parts, by language."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty, with_summary

#: What ends a piece of text, `[.,;:!?\x0A-\x0D]`; a tab parts words as a space does.
ENDS = b".,;:!?\n\x0b\x0c\r"

#: Each end becomes a full stop, which no word holds.
_PLAIN = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")

#: Bytes of text that are counted at once, and the most bits that a filter of frequent phrases has.
CHUNK, MOST_BITS = 4 << 20, 28

GRAMS = "lang string, phrase string, c long"

#: The row that counts all words of a language; no phrase is empty.
ALL = ""


def _folded(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9) + word


def _word_hashes(lang: str, words) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def _phrase_hashes(batches):
    """The hash of each row (lang, phrase), as `counted` makes it."""
    for batch in batches:
        out = []
        for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, *rest = _word_hashes(lang, phrase.encode().split(b" "))[:, None]
            for word in rest:
                first = _folded(first, word)
            out.append(first)
        yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())], names=["h"])


class Filter:
    """One bit for each hash; a phrase without its bit is not frequent. A phrase with it may be, which the counts tell."""

    def __init__(self, frequent: DataFrame):
        n = frequent.count()
        self.log = min(MOST_BITS, max(16, (16 * n).bit_length()))
        at = frequent.select("lang", "phrase").mapInArrow(_phrase_hashes, "h long").select(F.shiftrightunsigned("h", 64 - self.log).alias("at"))
        words = at.selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, cast(at & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.bits = np.zeros(1 << (self.log - 6), dtype=np.uint64)
        self.bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.log)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def counted(lang: str, texts: list[bytes], n: int, frequent: Filter | None) -> pa.RecordBatch:
    """The different phrases of `n` words of one language's texts with their counts, but those with a part that `frequent` excludes;
    with single words, also how many there are."""
    words = b".".join(texts).lower().translate(_PLAIN).replace(b".", b" . ").split()
    index = {w: i for i, w in enumerate(dict.fromkeys([b".", *words]))}
    ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
    if frequent is None:
        counts = np.bincount(ids, minlength=len(index))
        counts[0] = counts[1:].sum()
        phrases = [ALL.encode(), *list(index)[1:]]
    else:
        hashes = _word_hashes(lang, index)
        places = max(0, len(ids) - n + 1)
        there = np.ones(places, dtype=bool)
        for j in range(n):
            there &= ids[j : j + places] != 0
        h = hashes[ids]
        for j in range(1, n - 1):
            h = _folded(h[: len(ids) - j], hashes[ids[j:]])
        known = frequent(h)
        at = np.flatnonzero(there & known[:places] & known[1 : places + 1])
        key = ids[at]
        for j in range(1, n):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(index) + ids[at + j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        phrases = [b" ".join(words[p : p + n]) for p in at[first].tolist()]
    columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
    return pa.record_batch(columns, names=["lang", "phrase", "c"])


def phrase_counts(texts: DataFrame, n: int, frequent: Filter | None = None) -> DataFrame:
    """(lang, phrase, a): how often each phrase of `n` words occurs in (lang, text as bytes).

    Each phrase of a chunk of text is a row with its count there; Spark adds these by language and phrase."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches):
        held, size = {}, 0
        for part in (batch.slice(at, 100) for batch in batches for at in range(0, batch.num_rows, 100)):
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > CHUNK:
                    yield from (counted(k, v, n, shared.value) for k, v in held.items())
                    held, size = {}, 0
        yield from (counted(k, v, n, shared.value) for k, v in held.items())

    return texts.mapInArrow(rows, GRAMS).groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def collocations(df: DataFrame, least: int = 30, max_words: int = 4, cover: tuple[int, int] = (80, 100), top: int = 2000, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of each language by how much they cohere: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut in pieces at `[.,;:!?\\x0A-\\x0D]` and pieces in words at spaces and tabs. Phrases of 2 to `max_words` words within
    a piece that occur `a` >= `least` times are candidates; its worst cut in two parts, which occur l and r times, gives
    floor(scale * a / (l + r)); the earliest cut among equals. A candidate goes if a longer one that has its words in a row occurs
    cover[0] / cover[1] times as often or more: an extension by one word, as a longer one's part is at least as frequent.
    n is the number of the language's words.

    Phrases are counted length by length, over all texts: a phrase as frequent as `least` has no part that is less so, so a phrase is
    a row only if its parts of one word less pass a filter of frequent ones. The filter has 16 bits for each, up to 2 ** MOST_BITS
    (32 MiB), which is all that is broadcast or passes the driver; beyond, or where hashes meet, it lets more through, and the counts decide.
    Counts, sums and products are integers or decimals of 38 digits.

    Null text is empty; null language is `und`. Empty texts and tables have no phrases. A very long text takes memory in proportion to its
    length. Repeated rows count again. Ids aren't read; other columns are ignored, whatever their names.
    """
    ws = Workspace(df.sparkSession, "phrases")
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    words = ws.save(phrase_counts(texts, 1).where((F.col("a") >= least) | (F.col("phrase") == ALL)))
    totals = words.where(F.col("phrase") == ALL).select("lang", F.col("a").alias("n"))
    levels = [words.where(F.col("phrase") != ALL)]
    for n in range(2, max_words + 1):
        levels.append(ws.save(phrase_counts(texts, n, Filter(levels[-1])).where(F.col("a") >= least)))
    sized = [level.select("lang", "phrase", "a", F.lit(k).alias("words")) for k, level in enumerate(levels, 1)]
    frequent = sized[0]
    for level in sized[1:]:
        frequent = frequent.unionByName(level)
    part = lambda k: F.substring_index("phrase", " ", k)

    exact = lambda c: F.col(c).cast("decimal(20,0)")
    longer = frequent.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    held = frequent.where("words > 1").join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (cover[1] * exact("more") < cover[0] * exact("a"))).drop("more")

    cuts = [F.when(F.col("words") > k, F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), p.alias("part")) for side, p in enumerate((part(k), F.expr(f"substring_index(phrase, ' ', {k} - words)")))))) for k in range(1, max_words)]
    asked = ws.save(held.withColumn("c", F.explode(F.flatten(F.array_compact(F.array(*cuts))))).select("lang", "phrase", "a", "c.*"))
    uses = asked.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).join(uses, ["lang", "part"])
    met = with_summary(asked, ws.save(parts), ["lang", "part"], "uses", asked.count())
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.score", "w.l", "w.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))
    first = worst.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(16))).withColumn("rank", some).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
