"""Packing of documents into token sequences: dominance reduction, then best fit, on a histogram of lengths."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBPE, grouped
from .common import Workspace

#: Encoded words that a worker remembers; beyond it, it forgets all and starts again.
REMEMBERED = 500_000
#: Rows of one length that are numbered together, on average; a length of more is dealt into parts.
PART_ROWS = 1000

Bin = tuple[tuple[int, int], ...]


class WordTokenizer:
    """A tokenizer whose tokens never span white space, so that words are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = ByteBPE(path)
        self.known: dict[str, bytes] = {"": b""}
        self.marks = {x: self.library([x])[0] for x in (",", ".")}

    def library(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    @staticmethod
    def plain(word: str) -> str | None:
        """The word as the merges see it if it is letters only, in composed form, that lower-case one by one."""
        low = word.lower()
        if word.isalpha() and (word.isascii() or low.isalpha() and "\u03a3" not in word and unicodedata.is_normalized("NFC", word)):
            return low
        return None

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks: letters, with a mark of punctuation at most, by merge rounds; all others by the library."""
        known, simple, others = self.known, {}, []
        for x in chunks:
            mark = x[-1:] if x[-1:] in self.marks else ""
            low = self.plain(x[:-1] if mark else x)
            if low is None:
                others.append(x)
            else:
                simple[x] = (low, mark)
        words = list({w for w, _ in simple.values()})
        ids = dict(zip(words, self.merges.merge([w.encode() for w in words]), strict=True))
        for x, (w, mark) in simple.items():
            known[x] = ids[w] + self.marks[mark] if mark else ids[w]
        known.update(zip(others, self.library(others), strict=True))

    def encode_batch(self, texts: list[str], remembered: int = REMEMBERED) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. Fewer remembered words also mean fewer characters that are encoded together."""
        for run in grouped(texts, 8 * remembered):
            if len(self.known) > remembered:
                self.known = {"": b""}
            known = self.known
            cut = [x.replace("\n", " ").split(" ") for x in run]
            self.learn(set(chain.from_iterable(cut)).difference(known))
            for words in cut:
                yield b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `capacity` tokens; every document ends with `end_id`."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, width = load(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for i, ids in enumerate(tokenizer.encode_batch(texts, remembered)):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _largest(count: np.ndarray, most: int) -> int:
    """The largest size up to `most` of which there is an item, or 0."""
    there = np.flatnonzero(count[: max(most, 0) + 1])
    return int(there[-1]) if len(there) else 0


def _smallest(count: np.ndarray, n: int, above: int = 0) -> list[int]:
    """The n smallest items larger than `above`, or fewer if there are fewer."""
    out: list[int] = []
    for size in np.flatnonzero(count[above + 1 :])[:n] + above + 1:
        out += [int(size)] * int(min(n, count[size]))
    return out[:n]


def _best_pair(count: np.ndarray, room: int) -> int:
    """The largest sum of two items that is at most `room`, or 0."""
    best = 0
    for a in np.flatnonzero(count[: room + 1]):
        rest = count.copy()
        rest[a] -= 1
        if b := _largest(rest, min(room - int(a), int(a))):
            best = max(best, int(a) + b)
    return best


def _dominating(count: np.ndarray, size: int, capacity: int) -> Counter | None:
    """The contents of a bin with an item of `size` that dominates all others with it, if that can be told.

    A bin dominates another if the other's items can be exchanged for its own, part by part, without
    needing more room elsewhere. With `top` the largest item that fits beside `size`:
    nothing fits: the item alone; `top` fills the bin, or no two more items fit: with `top` (what else the
    other bin holds fits in top's place); at most two more fit: with `top` if no pair is larger, or with `top`
    and the largest `low` beside it if no pair has both items above `low` (then each fits in a place of these).
    """
    rest = count.copy()
    rest[size] -= 1
    room = capacity - size
    top = _largest(rest, room)
    if not top:
        return Counter([size])
    least = _smallest(rest, 3)
    if top == room or len(least) < 2 or least[0] + least[1] > room:
        return Counter([size, top])
    if len(least) < 3 or sum(least) > room:
        if top >= _best_pair(rest, room):
            return Counter([size, top])
        rest[top] -= 1
        low = _largest(rest, room - top)
        rest[top] += 1
        if low:
            above = _smallest(rest, 2, low)
            if len(above) < 2 or sum(above) > room:
                return Counter([size, top, low])
    return None


def pack_lengths(lengths: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """Bins for items of sizes 1 to `capacity`, given how many items there are of each size.

    Returns (number of bins, contents), contents as (size, number) pairs in their order in the bin. First,
    from the largest size down, bins that provably dominate all others with that item are fixed (Martello and
    Toth's reduction, sets of up to three items) and taken out of the instance. The rest goes, from
    the largest down, into the open bin with the least room that holds it. Equal items are placed
    together, so time and memory depend on the number of sizes, not on the number of items.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in lengths.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"no bin holds a size of {size}")
        count[size] += n
    bins: list[tuple[int, Bin]] = []
    for size in range(capacity, 0, -1):
        while count[size] and (inside := _dominating(count, size, capacity)):
            times = min(int(count[x]) // n for x, n in inside.items())
            for x, n in inside.items():
                count[x] -= n * times
            bins.append((times, tuple(sorted(inside.items(), reverse=True))))
    open_bins: dict[int, list[tuple[int, Bin]]] = defaultdict(list)
    for size in range(capacity, 0, -1):
        left = int(count[size])
        room = size
        while left:
            while room < capacity and not open_bins.get(room):
                room += 1
            n, inside = open_bins[room].pop() if open_bins.get(room) else (left, ())
            each = room // size
            for times, of in ((left // each, each), (1, left % each)):
                times = min(n, times)
                if times and of and left >= of:
                    open_bins[room - of * size].append((times, (*inside, (size, of))))
                    n, left = n - times, left - times * of
            if n and inside:
                open_bins[room].append((n, inside))
    return bins + [x for same in open_bins.values() for x in same]


def segments(bins: list[tuple[int, Bin]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, rank after the last, first bin, items in each bin, offset): where the items of each size go, by rank."""
    out, ranks, first = [], Counter(), 0
    for n, inside in bins:
        offset = 0
        for size, each in inside:
            out.append((size, ranks[size], ranks[size] + n * each, first, each, offset))
            ranks[size] += n * each
            offset += size * each
        first += n
    return out


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as it can.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    that is longer than a sequence is cut into full pieces and a last, shorter one; others stay whole.

    Null or empty text: the end token alone. Repeated rows are packed each on their own. Null ids are kept.
    Ties of length are broken by id, piece and checksum. Other columns are ignored; an empty table gives no rows.
    The driver sees only how many pieces there are of each length, `capacity` numbers at most, and plans on
    these; the plan is broadcast, its size bounded by `capacity` too. Rows of a length are dealt into parts of about
    PART_ROWS before they are numbered, so that one common length doesn't meet in one task. A very long text takes memory in
    proportion to its length, in one task. A worker keeps the encoded words it remembers for its next tasks; `remembered` bounds them and
    changes no result.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "packing")
    pieces = ws.save(token_pieces(df, path, capacity, id_col=id_col, text_col=text_col, remembered=remembered))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = defaultdict(list)
    for size, *place in segments(pack_lengths(lengths, capacity)):
        places[size].append(tuple(place))
    plan = spark.createDataFrame(
        [(int(size), 1 + lengths[size] // PART_ROWS, [tuple(map(int, p)) for p in sorted(of)]) for size, of in places.items()],
        "length long, _parts long, _places array<struct<first: long, upto: long, bin: long, each: long, offset: long>>",
    )
    parted = pieces.join(F.broadcast(plan.select("length", "_parts")), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_parts"))
    inside_length = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(inside_length), F.lit(0)))
    numbered = parted.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")))
    numbered = numbered.join(ws.save(counts.select("length", "_part", "_before")), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_parts")
    at = F.filter("_places", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") < p["upto"]))[0]
    inside = F.col("_rank") - F.col("_at.first")
    return numbered.join(F.broadcast(plan), "length").withColumn("_at", at).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_at.bin") + F.floor(inside / F.col("_at.each"))).alias("sequence_id"),
        (F.col("_at.offset") + inside % F.col("_at.each") * F.col("length")).alias("offset"),
    )
