"""Language-model scores: a hierarchical Pitman-Yor model whose seating is sampled shard by shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Discount and strength of the root restaurant and of context restaurants.
ROOT, CONTEXT = (0.65, 10.0), (0.85, 5.0)
#: Sweeps of the sampler before the first one that counts, and sweeps that are averaged.
BURN, AVERAGED = 2, 3
#: Nodes of the contour integral for more.
NODES = 40
#: Tokens of a block, beyond which it is closed.
BLOCK_TOKENS = 2_000_000
#: Customers of a dish up to which all numbers of tables are weighed, and up to which ways of seating are listed.
SINGLY, LISTED = 40, 1024
#: Rows for which there are four shards of the vocabulary; shards double with the rows.
SHARD_ROWS = 20_000
#: The token that ends each text; as words aren't empty, its key is no word's.
END = b""
ZSTD = pa.Codec("zstd", compression_level=3)


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_training(doc_id: object, folds: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds != 0


def log_gamma(z: np.ndarray) -> np.ndarray:
    """By Stirling's series, for z of 1 and more."""
    less, z = np.zeros(z.shape), z.copy()
    for _ in range(7):
        small = z < 8
        less -= np.where(small, np.log(z), 0)
        z = z + small
    return less + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z


@cache
def small_ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of up to LISTED customers (rows) at any number of tables (columns)."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[0, 0] = 0
    for c in range(LISTED):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, t] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + out[c, t])
    return out


def large_ways(customers: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers, for any number of customers.

    S(c, t) = c! / (t! d^t) [x^c] (1 - (1 - x)^d)^t. The coefficient is a contour integral, with x = exp(-y) of
    exp(c y) (1 - (1 - exp(-y))^d)^t along a parabola around the cut y < 0, through the saddle point or, with
    few tables, 6 / c. Its nodes give the logarithm to about five decimals (two where all but a few customers sit alone).
    """
    c, t = customers.astype(np.float64), tables.astype(np.float64)
    low, high = np.full(c.shape, -45.0), np.full(c.shape, 3.0)
    for _ in range(25):
        y = np.exp((low + high) / 2)
        few = d * np.exp(-y + (d - 1) * np.log(-np.expm1(-y))) / -np.expm1(d * np.log(-np.expm1(-y))) > c / t
        low, high = np.where(few, (low + high) / 2, low), np.where(few, high, (low + high) / 2)
    cross = np.maximum(np.exp(low), 6 / c)
    far = np.minimum(np.sqrt(40 / (c * cross * (1 - d))), 8)
    turn = 1 + 1j * (np.arange(NODES) + 0.5) / NODES * far[:, None]
    y = cross[:, None] * turn * turn
    top = c * cross + t * np.log1p(-((-np.expm1(-cross)) ** d))
    each = np.exp(c[:, None] * y + t[:, None] * np.log(1 - (-np.expm1(-y)) ** d) - top[:, None]) * turn
    return top + np.log(each.real.sum(1) * far / NODES * 2 * cross / np.pi) + log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(d)


def drawn_tables(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of t with chances proportional to S(c, t) pull^t, for large dishes.

    These chances have one peak and, as t is distributed like a sum of independent coins, a variance of at most its mean or that of c - t.
    With x as in large_ways, the peak is near t = (pull / d) (1 - (1 - x)^d) where c = pull x (1 - x)^(d - 1). Around it, six roots of that variance
    to each side, 25 values are computed and 257 interpolated by cubics.
    Up to some hundred tables these are all whole numbers, beyond, t is drawn evenly within a step.
    """

    def height(c: np.ndarray, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = t * np.log(a)
        small = c <= LISTED
        out[small] += small_ways(discount)[c[small], t[small].astype(np.int64)]
        out[~small] += large_ways(c[~small], t[~small], discount)
        return out

    low, high = np.full(len(customers), -45.0), np.full(len(customers), 4.0)
    for _ in range(40):
        y = np.exp((low + high) / 2)
        over = np.log(pull) - y + (discount - 1) * np.log(-np.expm1(-y)) > np.log(customers)
        low, high = np.where(over, (low + high) / 2, low), np.where(over, high, (low + high) / 2)
    peak = np.clip(pull / discount * (1 - (-np.expm1(-np.exp(low))) ** discount), 1, customers)
    side = 6 * np.sqrt(np.minimum(peak, customers - peak) + 1) + 8
    start, end = np.maximum(1, np.floor(peak - side)), np.minimum(customers, np.ceil(peak + side))
    step = np.maximum(1, np.ceil((end - start) / 24))
    nodes = start[:, None] + step[:, None] * np.arange(25)
    at = np.minimum(nodes, customers[:, None])
    heights = height(np.repeat(customers, 25), np.repeat(pull, 25), at.ravel()).reshape(at.shape)
    fine = np.maximum(1, np.ceil((end - start) / 256))
    points = start[:, None] + fine[:, None] * np.arange(257)
    last = np.maximum(3, np.floor((end - start) / step))  # nodes up to here are no customers' end repeated
    x = np.minimum((points - start[:, None]) / step[:, None], last[:, None] + 1)
    left = np.clip(np.floor(x).astype(np.int64) - 1, 0, (last[:, None] - 3).astype(np.int64))
    u, found = x - left, 0.0
    for k in range(4):
        weight = np.prod([(u - j) / (k - j) for j in range(4) if j != k], axis=0)
        found = found + weight * np.take_along_axis(heights, left + k, 1)
    exact = (step == 1)[:, None] & (points <= at.max(1, keepdims=True))
    found = np.where(exact, np.take_along_axis(heights, np.minimum(points - start[:, None], 24).astype(np.int64), 1), found)
    found = np.where(points > end[:, None], -np.inf, found)
    sums = np.cumsum(np.exp(found - found.max(1, keepdims=True)), axis=1)
    k = (sums < rng.random(len(sums))[:, None] * sums[:, -1:]).sum(1)
    within = np.floor(rng.random(len(sums)) * fine)
    return np.minimum(start + k * fine + within, end)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes, each drawn from its conditional distribution: t tables have chances proportional to S(c, t) pull^t.

    S are generalised Stirling numbers of the discount: the weight of all ways in which c customers of one dish take t
    tables. `pull` is what one more table weighs. Dishes of up to SINGLY customers are drawn from all numbers of tables, larger ones by drawn_tables.
    """
    tables = (customers > 0).astype(np.float64)
    order = np.argsort(customers, kind="stable")
    ways = small_ways(discount)
    logs = np.log(np.maximum(pull, 1e-300))
    for c in range(2, SINGLY + 1):
        at = order[slice(*np.searchsorted(customers, [c, c + 1], sorter=order))]
        if len(at):
            t = np.arange(1, c + 1)
            heights = ways[c, 1 : c + 1] + logs[at, None] * t
            sums = np.cumsum(np.exp(heights - heights.max(1, keepdims=True)), axis=1)
            tables[at] = 1 + (sums < rng.random(len(at))[:, None] * sums[:, -1:]).sum(1)
    large = order[np.searchsorted(customers, SINGLY + 1, sorter=order) :]
    for k in range(0, len(large), 256):
        at = large[k : k + 256]
        tables[at] = drawn_tables(customers[at], np.exp(logs[at]), discount, rng)
    return tables


class Pack:
    """Arrays as compressed bytes, and back: byte planes, of the gaps where whole numbers don't fall."""

    @staticmethod
    def put(*arrays: np.ndarray) -> bytes:
        head, planes = [len(arrays)], []
        for a in arrays:
            rising = a.dtype.kind == "u" and bool((a[1:] >= a[:-1]).all())
            head += [len(a), int(rising)]
            a = np.diff(a, prepend=a.dtype.type(0)) if rising else np.ascontiguousarray(a)
            planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        data = b"".join([np.array(head, dtype="<i8").tobytes(), *planes])
        return np.array([len(data)], dtype="<i8").tobytes() + ZSTD.compress(data, asbytes=True)

    @staticmethod
    def get(data: bytes, *kinds: str) -> list[np.ndarray]:
        data = ZSTD.decompress(data[8:], decompressed_size=int(np.frombuffer(data, "<i8", 1)[0]), asbytes=True)
        head = np.frombuffer(data, "<i8", 2 * len(kinds), 8).tolist()
        out, at = [], 8 * (2 * len(kinds) + 1)
        for n, rising, kind in zip(head[::2], head[1::2], kinds, strict=True):
            size = np.dtype(kind).itemsize
            a = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
            out.append(np.cumsum(a, dtype=kind) if rising else a)
            at += n * size
        return out


def gaps(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rising values of each group, as the gaps within the group; the first one as it is."""
    out = np.diff(values, prepend=0)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    out[first] = values[first]
    return out.astype("<u4")


def from_gaps(group: np.ndarray, out: np.ndarray) -> np.ndarray:
    group, total = group.astype(np.int64), np.cumsum(out, dtype=np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return total - np.repeat(total[first] - out[first], np.diff(np.r_[first, len(group)]))


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that follow each other with the same number in column `key`."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[key] != now:
                if rows:
                    yield now, rows
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, rows


LAYOUT = "block long, shard int, data binary, kind int"


def packets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["block", "shard", "data", "kind"])


class Block:
    """The pairs of a word and the one before it, of a run of documents, in the order of the words' shards."""

    def __init__(self, index: np.ndarray):
        """index: each token's word. A text's first token follows an end, as the last token of any text is one."""
        pairs, self.pair_of = np.unique(index.astype(np.int64) << 32 | np.roll(index, 1), return_inverse=True)
        self.word, self.before = pairs >> 32, pairs & 0xFFFFFFFF


def blocks(df: DataFrame, shards: int, folds: int, kind: str) -> DataFrame:
    """Each partition's documents in blocks: kind 0 is a block's tokens, kind 1 its words' counts for each shard."""

    def pack(part: int, block: int, docs: list, lengths: list[int], known: dict[bytes, int], raw: list[int], id_type: pa.DataType) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        index = place[np.array(raw, dtype=np.int64)]
        training = np.repeat([is_training(d, folds) for d in docs], lengths)
        hashes, shard = hashes[order], shard[order]
        count = np.bincount(index[training], minlength=len(order)).astype("<u4")
        rows = [(-1, 0, docs, Pack.put(np.array(lengths, "<i8"), index.astype("<u4")))]
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            rows.append((int(s), 1, None, Pack.put(hashes[a:b].astype("<u8"), count[a:b])))
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(id_type)), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())],
            names=["block", "shard", "docs", "data", "kind"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        docs, lengths, known, raw = [], [], {END: 0}, []
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens_of(text or "")
                put = known.setdefault
                raw.extend([put(w, len(known)) for w in words])
                raw.append(0)
                docs.append(doc)
                lengths.append(len(words) + 1)
                if len(raw) >= BLOCK_TOKENS:
                    yield pack(part, block, docs, lengths, known, raw, batch.column(0).type)
                    docs, lengths, known, raw, block = [], [], {END: 0}, [], block + 1
        if docs:
            yield pack(part, block, docs, lengths, known, raw, batch.column(0).type)

    return df.mapInArrow(run, f"block long, shard int, docs array<{kind}>, data binary, kind int")


def summed(data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The counts of a shard's words, in the order of their hashes, and the numbers of each packet's words."""
    parts = [Pack.get(x, "<u8", "<u4") for x in data]
    _, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(of, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    return count, np.split(of, np.cumsum([len(p[0]) for p in parts])[:-1])


def numbered(words: DataFrame) -> DataFrame:
    """For each block the numbers, within the shard, and counts of its words (kind 2), and each shard's sums (kind 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, 1):
            count, numbers = summed([r[2] for r in rows])
            found = [(r[0], shard, Pack.put(x.astype("<u4"), count[x].astype("<i8")), 2) for r, x in zip(rows, numbers, strict=True)]
            yield packets([*found, (-1, shard, np.array([count.sum(), np.count_nonzero(count)], "<f8").tobytes(), 4)])

    return words.select("block", "shard", "data").repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, LAYOUT)


def paired(rows: DataFrame, folds: int) -> DataFrame:
    """Each block's pairs for the shards of their words (kind 5), from its tokens and its words' numbers and counts.

    A context has a name, its shard and its number in there, and comes with its count: as a text's first token
    follows an end, each training token is before one other, so a word's count is its restaurant's customers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (tokens, *answers) in runs(batches, 0):
            lengths, index = Pack.get(tokens[3], "<i8", "<u4")
            found = [Pack.get(r[3], "<u4", "<i8") for r in answers]
            number, count = (np.concatenate(x) for x in zip(*found, strict=True))
            first = np.cumsum([0, *(len(x) for x, _ in found)])
            name = np.repeat(np.array([r[1] for r in answers], dtype=np.uint64), np.diff(first)) << np.uint64(32) | number
            ours = Block(index)
            training = np.repeat([is_training(d, folds) for d in tokens[2]], lengths)
            times = np.bincount(ours.pair_of, weights=training, minlength=len(ours.word)).astype("<u4")
            made = []
            for r, a, b in zip(answers, first, first[1:], strict=False):
                c, d = np.searchsorted(ours.word, [a, b])
                contexts, of = np.unique(ours.before[c:d], return_inverse=True)
                made.append((block, r[1], Pack.put(number[a:b], name[contexts].astype("<u8"), count[contexts], (ours.word[c:d] - a).astype("<u4"), gaps(ours.word[c:d], of), times[c:d]), 5))
            yield packets(made)

    dealt = rows.select("block", "shard", "docs", "data").repartition("block").sortWithinPartitions("block", "shard")
    return dealt.mapInArrow(run, LAYOUT)


def sample_shard(parts: list[list[np.ndarray]], tokens: int, vocabulary: int, seed: int) -> tuple[list[bytes], np.ndarray, list[np.ndarray], np.ndarray]:
    """Seats all customers of one shard's words; returns each part's answers, the names of contexts, their tables
    here, and the shard's sums, all of these for each sweep that is averaged. Words, contexts and pairs are taken in the order of their names, and
    the seed is the shard's: what comes out doesn't depend on how documents were dealt.

    A word's counts in all contexts are here, so the tables of a context restaurant are customers of the same
    word in the root. What a restaurant has in all shards is taken as its share here, carried on by its known
    number of customers.

    A sweep is one of a blocked Gibbs sampler. The weight of T tables in a restaurant, d^T Gamma(strength / d + T), is that of a gamma variable
    to the power T, averaged; given this variable, what a table weighs is fixed and the dishes of a restaurant are independent (see seat).
    So each restaurant draws its gamma variable, the root then its tables, then the root's probabilities of the words
    from gamma variables of their customers less discounts, and given these the contexts draw their tables. What the root has for new tables is spread by
    its mean, evenly over the words.
    """
    rng = np.random.default_rng(seed)
    n_words = 1 + max(int(p[0].max()) for p in parts)
    names, named = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    totals = np.zeros(len(names))
    totals[named] = np.concatenate([p[2] for p in parts])
    at = np.cumsum([0, *(len(p[1]) for p in parts)])
    pair = np.concatenate([p[0][p[3]].astype(np.int64) * len(names) + named[a : a + len(p[1])][from_gaps(p[3], p[4])] for p, a in zip(parts, at, strict=False)])
    pairs, pair_of = np.unique(pair, return_inverse=True)
    del pair
    pair_count = np.bincount(pair_of, weights=np.concatenate([p[5] for p in parts])).astype(np.int64)
    word, context = pairs // len(names), pairs % len(names)
    count = np.bincount(word, weights=pair_count, minlength=n_words).astype(np.int64)
    here = np.bincount(context, weights=pair_count, minlength=len(names))
    scale = np.divide(totals, here, out=np.ones(len(names)), where=here > 0)
    whole = tokens / max(1, count.sum())

    (d0, s0), (d1, s1) = ROOT, CONTEXT
    base = 1 / (vocabulary + 1)
    tables = (pair_count > 0).astype(np.float64)
    root_tables = (count > 0).astype(np.float64)
    kept, inner, sums = [], [], []
    for sweep in range(BURN + AVERAGED):
        customers = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
        opening = d0 * rng.gamma(s0 / d0 + root_tables.sum() * whole)
        root_tables = seat(customers, np.full(n_words, opening * base), d0, rng)
        held, free = rng.gamma(customers - d0 * root_tables), rng.gamma(s0 + d0 * root_tables.sum() * whole)
        chance = (held + free * base) / (held.sum() * whole + free)
        inside = np.bincount(context, weights=tables, minlength=len(names))
        if sweep >= BURN:
            kept.append((customers.astype("<u4"), root_tables.astype("<u4"), tables.astype("<u4")))
            inner.append(inside.astype("<u4"))
            sums += [customers.sum(), root_tables.sum()]
        openings = d1 * rng.gamma(s1 / d1 + inside * scale)
        tables = seat(pair_count, openings[context] * chance[word], d1, rng)
    ends = np.cumsum([0, *(len(p[3]) for p in parts)])
    out = []
    for p, a in zip(parts, ends, strict=False):
        own = pair_of[a : a + len(p[3])]
        out.append(Pack.put(pair_count[own].astype("<u4"), *(x for c, r, t in kept for x in (c[p[0]], r[p[0]], t[own]))))
    return out, names, inner, np.array(sums, dtype=np.float64)


def seated(pairs: DataFrame, tokens: int, vocabulary: int) -> DataFrame:
    """Answers (kind 3) to each block's packets, each shard's sums (kind 4), and its contexts' tables for the contexts' shards (kind 6)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, 1):
            parts = [Pack.get(r[2], "<u4", "<u8", "<i8", "<u4", "<u4", "<u4") for r in rows]
            found, names, tables, sums = sample_shard(parts, tokens, vocabulary, shard)
            made = [(r[0], shard, x, 3) for r, x in zip(rows, found, strict=True)] + [(-1, shard, sums.astype("<f8").tobytes(), 4)]
            homes = (names >> np.uint64(32)).astype(np.int64)
            for home in np.unique(homes):
                a, b = np.searchsorted(homes, [home, home + 1])
                made.append((-1, int(home), Pack.put((names[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), *(x[a:b] for x in tables)), 6))
            yield packets(made)

    return pairs.select("block", "shard", "data").repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, LAYOUT)


def told(rows: DataFrame) -> DataFrame:
    """For each block the counts of its words and their restaurants' tables in all shards (kind 7)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, 1):
            given = [r for r in rows if r[0] >= 0]
            count, numbers = summed([r[2] for r in given])
            tables = np.zeros((AVERAGED, len(count)), dtype=np.int64)
            for r in rows:
                if r[0] < 0:
                    number, *n = Pack.get(r[2], "<u4", *["<u4"] * AVERAGED)
                    tables[:, number] += n
            yield packets([(r[0], shard, Pack.put(count[x].astype("<i8"), *tables[:, x].astype("<i8")), 7) for r, x in zip(given, numbers, strict=True)])

    return rows.select("block", "shard", "data").repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, LAYOUT)


def scored(rows: DataFrame, tokens: int, vocabulary: int, sums: np.ndarray, folds: int, kind: str) -> DataFrame:
    (d0, s0), (d1, s1) = ROOT, CONTEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def score(docs: list, tokens_data: bytes, seats: list[bytes], words: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
            lengths, index = Pack.get(tokens_data, "<i8", "<u4")
            times, *seating = (np.concatenate(x) for x in zip(*(Pack.get(a, *["<u4"] * (1 + 3 * AVERAGED)) for a in seats), strict=True))
            count, *tables = (np.concatenate(x) for x in zip(*(Pack.get(a, *["<i8"] * (1 + AVERAGED)) for a in words), strict=True))
            ours = Block(index)
            seen = count > 0
            base = 1 / (vocabulary + 1)
            total = np.zeros(len(ours.word))
            for k in range(AVERAGED):
                root, opened, pair = seating[3 * k : 3 * k + 3]
                chance = (root - d0 * opened + (s0 + d0 * sums[2 * k + 1]) * base) / (sums[2 * k] + s0)
                total += (times - d1 * pair + (s1 + d1 * tables[k][ours.before]) * chance[ours.word]) / (count[ours.before] + s1)
            each = np.log10(total / AVERAGED)[ours.pair_of]
            plain = np.log10((count + 0.1) / (tokens + 0.1 * (vocabulary + 1)))[index]
            starts = np.cumsum(lengths) - lengths
            made = [lengths, np.add.reduceat(seen[index].astype(np.int64), starts), np.full(len(docs), tokens, dtype=np.int64), np.add.reduceat(plain, starts), np.add.reduceat(each, starts)]
            held = [not is_training(d, folds) for d in docs]
            return pa.RecordBatch.from_arrays([pa.array(docs, id_type), pa.array(held), *map(pa.array, made)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        id_type = None

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(2).type.value_type
                yield batch

        for _, rows in runs(kept(batches), 0):
            yield score(rows[0][2], rows[0][3], [r[3] for r in rows if r[4] == 3], [r[3] for r in rows if r[4] == 7], id_type)

    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "shard").select("block", "shard", "docs", "data", "kind")
    return dealt.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_scores(df: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of all whole texts under a hierarchical Pitman-Yor model of the texts in training.

    Training texts are those whose crc32 of the id, as text, isn't 0 modulo `folds`. Tokens are words, A-Z
    lower-cased, then one end. Every word, and the end, opens a restaurant for the tokens that follow it; all
    these share one parent, the root. In each sweep of a Gibbs sampler every dish's tables are drawn again (see sample_shard),
    first in the root, then in the contexts; the predictive probabilities of AVERAGED sweeps are averaged. Words not in
    training are one class, as in base_score, and the root's base measure is even over the words and this class. Scores depend on the texts and ids alone: shards are as many as the rows ask for, and a shard
    goes through its words in the order of their hashes.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (see the contract) and score.

    Null or empty text: the end alone. Repeated rows count each and get the same score. A null id is in
    training. Other columns are ignored. An empty table gives no rows. Without training tokens the score is
    that of the base measure.

    Documents stay in blocks. A block sends each shard of the vocabulary its words' counts and gets their numbers
    and total counts; then it sends its pairs by the shard of the second word, where they are seated; the
    contexts' tables are summed in the shards of the contexts. A word that is in all texts is one entry in each
    block. The driver sees sums alone.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "pitman-yor")
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = 4
    rows = slim.count()
    while shards * SHARD_ROWS < 4 * rows:
        shards *= 2
    made = ws.save(blocks(slim, shards, folds, kind), by="kind")

    def sums_of(frame: DataFrame, n: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    total += np.frombuffer(data, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], names=["k", "x"])

        found = frame.where("kind = 4").select("data").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x")).collect()
        out = np.zeros(n)
        for k, x in found:
            out[k] = x
        return out

    def with_docs(frame: DataFrame, k: int) -> DataFrame:
        return frame.where(F.col("kind") == k).select("block", "shard", F.lit(None).cast(f"array<{kind}>").alias("docs"), "data", "kind")

    texts, words = made.where("kind = 0").select("block", "shard", "docs", "data", "kind"), made.where("kind = 1")
    numbers = ws.save(numbered(words), by="kind")
    tokens, vocabulary = (int(x) for x in sums_of(numbers, 2))
    answers = ws.save(seated(paired(texts.unionByName(with_docs(numbers, 2)), folds), tokens, vocabulary), by="kind")
    sums = sums_of(answers, 2 * AVERAGED)
    counts = told(words.select("block", "shard", "data").unionByName(answers.where("kind = 6").select("block", "shard", "data")))
    return scored(texts.unionByName(with_docs(answers, 3)).unionByName(with_docs(counts, 7)), tokens, vocabulary, sums, folds, kind)
