"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: The modulus 2^31 - 1 and two bases below it.
MODULUS = (1 << 31) - 1
BASES = (1_103_515_249, 1_812_433_253)
#: Code points of the spans that a sketch samples, and how many spans it keeps.
SPAN, KEPT = 10, 128
#: Bits of a sampled span's hash.
BITS = 32

_P, _31 = np.uint64(MODULUS), np.uint64(31)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for 64-bit x."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class Powers:
    """Powers of a base and of its inverse, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, MODULUS)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, reduced(self.up * np.uint64(pow(self.base, size, MODULUS)))])
            self.down = np.concatenate([self.down, reduced(self.down * np.uint64(pow(self.inverse, size, MODULUS)))])
        return self.up, self.down


_POWERS = [Powers(b) for b in BASES]


class PrefixHashes:
    """A text's prefix arrays: entry i is the sum of (code point + 1) * base^k over k < i, modulo 2^31 - 1, for each base.

    Any span's hash is a difference of two entries, shifted to a common power.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []
        for powers in _POWERS:
            up, _ = powers.upto(self.n + 1)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), reduced(np.cumsum(reduced(points * up[: self.n])))]))

    def whole(self) -> tuple[int, ...]:
        return tuple(int(p[-1]) for p in self.prefix)

    def same(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether the spans of `length` at i here and at j there are equal, but for a chance of about 2^-62 a pair."""
        for powers, a, b in zip(_POWERS, self.prefix, other.prefix, strict=True):
            up, _ = powers.upto(max(i, j) + 1)
            x = (int(a[i + length]) - int(a[i])) * int(up[j])
            y = (int(b[j + length]) - int(b[j])) * int(up[i])
            if (x - y) % MODULUS:
                return False
        return True

    def common(self, i: int, other: PrefixHashes, j: int) -> int:
        """The length of the longest common extension from i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low

    def spans(self, width: int = SPAN) -> np.ndarray:
        """The hash of every span of `width` code points (of the whole text if it is shorter), as numbers of BITS bits in mixed order."""
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        width = min(width, self.n)
        p = self.prefix[0]
        _, down = _POWERS[0].upto(self.n + 1)
        value = reduced(reduced(p[width:] + _P - p[:-width]) * down[: self.n - width + 1])
        value = value * np.uint64(0x9E3779B97F4A7C15)
        return ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.uint32)

    def sketch(self) -> np.ndarray:
        """The KEPT smallest different values of spans()."""
        values = self.spans()
        if len(values) > 4 * KEPT:
            least = np.unique(np.partition(values, 3 * KEPT)[: 3 * KEPT])
            if len(least) >= KEPT:
                return least[:KEPT]
        return np.unique(values)[:KEPT]


class Fingerprint:
    """A text's length and hash, and a sketch of its spans."""

    def __init__(self, text: str):
        self.hashes = PrefixHashes(text)
        self.sketch = self.hashes.sketch()

    def __str__(self) -> str:
        """Length and hash, then the sketch, as hexadecimal numbers of 8 digits."""
        return "".join(f"{x:08x}" for x in (self.hashes.n, *self.hashes.whole())) + ":" + self.sketch.astype(">u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """The share of spans that both texts have, of all that either has, as the sketches tell; 1 for two empty texts."""
        a, b = self.sketch, other.sketch
        if not len(a) and not len(b):
            return 1.0
        both = np.sort(np.concatenate([a, b]))
        twice = both[1:] == both[:-1]
        distinct = np.r_[True, ~twice]
        order = np.cumsum(distinct)
        seen = min(KEPT, int(order[-1]))
        return float(np.count_nonzero(twice & (order[1:] <= seen))) / seen


def edited_text(text: str, following: str) -> str:
    """`text` with its last half, rounded down, replaced by the first as many code points (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("shared_with_edited", "long")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def compared(text: str, own: Fingerprint, following: str, next_print: Fingerprint) -> tuple:
    edited = edited_text(text, following)
    print_ = Fingerprint(edited)
    return (own.hashes.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(print_), own.likeness(print_), own.likeness(next_print), own.hashes.common(0, print_.hashes, 0))


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], _ARROW[kind]) for k, (_, kind) in enumerate(FIELDS)]


def range_starts(ids: DataFrame, n: int) -> list:
    """The first id of each of at most `n` ranges of near equal numbers of rows; a null comes first."""
    (name,) = ids.columns
    dealt = ids.repartitionByRange(n, name).groupBy(F.spark_partition_id().alias("_part"))
    found = dealt.agg(F.min(F.struct(F.col(name).isNotNull().alias("_there"), F.col(name).alias("_id"))).alias("_first")).collect()
    return sorted((r["_first"]["_id"] for r in found), key=lambda x: (x is not None, 0 if x is None else x))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every whole text and of its edited text (see edited_text), and their likeness.

    The next document is the next in order of id; after the last comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and shared_with_edited: the
    length of the longest prefix that the text and its edited text share.

    Null text counts as empty, with a likeness of 1 to another empty text and 0 to others. A very long text takes
    memory in proportion to its length, in one task. A null id comes
    first. Repeated rows each count as a document of their own; rows of one id are in order of their
    text's hash. A table of one row is its own next. Other columns are ignored; an empty table gives no rows.

    Ranges of ids are bounded first, from the ids alone. Then every text is moved once, to the task of its range; the texts
    of a range's first id are sent to the range before it too, so that no task needs another's result and nothing is saved.
    The driver and the tasks see one id for each range.
    """
    spark = ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{n} {t}" for n, t in FIELDS)
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    starts = range_starts(slim.select("doc_id"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, first = max(1, len(starts)), int(starts[:1] == [None])

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array) -> pa.Array:
        """The range of each id, and the one before it where the id is its range's first."""
        found = [0 if x is None else max(0, bisect_right(starts, x, first) - 1) for x in ids.to_pylist()]
        return pa.array([[k, (k - 1) % n] if starts[k] == x else [k] for k, x in zip(found, ids.to_pylist(), strict=True)], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, over = None, 0
        for batch in batches:
            ids, rows = [], []
            for ahead, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if over:
                    break
                text, over = text or "", ahead
                own = Fingerprint(text)
                if before is not None:
                    ids.append(before[0])
                    rows.append(compared(before[1], before[2], text, own))
                before = (i, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(1).type), *_columns(rows)], names=["doc_id", *(x for x, _ in FIELDS)])

    placed = slim.withColumn("_ranges", ranges_of("doc_id")).select("doc_id", "text", F.posexplode("_ranges").alias("_ahead", "_range"))
    dealt = placed.repartitionById(n, "_range").withColumn("_hash", F.xxhash64("text")).sortWithinPartitions("_ahead", "doc_id", "_hash")
    return dealt.select("_ahead", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")
