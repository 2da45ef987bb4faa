"""Near duplicates: a join of MinHash signatures inverted by coordinate, confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, with_summary
from .components import connected_components

#: Words of a shingle, and coordinates of a signature.
WORDS, COORDINATES = 5, 24
#: The chance that a pair at the similarity threshold has fewer equal coordinates than asked for.
MISSED = 1e-5
#: Rows of a large group that meet in one block; every two blocks of it meet in one task.
BLOCK = 1000
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def equal_coordinates(similarity: float, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The most equal coordinates to ask for so that a pair at `similarity` falls short with a chance of `missed` at most."""
    chance, at = 0.0, 0
    while True:
        chance += comb(coordinates, at) * similarity**at * (1 - similarity) ** (coordinates - at)
        if chance > missed:
            return max(1, at)
        at += 1


class Shingles:
    """Shingle sets of texts as sorted 64-bit hashes; words' hashes are remembered up to a bound."""

    def __init__(self, words: int = WORDS, remembered: int = 200_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def of(self, text: str) -> np.ndarray:
        """Different shingles of a text: all runs of `words` words, or all of its words if they are fewer."""
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.remembered:
            self.known = {}
        known = self.known
        try:
            hashes = [known[x] for x in tokens]
        except KeyError:
            for x in tokens:
                if x not in known:
                    known[x] = xxhash.xxh3_64_intdigest(x)
            hashes = [known[x] for x in tokens]
        h = np.array(hashes, dtype=np.uint64)
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(32))) * _STEP + h[k : len(h) - width + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hashes of the shingles."""
    least = np.full(COORDINATES, 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, ((part * _FACTORS[:, None] + _TERMS[:, None]) >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32).view(np.int32)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            n, keys, signs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles.of(text or "")
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "_set", "_sign"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_shingles long, _set binary, _sign array<int>")


def inverted(reps: DataFrame, ws: Workspace, needed: int) -> DataFrame:
    """Groups (group, doc_id, size) such that every two documents with `needed` equal coordinates share a group.

    A document's coordinates are posted in order of how many documents have them, rarest first, and only as
    many that the rest couldn't make `needed` alone. Groups of the same documents are kept once.
    """
    coordinates = reps.select("doc_id", F.posexplode("_sign").alias("_at", "_value")).select("doc_id", (F.shiftleft(F.col("_at").cast("long"), 32) + (F.col("_value").cast("long") + 2**31)).alias("_key"))
    coordinates = ws.save(coordinates)
    common = coordinates.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    ranked = with_summary(coordinates, common, ["_key"], "_n", coordinates.count()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_key"))).alias("_keys")).where(F.size("_keys") >= needed)
    posts = ws.save(ranked.select("doc_id", F.explode(F.slice("_keys", 1, F.size("_keys") - needed + 1)).alias("_post")).select("doc_id", F.col("_post._key").alias("_key")))
    ws.drop(coordinates)
    member = F.xxhash64("doc_id")
    groups = posts.groupBy("_key").agg(F.count("*").alias("size"), F.sum(F.shiftrightunsigned(member, 20)).alias("_a"), F.bit_xor(member).alias("_b")).where("size > 1")
    kept = groups.groupBy("size", "_a", "_b").agg(F.min("_key").alias("_key")).select("_key", "size")
    return ws.save(with_summary(posts, kept, ["_key"], "size", posts.count()).select(F.col("_key").alias("group"), "doc_id", "size"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two different sets share, by products of membership columns; the diagonal means nothing."""
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = n > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(column, [at, at + 1024])
        x = np.zeros((len(sets), 1024), dtype=np.float32)
        x[row[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out.astype(np.int32)


def linked(sets: list[np.ndarray], needed: int, similarity: Fraction, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (of a spanning forest) between sets whose similarity is high enough, among pairs with `needed`
    equal coordinates. With `side` (0 or 1 for each), only pairs of different sides count."""
    m = len(sets)
    signs = np.stack([signature(x) for x in sets])
    equal = np.zeros((m, m), dtype=np.int8)
    for k in range(COORDINATES):
        equal += signs[:, k][:, None] == signs[:, k]
    near = np.triu(equal >= needed, 1)
    if side is not None:
        near &= side[:, None] != side
    i, j = np.nonzero(near)
    size = np.array([len(x) for x in sets])
    shared = overlaps(sets) if len(i) > 400 else None
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for k in np.argsort(-equal[i, j], kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = root(a), root(b)
        if x == y:
            continue
        both = int(shared[a, b]) if shared is not None else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both * similarity.denominator >= similarity.numerator * (size[a] + size[b] - both):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def confirmed_links(groups: DataFrame, df: DataFrame, ws: Workspace, needed: int, similarity: Fraction, id_col: str, text_col: str, words: int) -> DataFrame:
    """Links (a, b) that connect, within each group, all that similar pairs of it connect; confirmed on whole texts."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.when(n > 1, F.pmod(F.xxhash64("doc_id"), n).cast("int")).otherwise(F.lit(0))
    blocks = groups.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    blocks = blocks.select("group", "doc_id", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = ws.save(blocks)
    few = rows.count() <= BROADCAST_IDS
    joined = texts.join(F.broadcast(rows) if few else rows, "doc_id")
    key = ["group", "_i", "_j"]
    dealt = joined.repartition(*key).sortWithinPartitions(*key).select(*key, "_own", "doc_id", "text")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)

        def links(at: tuple, members: list[tuple]) -> list[tuple]:
            side = np.array([own for own, _, _ in members])
            found = linked([x for _, _, x in members], needed, similarity, None if at[1] == at[2] else side)
            return [(members[a][1], members[b][1]) for a, b in found]

        at, members, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(4).type
            out = []
            for group, i, j, own, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, i, j) != at:
                    if len(members) > 1:
                        out += links(at, members)
                    at, members = (group, i, j), []
                members.append((own, doc, shingles.of(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], id_type) for k in (0, 1)], names=["a", "b"])
        if len(members) > 1:
            out = links(at, members)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], id_type) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, similarity: Fraction = Fraction(4, 5), words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of every document in the graph that links documents of similar shingle sets.

    Words are runs of non-white characters, with A-Z lower-cased; a document's set are its different runs of
    `words` words, or its whole sequence if it has fewer. Documents are linked if the shingles they share are
    at least `similarity` of those that either has. Returns doc_id, n_shingles, component_id (the smallest id
    that can be reached, its own included) and kept (whether that is its own).

    Documents of the same set are one node from the start. Signatures of COORDINATES MinHash values give the
    candidates: an inverted index by coordinate and value, of which each document is posted under its rarest
    ones only (see inverted), and a count of equal coordinates. A pair at the threshold is missed with a chance
    of MISSED at most. Candidates are confirmed on the full sets of the whole texts. Groups of more than BLOCK
    documents are dealt in blocks, each two of which meet in one task; a task returns only links that
    connect something new to it. Nothing is capped.

    Null or empty text, or white space only: no shingles, linked with nothing. Repeated rows (same id) are
    nodes of one id: links of either hold for it. A null id is linked with nothing and its component is null
    unless another document has its set. Other columns are ignored. An empty table gives no rows.
    """
    ws = Workspace(df.sparkSession, "minhash")
    needed = equal_coordinates(float(similarity))
    rows = ws.save(signatures(df, id_col, text_col, words))
    full = rows.where("n_shingles > 0")
    member = with_summary(full, full.groupBy("_set").agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_n")), ["_set"], "_n", rows.count())
    reps = ws.save(member.where("doc_id = _rep").dropDuplicates(["_set"]).select("doc_id", "_sign"))
    groups = inverted(reps, ws, needed)
    links = ws.save(confirmed_links(groups, df, ws, needed, similarity, id_col, text_col, words))
    components = connected_components(links, ws).select(F.col("id").alias("_rep"), "component")
    placed = member.select("doc_id", "n_shingles", "_rep").join(components, "_rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "_rep").alias("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(df: DataFrame, similarity: Fraction = Fraction(4, 5), words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose documents near_duplicates() keeps; of rows of one id one stays. Rows without an id stay."""
    own = fresh(df, "_kept")
    kept = near_duplicates(df, similarity, words, id_col, text_col).where("kept").select(F.col("doc_id").alias(own)).distinct()
    rows = df.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(own), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(df.where(F.col(id_col).isNull()))
