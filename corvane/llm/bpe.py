"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how byte-level BPE of this family cuts a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space side by side: only then may cutting at spaces and line ends differ from cutting by WORDS.
UNEVEN = re.compile(r"\s\s")
NEVER = np.iinfo(np.int64).max
#: Encoded words that a worker remembers; beyond it, it forgets all and starts again.
REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies: itself, or else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class ByteBPE:
    """A vocabulary with its merges as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters, suffix = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.ranks = size, key[order], order.astype(np.int64)
        byte = np.arange(256)
        self.byte_ranks, self.last_ranks = (self.rank_of((self.first[byte[:, None]] * size + x).ravel()) for x in (self.first, self.last))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        back = {x: b for b, x in enumerate(letters)}
        self.bytes_of = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.known: dict[str, bytes] = {}

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pair keys, found by binary search; NEVER for a pair that doesn't merge."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit numbers. All symbols lie in one flat array; in each round, every word merges all
        places of its lowest-ranked pair, and words without a pair to merge leave the array. Only pairs
        that a merge has changed are searched for again."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
        symbols, rank = self.first[raw], np.full(len(raw), NEVER)
        rank[:-1] = self.byte_ranks[raw[:-1] * 256 + raw[1:]]
        ends = np.cumsum(lengths)
        last, before = ends[lengths > 0] - 1, ends[lengths > 1] - 2
        symbols[last], rank[last] = self.last[raw[last]], NEVER  # a word's last symbol has no pair
        rank[before] = self.last_ranks[raw[before] * 256 + raw[before + 1]]
        live, lengths = np.flatnonzero(lengths), lengths[lengths > 0]
        ended_symbols, ended_words = [], []
        while len(symbols):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():
                gone = np.repeat(over, lengths)
                ended_symbols.append(symbols[gone])
                ended_words.append(np.repeat(live[over], lengths[over]))
                symbols, rank = symbols[~gone], rank[~gone]
                live, lengths, best = live[~over], lengths[~over], best[~over]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            place = np.flatnonzero(rank == best[owner])
            # of overlapping places (aaa), the first, third, ... merge
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(place) != 1], place, 0))
            place = place[(place - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            last = rank[place + 1] == NEVER
            last &= np.r_[starts[1:], len(symbols)][owner[place]] == place + 2
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            lengths = lengths - np.bincount(owner[place], minlength=len(lengths))
            moved = place - np.arange(len(place))  # where the merged symbols are now
            symbols, rank = symbols[keep], rank[keep]
            starts = np.cumsum(lengths) - lengths
            is_start = np.zeros(len(symbols) + 1, dtype=bool)
            is_start[starts] = is_start[-1] = True
            rank[moved[last]] = NEVER
            right = moved[~last]
            left = moved[~is_start[moved]] - 1
            for x in (right, left):
                rank[x] = self.rank_of(symbols[x] * self.size + symbols[x + 1])
        symbols, word = np.concatenate(ended_symbols), np.concatenate(ended_words)
        flat = symbols[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def words(chunk: str) -> list[str]:
        """The words of one chunk; most are letters with a mark of punctuation at most, which needs no pattern."""
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isalpha():
            return [chunk]
        if bare[-1:] in ",." and bare[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return WORDS.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not known yet. What was known is forgotten first if it is too much."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        cut = {x: self.words(x) for x in chunks if x not in known}
        fresh = list({w for ws in cut.values() for w in ws})
        ids = dict(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
        for x, ws in cut.items():
            known[x] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces whose encodings may be put together: cut before each space, and around each line end."""
        if not text:
            return []
        if UNEVEN.search(text):
            return WORDS.findall(text)
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + x for x in rest]
            out.append("\n")
        out.pop()
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. The strings of special tokens in a text
        become their ids, as the library does unless told otherwise. Words new to a run of texts are merged together."""
        for run in grouped(texts):
            cut = [[(x, None) if x in self.special else ("", self.chunks(x)) for x in self.cut.split(t)] if self.cut and any(x in t for x in self.special) else [("", self.chunks(t))] for t in run]
            self.learn(set(chain.from_iterable(c for parts in cut for x, c in parts if c)))
            for parts in cut:
                yield b"".join(self.special[x].to_bytes(4, "little") if c is None else b"".join(map(self.known.__getitem__, c)) for x, c in parts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def grouped(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that many words are merged together; a longer text is alone."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes them again: doc_id, n_tokens, ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256, and with `with_ids` the ids.

    Null text counts as empty: no ids. Each row gives one row, repeated ones too; a null id stays null.
    Other columns are ignored. An empty table gives no rows. `path` is the vocabulary's JSON file, which
    must be readable on the executors. No shuffle; a worker holds one batch of rows and its word cache.
    """
    import pyspark.sql.functions as F

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        names = list(map(str, range(bpe.size)))
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            n, coded, decoded, kept = [], [], [], []
            for packed in bpe.encode_batch(texts):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
