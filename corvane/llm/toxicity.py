"""Toxicity: averaged embeddings of subwords and a linear softmax over them, trained jointly in numpy."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Buckets of hashed subwords, lengths of character n-grams, and numbers in a vector.
BUCKETS, GRAMS, WIDTH = 1 << 18, (3, 4, 5, 6), 4
#: Rounds of training, their rate, the scale of the random start, and the weight of a text labelled 1.
ROUNDS, RATE, START, POSITIVE = 25, 8.0, 0.05, 6.0
#: A bucket's step is divided by the root of its mean square over the texts plus so many times the mean of these.
DAMPED = 1e-3
#: The bound on labelled rows that training reads.
SAMPLE = 3000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(word: str) -> list[int]:
    """Buckets of the word and of the character n-grams of it, its ends marked."""
    marked = f"<{word}>"
    # of plain ASCII, slices of the bytes are the characters
    text = marked.encode() if marked.isascii() else marked
    size = len(text)
    grams = {text[i : i + n] for n in GRAMS for i in range(size - n + 1)}
    grams.add(text)
    if text is marked:
        grams = [x.encode("utf-8", "surrogatepass") for x in grams]
    digest = xxhash.xxh3_64_intdigest
    return [digest(x) % BUCKETS for x in grams]


#: Fixed values of XXH3 for short inputs without a seed: the parts of its secret that 3 and 4 to 8 bytes meet, and its multipliers.
FLIP_3, FLIP_8 = 0x39_6C_FE_B8 ^ 0xBE_4B_A4_23, 0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE
PRIME_2, PRIME_3, PRIME_MX = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25


def gram_buckets(fours: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The buckets, as XXH3 hashes them, of n-grams of 3 to 8 bytes (others' are of no use), given their first byte's place, their size and the four bytes, little-endian, at every place."""
    u = np.uint64
    first, n = fours[begin], size.astype(u)
    h = (fours[begin + np.maximum(size, 4) - 4] + (first << u(32))) ^ u(FLIP_8)
    h ^= (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))
    h *= u(PRIME_MX)
    h = (h ^ (h >> u(35)) + n) * u(PRIME_MX)
    h ^= h >> u(28)
    three = np.flatnonzero(size == 3)
    if len(three):
        f = first[three]
        g = ((f & u(255)) << u(16) | (f >> u(8) & u(255)) << u(24) | f >> u(16) & u(255) | u(3 << 8)) ^ u(FLIP_3)
        g = (g ^ g >> u(33)) * u(PRIME_2)
        g = (g ^ g >> u(29)) * u(PRIME_3)
        h[three] = g ^ g >> u(32)
    return (h % u(BUCKETS)).astype(np.int64)


def word_values(words: list[str], values: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """The mean of the values of each word's subwords(), for words of any length but 0.

    Words are laid one after the other, pieces of about `piece` characters, and all their n-grams of one length hashed together. Words with an n-gram of more than 8 bytes,
    or one that is there twice (then one of three characters is), are taken one by one."""
    out, alone = np.zeros(len(words)), []
    ends = np.cumsum([len(w) for w in words])
    cuts = np.searchsorted(ends, np.arange(piece, ends[-1], piece), "right").tolist() if words else ()
    for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
        if a == b:
            continue
        marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words[a:b]]
        data = np.frombuffer(b"".join(marked) + bytes(8), np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)[:-7]  # where characters begin, and the end of all
        fours = data.astype(np.uint64)
        fours = fours[:-3] | fours[1:-2] << np.uint64(8) | fours[2:-1] << np.uint64(16) | fours[3:] << np.uint64(24)
        size = np.array([len(w) + 2 for w in words[a:b]])
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        left = (starts + size)[owner] - np.arange(len(owner))
        total, count, odd = np.zeros(len(owner)), np.zeros(len(size), dtype=np.int64), []
        for n in GRAMS:
            k = np.flatnonzero(left >= n)
            long = at[k + n] - at[k]
            bucket = gram_buckets(fours, at[k], long)
            total[k] += values[bucket]
            count += np.maximum(size - n + 1, 0)
            odd.append(owner[k[long > 8]])
            if n == min(GRAMS):
                pairs = np.sort(owner[k] * BUCKETS + bucket)
                odd.append(pairs[1:][pairs[1:] == pairs[:-1]] // BUCKETS)
        sums = np.add.reduceat(total, starts)
        whole = np.flatnonzero(size > max(GRAMS))
        sums[whole] += values[[xxhash.xxh3_64_intdigest(marked[k]) % BUCKETS for k in whole]]
        count[whole] += 1
        out[a:b] = sums / count
        alone += (a + np.unique(np.concatenate(odd))).tolist()
    for i in alone:
        parts = sorted(subwords(words[i]))
        out[i] = values[parts].sum(dtype=float) / len(parts)
    return out


class _Sums:
    """Sums of rows by an index: out[k] is the sum of rows[source[i]], times weight[i] if there are weights, over i with
    index[i] = k. Taken in pieces that fit in a cache."""

    def __init__(self, index: np.ndarray, size: int, source: np.ndarray, weight: np.ndarray | None = None, piece: int = 100_000):
        if (index[1:] < index[:-1]).any():
            order = np.argsort(index, kind="stable").astype(np.int32)
            index, source, weight = index[order], source[order], None if weight is None else weight[order]
        self.source, self.weight, self.size = source, None if weight is None else weight[:, None], size
        self.starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]][: len(index)])
        self.at = index[self.starts]
        self.pieces = np.unique(np.searchsorted(self.starts, np.arange(0, len(index), piece)))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), dtype=np.float32)
        for i, j in zip(self.pieces, [*self.pieces[1:], len(self.starts)], strict=True):
            a, b = self.starts[i], self.starts[j] if j < len(self.starts) else len(self.source)
            moved = rows[self.source[a:b]]
            if self.weight is not None:
                moved *= self.weight[a:b]
            out[self.at[i:j]] = np.add.reduceat(moved, self.starts[i:j] - a, axis=0)
        return out


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, positive: float = POSITIVE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains on whole texts; returns what each bucket adds to the logit of label 1 in a word that has it, and the bias.

    A subword is a vector times a gain of its own, a word the mean of its subwords, a document the mean of its words, and a linear softmax of two
    classes reads it. All start at random or small and even, and descend the weighted loss of all texts together, in each round. Since
    a subword moves with the product of vector and gain, the few that tell the labels apart leave all others behind, as a
    mean over a long text needs. A bucket's step is divided by its root mean square over the texts, and all steps are halved
    when the loss rises. As means are linear, the model's logit is the mean of one number for each bucket: the
    difference of the two classes' weights, applied to the bucket's vector and gain.
    Without both labels there is nothing to learn: all numbers are 0 and the bias tells the label's share.
    """
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    number: dict[str, int] = {}
    doc, word, share = array("i"), array("i"), array("f")
    for i, text in enumerate(texts):
        bag = Counter(words_of(text))
        total = sum(bag.values())
        for w, n in bag.items():
            doc.append(i)
            word.append(number.setdefault(w, len(number)))
            share.append(n / total)
    doc, word, share = np.array(doc), np.array(word), np.array(share)
    bucket, size = array("i"), array("i")
    for w in number:
        found = subwords(w)
        bucket.extend(found)
        size.append(len(found))
    n_words = len(number)
    del number
    bucket, size = np.array(bucket), np.array(size, dtype=np.float32)[:, None]
    owner = np.repeat(np.arange(n_words, dtype=np.int32), size[:, 0].astype(np.int64))
    word_sum, bucket_sum = _Sums(owner, n_words, bucket), _Sums(bucket, BUCKETS, owner)
    doc_sum, by_doc = _Sums(doc, len(texts), word, share), _Sums(word, n_words, doc, share)
    del bucket, owner

    def to_doc(rows: np.ndarray) -> np.ndarray:
        return doc_sum(word_sum(rows) / size)

    def to_bucket(rows: np.ndarray) -> np.ndarray:
        return bucket_sum(by_doc(rows) / size)

    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, positive, 1.0)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    target = np.eye(2, dtype=np.float32)[y]
    # a bucket's mean square over the texts, from random signs: the square of a signed sum is, on average, the sum of squares
    signs = rng.choice([-1, 1], (len(y), 16)).astype(np.float32)
    square = (to_bucket(signs * np.sqrt(weight)) ** 2).mean(axis=1, keepdims=True)
    step = rate / np.sqrt(square + DAMPED * square[square > 0].mean())
    vectors, gains = START * rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32), np.full((BUCKETS, 1), START, dtype=np.float32)
    weights, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    before = np.inf
    for _ in range(rounds):
        hidden = to_doc(vectors * gains)
        logits = hidden @ weights + bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        loss = -float((weight * target * np.log(chance + 1e-12)).sum())
        step, before = step / 2 if loss > before else step, loss
        error = (chance - target) * weight
        slope = step * to_bucket(error @ weights.T)
        vectors, gains = vectors - slope * gains, gains - (slope * vectors).sum(axis=1, keepdims=True)
        weights, bias = weights - 0.3 * (hidden.T @ error), bias - 0.3 * error.sum(axis=0)
    return (vectors * gains) @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts; words' values are remembered up to a bound."""

    def __init__(self, values: np.ndarray, bias: float, remembered: int = 200_000):
        self.values, self.bias, self.remembered = values, bias, remembered
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str], piece: int = 1 << 20) -> list[float]:
        """The scores of texts, taken in pieces of about so many characters; all new words of a piece are valued together."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(words_of(text))
            size += len(text)
            if size >= piece:
                out += self._of_words(some)
                some, size = [], 0
        return out + self._of_words(some)

    def _of_words(self, texts: list[list[str]]) -> list[float]:
        if len(self.known) > self.remembered:
            self.known = {}
        known = self.known
        new = sorted({w for words in texts for w in words if w not in known})
        known.update(zip(new, word_values(new, self.values).tolist(), strict=True))
        logits = np.array([sum([known[w] for w in words]) / len(words) if words else 0.0 for words in texts]) + self.bias
        return (1 / (1 + np.exp(-np.clip(logits, -500, 500)))).tolist()


def fit(df: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The model that toxicity() describes."""
    ship(df.sparkSession)
    number = F.crc32(F.col(id_col).cast("string").cast("binary"))
    held_out = F.coalesce(number % folds == 0, F.lit(False))
    known = labels.where(~held_out & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label").dropDuplicates(["_id"]).toPandas().sort_values("_id")
    return train([x or "" for x in rows["_text"]], rows["_label"].tolist())


def without_toxic(df: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `df`, all columns, that toxicity() doesn't predict as toxic; each text is scored where it lies.

    Null and empty texts have the model's bias as their score; repeated rows and null ids stay or go by their text; an empty table
    gives no rows; columns of any name are kept as they are.
    """
    values, bias = fit(df, labels, folds, sample, id_col, text_col, label_col)
    shared, at = df.sparkSession.sparkContext.broadcast(values), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            scores = scorer.scores([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([x < 0.5 for x in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def toxicity(df: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher where label 1 is likelier) and predicted (score >= 0.5) of every whole text.

    The model learns from labelled rows whose crc32 of the id, as text, isn't 0 modulo `folds`; of these, at
    most `sample` rows are read, those with the smallest hashes of the id, whatever the tables' size. Only texts
    go into a score. The model is BUCKETS numbers, whatever was read.

    Null text counts as empty; an empty text's score is the model's bias. A very long text takes memory in proportion to its length. Rows with a null label, and labels
    without a document, aren't learned from; of several labels for an id the highest counts. Repeated rows
    each get a score. held_out of a null id is false. Other columns are ignored. An empty table gives no rows.
    """
    values, bias = fit(df, labels, folds, sample, id_col, text_col, label_col)
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            scores = scorer.scores([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    own = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return scored.select("doc_id", F.coalesce(own % folds == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
