import hashlib
import itertools
import json
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import fingerprints as fp
from corvane.llm import minhash, packing, pitman_yor, quality, toxicity
from corvane.llm.bpe import bpe_digests, load
from corvane.llm.exact_dedup import keep_first, radix_groups
from corvane.llm.common import with_summary
from corvane.llm.line_dedup import line_dedup, repeated_runs, suffix_array
from corvane.llm.sharding import balanced_shards

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text)


def test_radix_groups_match_brute_force(odd, empty):
    groups = {}
    for i, t in rows_of(odd):
        groups.setdefault(bare(t), []).append((-len(t), i is None, i))
    want = Counter()
    for t, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, i in members:
            want[(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in radix_groups(odd).collect()) == want
    assert radix_groups(empty).collect() == []
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    ids = [i for i, _ in rows_of(kept) if i is not None]
    assert len(ids) == len(set(ids)) == len({bare(t) for i, t in rows_of(odd) if i is not None})


def test_shards_are_contiguous_and_even(odd, empty):
    out = sorted(balanced_shards(odd, 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert len(out) == odd.count()
    assert [r["doc_id"] is not None for r in out] == sorted(r["doc_id"] is not None for r in out)
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert ids == sorted(ids)
    total, most = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s, part in itertools.groupby(out, lambda r: r["shard"]):
        part = list(part)
        assert [r["slot"] for r in part] == list(range(len(part))) and 0 <= s < 4
        assert abs(sum(r["size"] for r in part) - total / 4) <= 2 * most
    texts = Counter((len(t.encode()) + 8, zlib.crc32(t.encode())) for _, t in rows_of(odd))
    assert Counter((r["size"], r["text_crc32"]) for r in out) == texts
    assert balanced_shards(empty, 4).collect() == []


def test_bpe_equals_the_library(odd, empty):
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, x in rows_of(odd):
        ids = t.encode(x, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_digests(odd, BYTE).collect()) == want
    assert bpe_digests(empty, BYTE).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_encoders_on_random_text(seed):
    rng = np.random.default_rng(seed)
    marks = list("ab c  \n\t'sdtre12!?|#é\x85\x1c​　ñßÄ中文́€😀²Ⅷ﻿_ΣİI-") + ["   ", "\r\n", "<|endoftext|>", "'ll", "aaaa"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(1500)]
    for path, ours in ((BYTE, load(BYTE)), (WORD, packing.load(WORD))):
        t = Tokenizer.from_file(path)
        for x, found in zip(texts, ours.encode_batch(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing_places_every_piece(odd, empty):
    t = Tokenizer.from_file(WORD)
    want = Counter()
    for i, x in rows_of(odd):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    out = packing.pack_documents(odd, WORD, 64).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(empty, WORD, 64).collect() == []


def best_packing(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[k]}):
            rest = list(rooms)
            rest.remove(r)
            place(k + 1, [*rest, r - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(4))
def test_reduction_never_loses_the_optimum(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        sizes = sorted(rng.integers(1, 21, rng.integers(0, 9)).tolist(), reverse=True)
        bins = packing.pack_lengths(Counter(sizes), 20)
        got = Counter()
        for n, inside in bins:
            assert sum(s * k for s, k in inside) <= 20
            for s, k in inside:
                got[s] += n * k
        assert got == Counter(sizes)
        optimum = best_packing(sizes, 20) if sizes else 0
        assert optimum <= sum(n for n, _ in bins) <= optimum + 1
        # bins that the reduction fixes leave an instance whose optimum is smaller by as many
        count = np.bincount(sizes, minlength=21) if sizes else np.zeros(21, dtype=int)
        for size in sorted(set(sizes), reverse=True):
            if inside := packing._dominating(count.copy(), size, 20):
                rest = list((Counter(sizes) - inside).elements())
                assert best_packing(sorted(rest, reverse=True), 20) + 1 == optimum if rest else optimum == 1


def test_prefix_hashes_and_extensions():
    a, b = fp.PrefixHashes("abcabcabd"), fp.PrefixHashes("xxabcabe")
    assert a.same(0, b, 2, 5) and not a.same(0, b, 2, 6)
    assert a.common(0, b, 2) == 5 and a.common(3, b, 5) == 2 and a.common(9, b, 0) == 0
    assert fp.Fingerprint("").likeness(fp.Fingerprint("")) == 1 and fp.Fingerprint("").likeness(fp.Fingerprint("a")) == 0


def test_fingerprints(odd, empty):
    docs = sorted(((i, t) for i, t in rows_of(odd)), key=lambda r: (r[0] is not None, r[0] or 0))
    out = fp.fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in docs)
    prints = {}
    for r in out:
        if r["doc_id"] not in (None, 5, 4):
            k = next(k for k, d in enumerate(docs) if d[0] == r["doc_id"])
            text, following = docs[k][1], docs[(k + 1) % len(docs)][1]
            if docs[(k + 1) % len(docs)][0] is not None:
                edited = fp.edited_text(text, following)
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert r["edited_fingerprint"] == str(fp.Fingerprint(edited))
            assert r["fingerprint"] == str(fp.Fingerprint(text)) and r["n_chars"] == len(text)
            prints.setdefault(r["fingerprint"], set()).add(text)
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert fp.fingerprints(empty).collect() == []
    alone = fp.fingerprints(odd.where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(docs, similarity):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and len(a & b) * similarity.denominator >= similarity.numerator * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i, _ in docs}


def test_near_duplicates(spark, odd, empty, words):
    rng = np.random.default_rng(2)
    docs = [(i, t) for i, t in rows_of(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))]
    for family in range(6):
        base = rng.choice(words, 120)
        for k in range(12):
            w = base.copy()
            for at in rng.choice(120, k % 4, replace=False):
                w[at] = "new" + str(rng.integers(10**6))
            docs.append((100 + 20 * family + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for similarity in (Fraction(85, 100), Fraction(4, 5)):
        want = brute_components(docs, similarity)
        out = {r["doc_id"]: r for r in minhash.near_duplicates(df, similarity).collect()}
        assert {i: r["component_id"] for i, r in out.items()} == want
        assert all(out[i]["n_shingles"] == len(shingles(t)) and out[i]["kept"] == (want[i] == i) for i, t in docs)
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.one_of_each(odd).columns == odd.columns


def test_blocks_of_a_large_group(spark, words, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.choice(words, 150)
    docs = []
    for k in range(60):
        w = base.copy()
        w[rng.choice(150, 3, replace=False)] = [f"u{k}a", f"u{k}b", f"u{k}c"]
        docs.append((k, " ".join(w)))
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Fraction(85, 100))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == brute_components(docs, Fraction(85, 100))


def test_overlaps():
    sets = [np.unique(np.random.default_rng(k).integers(0, 60, 40)).astype(np.uint64) for k in range(9)]
    found = minhash.overlaps(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.permutations(range(9), 2))


def labelled(spark, words, n=300):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(40))] = "grobian" + str(rng.choice(["en", "isch", "s", "o", "erei"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    docs += [(n, None), (n + 1, ""), (n + 2, "grobiantum " * 3)]
    labels += [(n + 7, 1, None), (n + 1, None, 0), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_learns_stems(spark, words, odd, empty):
    docs, labels = labelled(spark, words)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [r for i, r in out.items() if i < 300 and r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert out[302]["predicted"] == 1 and out[300]["score"] == out[301]["score"]
    assert toxicity.toxicity(empty, labels).collect() == [] and toxicity.toxicity(odd, labels.where("false")).count() == odd.count()
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_language_scores(spark, words, odd, empty):
    docs, _ = labelled(spark, words)
    out = {r["doc_id"]: r for r in pitman_yor.language_scores(docs).collect()}
    tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in docs.collect()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        assert out[i]["n_tokens"] == len(ws) and out[i]["n_known"] == sum(count[w] > 0 for w in ws) and out[i]["train_tokens"] == n
        assert out[i]["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    assert pitman_yor.language_scores(odd).count() == odd.count() and pitman_yor.language_scores(empty).collect() == []


def test_rare_words_are_contexts(spark):
    """Words of 0.05 % of the tokens, each always followed by the same one: only a bigram model foresees them."""
    names = [f"w{k}" for k in range(2000)]
    docs = [(i, " ".join(names[(97 * i + k) % 2000] for k in range(400))) for i in range(60)]
    out = pitman_yor.language_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert all(r["base_score"] < -3 * r["n_tokens"] for r in out)
    assert all(r["score"] > -0.5 * r["n_tokens"] for r in out)


def ways(customers, discount):
    """Weights of all ways to seat customers of one dish one after another, by their number of tables."""
    found = {1: Fraction(1)}
    for seated in range(1, customers):
        more = Counter()
        for t, w in found.items():
            more[t + 1] += w
            more[t] += w * (seated - t * discount)
        found = more
    return found


@pytest.mark.parametrize("customers, pull", [(2, 0.5), (3, 0.5), (20, 0.5), (20, 30.0), (60, 0.2), (60, 40.0), (60, 2000.0), (700, 0.5), (700, 90.0), (700, 20000.0)])
def test_tables_are_drawn_from_their_conditional(customers, pull):
    """Also for dishes of more customers than the listed ones, whose weights come from the integral."""
    discount, n = Fraction(1, 2), 6000 if customers < 100 else 1500
    weights = {t: w * Fraction(pull) ** t for t, w in ways(customers, discount).items()}
    total = sum(weights.values())
    chance = {t: float(w / total) for t, w in weights.items()}
    mean = sum(t * p for t, p in chance.items())
    spread = sum((t - mean) ** 2 * p for t, p in chance.items()) ** 0.5
    tables = pitman_yor.seat(np.full(n, customers), np.full(n, pull), 0.5, np.random.default_rng(1))
    assert tables.min() >= 1 and tables.max() <= customers
    assert abs(tables.mean() - mean) < 4.5 * spread / n**0.5 + 1e-9
    assert tables.std() == pytest.approx(spread, rel=0.1)
    for t, p in chance.items():
        assert abs((tables == t).mean() - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2 / n


def test_seating_of_no_customers():
    assert pitman_yor.seat(np.array([0, 1, 0, 1]), np.full(4, 0.5), 0.5, np.random.default_rng(0)).tolist() == [0, 1, 0, 1]


def test_unknown_words_score_low(spark):
    """Each made-up word is at least ten times less likely than a word of the training texts."""
    docs = [(i, " ".join(f"w{(7 * i + k * k) % 90}" for k in range(60))) for i in range(100)]
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0]
    made_up, ordinary = held[:5], held[5:10]
    docs += [(i, " ".join(f"zz{i}x{k}" for k in range(60))) for i in made_up]
    docs += [(i, " ".join(f"w{(7 * i + k * k) % 90}" for k in range(60))) for i in ordinary]
    score = {r["doc_id"]: r["score"] for r in pitman_yor.language_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert max(score[i] for i in made_up) < min(score[i] for i in ordinary) - 60


def brute_kneser_ney(texts, order=4):
    """Chances of a character after its context, by dictionaries: interpolated, with modified discounts of each order."""
    grams = Counter()
    for t in texts:
        padded = "\0" * (order - 1) + t
        grams.update((padded[i - order + 1 : i], padded[i]) for i in range(order - 1, len(padded)))
    levels = [grams]
    for _ in range(order - 1):
        levels.append(Counter((c[1:], x) for c, x in levels[-1]))
    rules = []
    for counts in levels:
        n = [max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        less = [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, back = Counter(), Counter()
        for (c, _), v in counts.items():
            total[c] += v
            back[c] += less[min(v, 3)]
        rules.append((counts, less, total, back))
    even = 1 / (1 + len(levels[-1]))

    def chance(context, x, level=0):
        if level == order:
            return even
        counts, less, total, back = rules[level]
        lower = chance(context[1:], x, level + 1)
        v = counts.get((context, x), 0)
        return (v - less[min(v, 3)]) / total[context] + back[context] / total[context] * lower if total[context] else lower

    return chance


def test_scores_where_no_seat_is_free(spark):
    """One training text of different words: every customer has a table of its own, so the score is a formula."""
    doc = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10)
    words = [f"w{k}" for k in range(30)]
    (r,) = pitman_yor.language_scores(spark.createDataFrame([(doc, " ".join(words))], "doc_id long, text string")).collect()
    (d0, s0), (d1, s1), v = pitman_yor.ROOT, pitman_yor.CONTEXT, 31
    root = (1 - d0 + (s0 + d0 * v) / (v + 1)) / (v + s0)
    assert r["score"] == pytest.approx(v * np.log10((1 - d1 + (s1 + d1) * root) / (1 + s1)))


def test_scores_do_not_depend_on_partitions(spark, words):
    docs, _ = labelled(spark, words)
    one, many = ({r["doc_id"]: r["score"] for r in pitman_yor.language_scores(docs.repartition(n)).collect()} for n in (1, 9))
    assert one == many


def test_kneser_ney_matches_brute_force(spark, odd, words):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    known = spark.createDataFrame([(x,) for x in texts], "t string")

    def counted(batches):
        for b in batches:
            context, character, n = quality.different(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(character), pa.array(n)], names=["context", "character", "n"])

    counts = known.mapInArrow(counted, "context long, character long, n long").groupBy("context", "character").agg(F.sum("n").alias("n"))
    model = quality.Model(counts, quality.Workspace(spark, "test"))
    chance = brute_kneser_ney(texts)
    for r in quality.perplexities(odd, model).join(odd.select("doc_id", F.length("text").alias("_n"), "text"), "doc_id").collect():
        text = r["text"] or ""
        if r["_n"] == r["n_chars"] and r["doc_id"] not in (5, 4):
            padded = "\0" * 3 + text
            bits = sum(np.log2(chance(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
            assert r["perplexity"] == pytest.approx(2 ** (-bits / max(1, len(text))), rel=1e-4)
    alphabet = sorted({c for t in texts for c in t})
    assert sum(chance("abc", x) for x in alphabet) == pytest.approx(1, abs=0.02)


def test_quality_keeps_clean_text(spark, words, odd, empty):
    docs, _ = labelled(spark, words)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    junk = spark.createDataFrame([(900, "@@## %%$$ !!** " * 30), (901, None), (902, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality.quality(docs.unionByName(junk), labels).collect()}
    assert not out[900]["accepted"] and out[901]["accepted"] and out[902]["accepted"]
    assert np.mean([out[i]["accepted"] for i in range(300)]) > 0.97
    assert quality.quality(empty, labels).collect() == [] and quality.quality(odd, labels.where("false")).where("not accepted").count() == 0
    assert quality.accepted_only(odd, labels).columns == odd.columns


def test_quality_rejects_repeated_words(spark, words):
    docs, _ = labelled(spark, words)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    sentence = " ".join(words[:8]) + ". "
    texts = {900: f"{words[0]} " * 300, 901: sentence * 60, 902: " ".join(words * 5)}
    both = docs.unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    out = {r["doc_id"]: r["accepted"] for r in quality.quality(both, labels).collect()}
    assert not out[900] and not out[901] and out[902]
    kept = {r["doc_id"] for r in quality.accepted_only(both, labels).select("doc_id").collect()}
    assert kept == {i for i, ok in out.items() if ok}


def test_rare_languages_have_their_own_limits(spark):
    """60 trusted rows among 8060: of a sample of 4000 too few set the limit."""
    rng = np.random.default_rng(3)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(12))
    docs = [(i, text("abcdefgh"), "en") for i in range(8000)] + [(i, text("qrstuvwxyz"), "xx") for i in range(9000, 9060)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model, unseen = quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")))
    limits, _ = quality.limits_of(quality.perplexities(unseen, model), 0.99, 1.1)
    assert {r["lang"] for r in limits.collect()} == {"en", "xx"}


def test_varieties_match_brute_force():
    texts = ["", "abc", "abcd", "abcdabcdabcd", "漢字 и кириллица " * 200, "".join(chr(97 + k * k % 23) for k in range(3000)), "x" * 1500]
    for text, found in zip(texts, quality.varieties(texts), strict=True):
        made = []
        for at in range(0, len(text), quality.PIECE):
            grams = [text[k : k + 4] for k in range(at, min(at + quality.PIECE, len(text) - 3))]
            made += [(len(grams), np.log(len(set(grams))) / np.log(len(grams)))] if len(grams) > 1 else []
        assert found == pytest.approx(sum(n * x for n, x in made) / sum(n for n, _ in made) if made else 1)


def brute_lines(docs, least=3, long_line=150):
    first, gone = {}, {i: set() for i, _ in docs}
    for i, text in docs:
        lines = [(k, x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for k, x in enumerate(text.split("\n"))]
        lines = [(k, x) for k, x in lines if x]
        for width in (1, least):
            for n in range(len(lines) - width + 1):
                run = tuple(x for _, x in lines[n : n + width])
                if width == 1 and len(run[0]) < long_line:
                    continue
                if (width, run) in first:
                    gone[i].update(k for k, _ in lines[n : n + width])
                first.setdefault((width, run), (i, n))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_line_dedup_matches_brute_force(spark, odd, empty):
    rng = np.random.default_rng(6)
    pool = [f"line {k}" for k in range(12)] + ["long " * 40 + str(k) for k in range(3)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(1, 15)))) for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert out == brute_lines(docs)
    assert line_dedup(odd).count() == odd.count() and line_dedup(empty).collect() == []


def test_suffix_array_sorts_all_suffixes(spark):
    rng = np.random.default_rng(9)
    docs = [(i, "\n".join(rng.choice(list("abcd") + [""], rng.integers(1, 12)))) for i in range(25)] + [(30, "a\nb\na\nb\na\nb\na\nb"), (31, "a\nb\na\nb\na\nb\na\nb")]
    out = {(r["doc_id"], r["line"]): bytes(r["rank"]) for r in suffix_array(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    suffixes = {}
    for i, t in docs:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x]
        for n, (k, _) in enumerate(lines):
            suffixes[(i, k)] = [hashlib.md5(x.encode()).digest() for _, x in lines[n:]]
    assert out.keys() == suffixes.keys()
    order = sorted(out, key=lambda k: out[k])
    assert [suffixes[k] for k in order] == sorted(suffixes.values())
    assert all((out[a] == out[b]) == (suffixes[a] == suffixes[b]) for a, b in itertools.pairwise(order))


def test_repeated_runs_are_maximal(spark):
    docs = [(1, "a\nb\nc\nd\ne\nf"), (2, "x\nb\nc\n\nd\ne\ny"), (3, "c\nd\ne\nf\nq\na\nb\nc"), (4, "p\nq\nr")]
    out = {tuple(r) for r in repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "line", "n_lines", "of_doc_id", "of_line").collect()}
    assert out == {(2, 1, 4, 1, 1), (3, 0, 4, 1, 2), (3, 5, 3, 1, 0)}


def test_likeness_is_near_the_spans_jaccard(words):
    rng = np.random.default_rng(12)
    for n in (5, 40, 400, 3000):
        a = " ".join(rng.choice(words, n))
        for keep in (0.0, 0.3, 0.9):
            b = a[: int(keep * len(a))] + " ".join(rng.choice(words, n))
            spans = [{t[i : i + fp.SPAN] for i in range(max(1, len(t) - fp.SPAN + 1))} for t in (a, b)]
            jaccard = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
            assert abs(fp.Fingerprint(a).likeness(fp.Fingerprint(b)) - jaccard) < 0.15


def test_fingerprints_over_many_ranges(spark, words):
    """Fewer rows than ranges, gaps, and ids that are text."""
    rng = np.random.default_rng(13)
    docs = [(f"k{int(k):05d}", " ".join(rng.choice(words, 12))) for k in rng.choice(10**5, 37, replace=False)]
    out = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(docs, "doc_id string, text string").repartition(5)).collect()}
    docs.sort()
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        assert out[i]["edited_sha256"] == hashlib.sha256(fp.edited_text(t, following).encode()).hexdigest()
        assert out[i]["near_next"] == fp.Fingerprint(t).likeness(fp.Fingerprint(following))


def test_with_summary_equals_a_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(99, 1), (None, 2)], "g int, v int")
    groups = rows.where("g is not null and g < 90").groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how in ("inner", "left"):
        want = Counter(tuple(r) for r in rows.join(groups, "g", how).select("g", "v", "n", "top").collect())
        assert Counter(tuple(r) for r in with_summary(rows, groups, ["g"], "n", 302, how, least=60).collect()) == want


def test_very_long_text(spark, words):
    """One text of two million characters, with lines, beside short and empty ones."""
    rng = np.random.default_rng(14)
    long = "\n".join(" ".join(rng.choice(words, 20)) for _ in range(17_000))
    df = spark.createDataFrame([(1, long), (2, long[: 10**6]), (3, ""), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_chars"] for r in fp.fingerprints(df).select("doc_id", "n_chars").collect()}[1] == len(long)
    assert radix_groups(df).count() == 4 and balanced_shards(df).count() == 4
    removed = {r["doc_id"]: r["removed_lines"] for r in line_dedup(df).select("doc_id", "removed_lines").collect()}
    assert removed[1] == 0 and removed[2] > 7000
    assert minhash.near_duplicates(df).where("kept").count() == 4
    assert toxicity.toxicity(df, labels).count() == quality.quality(df, labels).count() == 4


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    """Nulls in ids and texts, empty texts, repeated rows, clashing columns, and no rows at all, through all stages."""
    import corpus_pipeline

    folder = str(tmp_path / "in")
    odd.select("doc_id").where("doc_id < 8").distinct().selectExpr("doc_id", "1 as quality", "cast(doc_id = 3 as int) as toxic").write.parquet(f"{folder}/labels.parquet")
    for name, docs in (("odd", odd), ("empty", empty)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            assert k == 4 or docs.columns == columns
        assert docs.isEmpty() == (name == "empty")
    odd.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name == "exact dedup":
            want = {bare(r["text"] or "") for r in before.collect()}
            assert docs.count() == len(want) == len({bare(r["text"] or "") for r in docs.collect()})
        if name == "minhash near-dedup":
            parts = brute_components(sorted(rows_of(before)), Fraction(4, 5))
            assert {r["doc_id"] for r in docs.collect()} == set(parts.values())
        if k < 4:
            assert docs.columns == columns and docs.count() <= before.count()
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}


def test_fixed_vocabulary_is_read_from_its_path():
    with open(BYTE, encoding="utf-8") as f:
        assert len(json.load(f)["model"]["merges"]) == len(load(BYTE).keys)


def test_subwords_are_the_hashes_of_the_n_grams_own_bytes():
    """Of plain ASCII, where slices of bytes are hashed, and of any other text."""
    import xxhash

    from corvane.llm import toxicity

    for word in ("", "a", "toxic", "aaaaaaaa", "naïve", "你好世界", "x\U0001f600y", "\ud800z"):
        marked = f"<{word}>"
        grams = {marked[i : i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)} | {marked}
        assert sorted(toxicity.subwords(word)) == sorted(xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS for g in grams)


def test_word_values_are_means_over_subwords():
    """Words of a piece are valued together; the hashes are those of the words taken one by one."""
    from corvane.llm import toxicity

    rng = np.random.default_rng(2)
    letters = list("abcd<>é\x00ßж中😀\ud800")
    words = ["".join(letters[i] for i in rng.choice(13, rng.integers(1, 12), p=[0.14] * 6 + [0.16 / 7] * 7)) for _ in range(2000)] + ["a", "é", "ab" * 400, "中" * 9]
    values = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    want = [np.mean([float(values[b]) for b in toxicity.subwords(w)]) for w in words]
    for piece in (1, 100, 1 << 18):
        assert np.allclose(toxicity.word_values(words, values, piece), want, rtol=0, atol=1e-12)
    assert len(toxicity.word_values([], values)) == 0 and toxicity.Scorer(values, 0.0).scores(["", "a"])[0] == 0.5


def test_packing_remembers_no_more_words_than_it_is_told():
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{k}" for i in range(200)) for k in range(30)]
    tokenizer, most = packing.WordTokenizer(WORD), 0
    want = list(packing.load(WORD).encode_batch(texts))
    for at, ids in enumerate(tokenizer.encode_batch(texts, 500)):
        assert ids == want[at]
        most = max(most, len(tokenizer.known))
    assert most <= 500 + 8 * 500 // len("wordaa0 ") + 200
