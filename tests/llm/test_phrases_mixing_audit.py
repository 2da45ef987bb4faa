import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import filter_audit, mixing, phrases, queries

WHERE = "/root/testdata/sf0.001"


def brute_phrases(rows, least, max_words, cover, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase and trying every cut and every longer candidate."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = lambda c, b: any(b[i : i + len(c)] == c for i in range(len(b) - len(c) + 1))
    out = defaultdict(list)
    for (lang, c), a in found.items():
        if not any(x == lang and len(b) > len(c) and cover[1] * v >= cover[0] * a and inside(c, b) for (x, b), v in found.items()):
            s, k = min((2_000_000 * a // (f[lang, c[:k]] + f[lang, c[k:]]), k) for k in range(1, len(c)))
            out[lang].append((-s, -a, " ".join(c).encode(), f[lang, c[:k]], f[lang, c[k:]]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, each in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(each)[:top], 1)}


@pytest.fixture(scope="module")
def prose(spark, words):
    rng = random.Random(3)
    some = words[:30] + ["Ünd", "É", "a'b"]
    def text():
        w = rng.choices(some, range(len(some), 0, -1), k=rng.randint(0, 60))
        for at in range(0, len(w) - 4, 9):
            w[at : at + 4] = ["New", "YORK", "city", "hall"][: rng.choice([2, 4, 4, 4])]
        return "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for x in w)
    rows = [(i, text(), rng.choice(["en", "en", "en", "de", "und", None]), rng.choice(["a", "b", "b", "b", "é", "", None])) for i in range(300)]
    rows += [(7, None, "en", "b"), (None, "", None, None), (None, text(), "fr", "b"), (8, rows[0][1], "en", "zz"), (9, "x", "en", "c")]
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, phrase string, n int, row int").repartition(5)


def test_phrases_match_brute_force(prose, odd, empty, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in prose.collect()]
    for least, top in ((5, 2000), (12, 7)):
        want = brute_phrases(rows, least, 4, (80, 100), top)
        assert {tuple(r) for r in phrases.collocations(prose, least=least, top=top).collect()} == want and len(want) > 10
    monkeypatch.setattr(phrases, "MOST_BITS", 16)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    assert {tuple(r) for r in phrases.collocations(prose, least=5, max_words=3).collect()} == brute_phrases(rows, 5, 3, (80, 100), 2000)
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in phrases.collocations(odd, least=3).collect()} == brute_phrases(rows, 3, 4, (80, 100), 2000)
    assert phrases.collocations(empty).collect() == [] == phrases.collocations(odd.where("text is null")).collect()


def test_scores_pass_64_bits(spark):
    wide = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001, 9_000_000_000_000_007)], "a long, l long, r long")
    got = wide.selectExpr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) AS s").first()["s"]
    assert got == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_008


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Sharing again what sources leave until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, stopped = {s: weights[k % len(weights)] for k, s in enumerate(names)}, {}
    while True:
        left, free = sum(sizes.values()) - sum(stopped.values()), [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return share | stopped
        stopped |= {s: most * sizes[s] for s in above}


def test_targets_match_sharing_again_and_again(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {s: rng.choice([0, 1, 3, 10, 200, 5000]) for s in [None, "", "a", "b", "é", "z", "\U0001f600", "zz"]}
        df = spark.createDataFrame([(int(s is None), s or "", n, 1) for s, n in sizes.items()], "no_source int, source string, source_size long, rows long")
        got = {None if r["no_source"] else r["source"]: r["target"] for r in mixing.with_targets(df, (1, 2, 3), 3).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 513):
        x = spark.range(n).select(*(mixing.permuted(F.col("id"), F.lit(n), 1, F.lit(e)).alias(f"p{e}") for e in range(2))).collect()
        assert sorted(r["p0"] for r in x) == sorted(r["p1"] for r in x) == list(range(n))
        assert n < 10 or sum(r["p0"] != r["p1"] for r in x) > n * 0.9


def test_mixture(prose, odd, empty):
    documents, spans = mixing.mix(prose, block=16, least_blocks=20, shard_blocks=50)
    docs = {r["row"]: r for r in documents.collect()}
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w])
    assert Counter((d["doc_id"], d["size"]) for d in docs.values()) == Counter((r["doc_id"], size(r["text"])) for r in prose.collect())
    sizes = Counter()
    for d in docs.values():
        sizes[None if d["no_source"] else d["source"]] += d["size"]
    target = brute_targets(sizes)
    places, used, words = defaultdict(list), defaultdict(Counter), Counter()
    for s in spans.collect():
        d, source = docs[s["row"]], None if s["no_source"] else s["source"]
        assert (s["no_source"], s["source"]) == (d["no_source"], d["source"]) and 0 <= s["first"] < s["first"] + s["words"] <= d["size"]
        places[s["shard"], s["slot"]].append(s)
        words[source] += s["words"]
    for each in places.values():
        assert len({(s["source"], s["no_source"], s["block"]) for s in each}) == 1
        used[None if each[0]["no_source"] else each[0]["source"]][each[0]["block"]] += 1
    total = len(places)
    assert set(places) == {divmod(k, 50) for k in range(total)}
    for source, n in sizes.items():
        d = next(d for d in docs.values() if (None if d["no_source"] else d["source"]) == source)
        assert (d["source_size"], d["target"]) == (n, pytest.approx(target[source]))
        b = max(1, min(16, n // 20))
        assert abs(words[source] - target[source]) <= 2.5 * b
        assert not used[source] or max(used[source].values()) - min(used[source].get(k, 0) for k in range(-(-n // b))) <= 1
    mixed = mixing.mixture_counts(prose, block=16)
    rows = mixed.collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and len(rows) == len(docs)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mixture_counts(prose.repartition(3, "text"), block=16).collect()))
    assert mixing.mixture_counts(odd).count() == odd.count()
    assert mixing.mixture_counts(empty).collect() == []
    assert [tuple(r) for r in mixing.mixture_counts(odd.where("doc_id < 2")).collect()] == [(i, 0, 0, 0.0, 0) for i in range(2)]


def brute_audit(rows, labels):
    """Applies the filters one by one in every order."""
    smaller = lambda i, t: i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
    docs = []
    for i, t, part in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller(i, t)}
        docs.append((part, {f for f, x in fails.items() if x}, i))
    out = []
    for part in {p for p, _, _ in docs}:
        here, mine = [(f, i) for p, f, i in docs if p == part], []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for s, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in here) - sum(f in d[0] for d in left)
                left = [d for d in left if f not in d[0]]
                mine.append([part, order, s, len(left), len(gone), redundant, sum(d[0] == {f} for d in here), sum((i, 1) in labels[0] for _, i in gone), sum((i, 1) in labels[1] for _, i in gone)])
        total = Counter()
        for r in mine:
            total[r[1][r[2] - 1]] += r[4]
        out += [(*r, total[r[1][r[2] - 1]]) for r in mine]
    return Counter(out)


def test_audit_matches_brute_force(spark, odd, empty, words, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    rng = random.Random(4)
    make = lambda: " ".join(rng.choices(words, k=rng.choice([5, 220]))) if rng.random() < 0.7 else " ".join(rng.choices(words[:80], k=250)) + rng.choice(["", "#", "A" * 90])
    texts = [make() for _ in range(30)]
    rows = [(rng.choice([*range(60), None]), rng.choice([*texts, texts[0], texts[0], None, ""]), rng.choice(["p", "q", "é", "", None])) for _ in range(90)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string").repartition(4)
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    have = ({(i, q) for i, q, _ in marks if i is not None}, {(i, t) for i, _, t in marks if i is not None})
    got = Counter(map(tuple, filter_audit.filter_audit(df, labels).collect()))
    assert got == brute_audit([(i, t or "", p or "") for i, t, p in rows], have)
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in odd.collect()]
    assert Counter(map(tuple, filter_audit.filter_audit(odd, labels.where("false")).collect())) == brute_audit(rows, (set(), set()))
    assert filter_audit.filter_audit(empty, labels).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_text_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in Path(WHERE).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, want = queries.QUERIES[name](spark, WHERE), con.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in order) for r in want.fetchall())
