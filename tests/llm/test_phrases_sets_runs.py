"""Collocations, SuperMinHash near duplicates and periodic runs against brute force, and on untidy tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioframe.llm import phrases, runs, superminhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["c", "n", "keys", "key", "size", "center", "part", "side", "root", "runs", "collapsed", "phrase", "f", "rank", "score", "w", "k"]


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit("own") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def untidy():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcÀé", k=rng.randint(1, 3)))
    rows = [(1, None, None), (2, "en", ""), (3, "en", " \t\n"), (4, "en", "one"), (4, "en", "one"), (5, "fr", "ONE"), (None, "en", "Two words"), (None, None, "two words"),
            (6, "en", "...,;;!?"), (7, "de", " ".join(word() for _ in range(30_000))), (8, None, "a a a a a a a a"), (9, "en", "x y x y x y x y x"), (None, "en", None), (10, "en", "À b c 中文 😀")]
    rows += [(100 + i, "en", "the very same text in all of the copies. " * 9) for i in range(30)]
    return rows + [(200 + i, rng.choice(["en", "de", None]), " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(60)]


# ---------------------------------------------------------------- 11 collocations

def collocations(rows, least, best):
    count, total = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 6):
                count[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        some = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in some.items():
            if len(p) == 1 or any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, r, total[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize("least,best,cells", [(3, 2000, 1 << 16), (2, 7, 1 << 16), (5, 50, 64)])
def test_collocations_untidy(spark, untidy, monkeypatch, least, best, cells):
    monkeypatch.setattr(phrases, "FEWEST", cells)  # a few cells that all are full lose nothing either
    monkeypatch.setattr(phrases, "MOST", cells)
    monkeypatch.setattr(phrases, "CELLS", min(cells, phrases.CELLS))
    rng = random.Random(2)
    rows = untidy + [(500 + i, "en", " ".join(rng.choices(["red", "blue", "new york", "new york city", "a, b", "stop. go"], k=30))) for i in range(40)]
    got = sorted(map(tuple, phrases.collocations(table(spark, rows), least, best).collect()))
    assert got == collocations(rows, least, best) and len(got) > 5


def test_collocations_empty_and_without_limit(spark, untidy):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, untidy), 4, None).count() == len(collocations(untidy, 4, 10 ** 9))
    with pytest.raises(ValueError):
        phrases.frequent(table(spark, untidy), 256)


def test_products_beyond_64_bits(spark):
    rows = [(i, "en", "p q") for i in range(120)]
    assert [tuple(r)[3:] for r in phrases.collocations(table(spark, rows)).collect()] == [(120, 120, 120, 240, 2000)]
    big = spark.sql("select cast(1000 * cast(8e15 as decimal(19,0)) * cast(9e17 as decimal(19,0)) as decimal(38,0)) div (cast(7e15 as decimal(19,0)) * cast(6e15 as decimal(19,0))) x").first().x
    assert big == 1000 * 8 * 10 ** 15 * 9 * 10 ** 17 // (42 * 10 ** 30)


def test_sketches_never_count_too_little(spark, untidy):
    texts = table(spark, untidy).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for cells in (1 << 18, 1 << 19):
        marks = np.zeros((phrases.DEPTH, cells // 8), np.uint8)
        for r in phrases.sketched(texts, cells, 3).collect():
            marks[r.row, r.block * phrases.CELLS // 8:][:phrases.CELLS // 8] = np.frombuffer(r.marks, np.uint8)
        assert 0 < np.unpackbits(marks).mean() < 0.2
        got = {(r.lang, r.phrase): r.f for r in phrases.counted(texts, marks, cells).collect()}
        want = {(lang, p): a for lang, _, p, a, *_ in collocations(untidy, 3, 10 ** 9)}
        assert want.items() <= got.items()


# ---------------------------------------------------------------- 12 near duplicates

def shingles(text):
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def classes(rows, percent=85):
    sets = [shingles(t) for _, _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((r[0], len(sets[i]), low[find(i)], r[0] == low[find(i)])) for i, r in enumerate(rows))


def near(seed):
    """Texts with copies at all distances: chains of small edits, a star around one text, and a common passage."""
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(40):
        base = list(base)
        base[rng.randrange(120)] = f"e{i}"
        rows.append((1000 + i, "en", " ".join(base)))
    center = [f"v{rng.randrange(400)}" for _ in range(100)]
    for i in range(60):
        copy = list(center)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((2000 + i, "en", " ".join(copy)))
    passage = " ".join(center[:50])
    rows += [(3000 + i, "en", passage + " " + " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randint(5, 60)))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates(spark, untidy, block):
    rows = untidy + near(block)
    got = superminhash.near_duplicates(table(spark, rows), block=block).collect()
    assert sorted(str(tuple(r)) for r in got) == classes(rows)


def test_near_duplicates_of_the_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()
    got = superminhash.op12_superminhash(spark, sf).collect()
    assert sorted(str(tuple(r)) for r in got) == classes([(r["doc_id"], r["lang"], r["text"]) for r in t])


def test_near_duplicates_empty(spark):
    assert superminhash.near_duplicates(table(spark, [])).count() == 0


def test_signatures_estimate_and_stop_early():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 700, 30_000):
        union = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(union[:n]), np.unique(union[n // 4:n + n // 4])
        x, y, again = superminhash.signatures([a, b, a])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (x == again).all() and abs((x == y).mean() - true) < 0.2
        steps = x >> np.uint64(48)
        assert steps.max() < superminhash.SLOTS and (steps.any() if n < 50 else n < 10_000 or not steps.any())
        if n == 1:  # a permutation: each step once
            assert sorted(steps.tolist()) == list(range(superminhash.SLOTS))


def test_signatures_vary_less():
    """The shares of equal slots lie nearer to the similarity than those of independent slots."""
    rng = np.random.default_rng(6)
    draws = []
    for _ in range(400):
        union = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        x, y = superminhash.signatures([np.unique(union[:9]), np.unique(union[3:])])
        draws.append((x == y).mean())
    assert abs(np.mean(draws) - 0.5) < 0.02 and np.var(draws) < 0.8 * 0.25 / superminhash.SLOTS


# ---------------------------------------------------------------- 13 runs

def all_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        k = 0
        while k < len(w) - q:
            e = k
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            if e - k + q >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(k, e + q - p)) for p in range(1, q)):
                out.append((k, e - k + q, q))
            k = max(e, k + 1)
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n, c = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(c) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                x, p = rng.randrange(n), rng.randint(1, 12)
                for k in range(x + p, rng.randint(x, n)):
                    w[k] = w[k - p]
        for least, times in ((6, 4), (3, 3), (9, 5)):
            assert runs.runs_of(np.array(w, np.int64), least, times) == all_runs(w, least, times)


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


def test_time_grows_with_the_words():
    a, b = [1], [1, 2]
    while len(b) < 20_000:
        a, b = b, b + a
    for w in ([1] * 20_000, [1, 2] * 10_000, b, [3, 1, 4, 1, 5, 9, 2, 6] * 2500, [x for k in range(200) for x in [1] * k + [2]]):
        for s in (w, [max(w) + 1 - x for x in w]):
            Counted.reads = 0
            runs.next_smaller(Counted([0, *s, 0]))
            assert Counted.reads < 15 * len(w)


def expected(i, text, edit):
    w = WORDS.findall(text or "")
    h = zlib.crc32(("null" if i is None else str(i)).encode())
    g, n = h // 10, len(w)
    if edit and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = runs.runs_of(np.unique(w, return_inverse=True)[1], 6, 4) if n > 400 else all_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), s, m, q, 1000 * m // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_the_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = runs.op13_lyndon_runs(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())) == sorted(expected(r["doc_id"], r["text"], True) for r in t)
    assert got.filter("n_runs > 0").count() > 5


def test_runs_untidy(spark, untidy):
    found = runs.find_runs(table(spark, untidy))
    assert found.columns[-4:] == ["w", "k", "runs_", "collapsed_"]
    got = runs.digest(found.select("doc_id", F.col("runs_").alias("runs"), F.col("collapsed_").alias("collapsed"))).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(expected(i, t, False)) for i, _, t in untidy)
    assert {r.doc_id: r.n_runs for r in got}[8] == 1 and runs.find_runs(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(table(spark, []), times=2)
