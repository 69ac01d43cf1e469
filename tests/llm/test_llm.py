"""The corpus operators against brute force, exact round trips and held-out accuracy, and on untidy tables."""

import bisect
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioframe.llm import chat, covertree, lshforest, mixing, packing, queries, sharding, spotsigs, tokenfile, tokens, toxicity

#: Names that operators use for columns of their own.
CLASH = ["score", "size", "c", "keys", "block", "p", "of", "piece", "k", "sigs", "bytes", "h", "copies", "target", "_words", "_row", "_nth", "_copies", "_of", "n", "key", "part", "body", "edited"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="module")
def untidy(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, None, None), (2, "", "b"), (3, "   ", "b"), (4, "one", "a"), (4, "one", "a"), (4, "other text", "a"), (None, "no id here at all", "a"), (5, long, "c"),
            (6, "!!! ***", "ü"), (7, "é中文 😀 the cat of the house", "ü"), (8, "x<|endoftext|>y  z\n\n q \t", "a"), (-9, "negative id text", None)]
    rows += [(100 + i, "the same words in all of the copies here", "a") for i in range(40)]
    rows += [(200 + i, " ".join(["the"] + [word() for _ in range(rng.randint(1, 300))]), "c") for i in range(40)]
    return documents(spark, rows).repartition(5), rows


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(tokens.default_path())
    return lambda t: library.encode(t, add_special_tokens=False).ids


def texts(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").to_pandas().sort_values("doc_id")


# ---------------------------------------------------------------- SQL

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    df = queries.QUERIES[name](spark, sf)
    got = c.execute(queries.ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(x) for x in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())


# ---------------------------------------------------------------- 1 chat

def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("a", F.lit(2))


def test_snapshots_collapse(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(n, i, *talk[i]) for n in (1, 2, 3) for i in range(n)] + [(4, i, *talk[i]) for i in range(3)] + [(5, 0, "user", "a"), (5, 1, "assistant", "x"), (6, 0, "user", "b")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.format_chats(chats(spark, rows)).collect()}
    assert got == {3: (3, 2), 5: (2, 1), 6: (1, 1)}


def test_chat_untidy(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 0, "user", "y"), (None, 1, "user", "y"), (2, 5, "user", "q"), (2, 5, "user", "r")]
    rows += [(None, 0, "user", f"z{i % 3}") for i in range(9)] + [(7, 3, "user", "z0"), (None, 3, "user", "q")]
    found = chat.format_chats(chats(spark, rows)).collect()
    one = lambda t: (None, 1, f"<|im_start|>user\n{t}<|im_end|>\n")
    assert sorted(str((r.conv_id, r.n_turns, r.chat, r.n_copies)) for r in found if r.conv_id not in (1, 2)) == sorted(
        map(str, [(*one("y"), 2), (*one("z1"), 1), (*one("z2"), 1), (7, 1, one("z0")[2], 2)]))
    got = {r.conv_id: (r.n_turns, r.chat) for r in found}
    assert got[1] == (2, "<|im_start|>user\nx<|im_end|>\n<|im_start|>\n<|im_end|>\n") and got[2][0] == 2 and got[None][0] == 1
    assert chat.format_chats(chats(spark, [])).count() == 0


# ---------------------------------------------------------------- 2 tokens

def test_encoder_equals_the_library():
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(1)
    cases = ["", " ", "a  b", "a\n b", "a \nb", " a", "a ", "it's x'll", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|>", "é中 😀", "a b " * 30, "w" * 5000 + " " + "v" * 80 + " b c", "a  b", "a  b c d"]
    cases += ["".join(rng.choices(" \n\t'sabé1_.,% 中²", weights=[8, 2, 1, 2, 2, 3, 3, 2, 2, 1, 1, 1, 1, .3, .3, .3], k=rng.randint(1, 60))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(tokens.default_path()).encode_batch(cases, add_special_tokens=False)]
    for _ in range(2):  # the second time chunks are known
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(cases)] == want


def test_equal_hashes_do_not_matter(monkeypatch):
    monkeypatch.setattr(tokens, "mix64", lambda x: x % np.uint64(97))
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(5)
    cases = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 20))) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a " + "b" * 200 + " c " + "b" * 200 + " d"]
    want = [e.ids for e in Tokenizer.from_file(tokens.default_path()).encode_batch(cases, add_special_tokens=False)]
    for case, ids in zip(cases * 2, want * 2):
        assert np.frombuffer(enc.encode([case])[0], enc.dtype).tolist() == ids


def test_encoder_forgets_and_slices(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "RECENT", 7)
    monkeypatch.setattr(tokens, "AT_ONCE", 200)
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(2)
    cases = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    want = [e.ids for e in Tokenizer.from_file(tokens.default_path()).encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(cases)] == want


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_add_up(untidy, ids_of, rule):
    df, rows = untidy
    got = tokens.count_section_tokens(df, r"[\n.]|(?<=e)", rule).collect()
    total: dict = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want: dict = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len(ids_of(t or ""))
    assert {k: round(v, 6) for k, v in total.items()} == want


def test_sections_equal_offsets(spark, sf):
    d = texts(sf)
    got = tokens.op2_section_tokens(spark, sf).toPandas()
    enc = Tokenizer.from_file(tokens.default_path())
    by = {k: g.sort_values("section") for k, g in got.groupby("doc_id")}
    for i, t in zip(d.doc_id, d.text):
        edges, n = by[i].start.tolist(), [0] * len(by[i])
        for a, _ in enc.encode(t, add_special_tokens=False).offsets:
            n[bisect.bisect_right(edges, a) - 1] += 1
        assert n == by[i].n_tokens.tolist()


def test_tokens_of_nothing(none):
    assert tokens.count_section_tokens(none).count() == 0


# ---------------------------------------------------------------- 3 shards

@pytest.mark.parametrize("limit", [60, 700, 5000, 10**9])
def test_shards_fit(untidy, limit):
    df, rows = untidy
    got = sharding.shard_documents(df, limit).collect()
    assert len(got) == len(rows)
    used: dict = {}
    for r in got:
        used.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(v) <= limit or len(v) == 1 for v in used.values())
    bits = [s for s in used if re.fullmatch("[01]*", s)]
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)


def test_only_large_buckets_split(untidy):
    df, rows = untidy
    got = [r for r in sharding.shard_documents(df, 700).collect() if r.depth >= 0]
    key = lambda i, t: int(hashlib.md5(f"{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    small = [(key(i, t), len((t or "").encode())) for i, t, _ in rows if len((t or "").encode()) <= 700]
    for r in got:
        if 0 < r.depth < 60:
            up = r.shard[:-1]
            assert sum(b for h, b in small if format(h, "060b").startswith(up)) > 700


@pytest.mark.parametrize("limit", [60, 700, 10**9])
def test_written_shards_hold_each_row_once(untidy, tmp_path, limit):
    df, rows = untidy
    df = df.withColumn("shard", F.lit("mine"))
    sharding.write_shards(df, f"file://{tmp_path}/s", limit)
    got = df.sparkSession.read.option("recursiveFileLookup", "false").parquet(f"file://{tmp_path}/s")
    assert set(got.columns) == {*df.columns, "shard_"} and {r.shard for r in got.collect()} == {"mine"}
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((i, t)) for i, t, _ in rows)
    want = sorted(str((r.doc_id, r.n_bytes, r.shard)) for r in sharding.shard_documents(df, limit).collect())
    named = sharding.with_shards(df, limit).collect()
    assert sorted(str((r.doc_id, len((r.text or "").encode()), r.shard_)) for r in named) == want


def test_query_splits(spark):
    depths = {r[0] for r in sharding.op3_extendible_shards(spark, "/root/testdata/sf0.01").select("depth").distinct().collect()}
    assert len(depths) > 1 and max(depths) > 2


def test_shards_of_nothing(none, tmp_path):
    assert sharding.shard_documents(none).count() == 0 and sharding.with_shards(none).count() == 0


# ---------------------------------------------------------------- 4 fingerprints

def test_fingerprints(untidy):
    df, rows = untidy
    got = spotsigs.fingerprint_documents(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert len(got) == len(rows)
    want = []
    for i, (doc, t, _) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        want.append((doc, len(t), hashlib.sha256((t[:len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))
    assert len({r.fingerprint for r in got if r.doc_id and 100 <= r.doc_id < 140}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_next for r in got if r.doc_id == 110] == [1.0]


def test_signatures_by_hand(spark):
    df = spark.createDataFrame([("the cat of a big house",), ("cat dog",), ("",), ("?!",), ("the cat sat the cat sat",)], "t string")
    n = [len(r[0]) for r in df.select(spotsigs.signatures(F.col("t"))).collect()]
    assert n == [3, 2, 0, 1, 2]


def test_chains_follow_anchors(spark, sf):
    total = anchored = 0
    for text in texts(sf).text:
        words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        anchored += sum(w in spotsigs.ANCHORS for w in words)
    total = spark.read.parquet(f"{sf}/documents.parquet").select(F.sum(F.size(spotsigs.signatures(F.col("text"))))).first()[0]
    assert anchored > 0.85 * total

def test_edited_texts_stay_near(spark, sf):
    got = spotsigs.op4_spotsigs(spark, sf).filter("n_chars > 400").toPandas()
    assert got.near_edited.median() > 0.5 and (got.near_edited > got.near_next).mean() > 0.95 and got.near_next.median() < 0.05


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [["the " + "".join(rng.choices("abcdef", k=5)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(40):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(60)] = "of " + "".join(rng.choices("ghijk", k=5))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(frozenset(sets[i]), i)
    keys = sorted(firsts.values())
    want = {(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(df, 0.6).collect()} == want and want


def test_near_pairs_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"the {x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, a + " the end"), (None, b), (None, b + " the end"), (2, b + " the start")]
    got = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()
    assert sorted((str(r.a), str(r.b)) for r in got) == [("1", "1"), ("2", "None"), ("2", "None"), ("None", "None")]


def test_fingerprints_of_nothing_and_of_one(spark, none):
    assert spotsigs.fingerprint_documents(none).count() == 0
    assert spotsigs.fingerprint_documents(documents(spark, [(1, "alone in the house", "a")])).first().near_next == 1.0


def signature_set(text):
    """The signatures of a text, told apart as they are, not by hashes."""
    words, common = regex.split(r"[^\p{L}\p{N}]+", text.lower()), set(spotsigs.ANCHORS)
    content, spots = [], []
    for w in words:
        if w in common:
            spots.append((w, len(content)))
        elif w:
            content.append(w)
    chain = lambda i: (*content[i:i + 1], *content[i + 1:i + 2])
    found = [(a, *chain(k)) for a, k in spots]
    edges = [-spotsigs.GAP, *(k for _, k in spots), len(content)]
    for a, b in zip(edges, edges[1:]):
        found += [("", *chain(i)) for i in range(a + spotsigs.GAP, b)] if b - a > spotsigs.GAP else []
    seen: dict = {}
    out = set()
    for f in found or ([("whole", text)] if text else []):
        out.add((f, seen.get(f, 0)))
        seen[f] = seen.get(f, 0) + 1
    return out


def test_fingerprints_equal_brute_force(spark, sf):
    t = texts(sf)
    got = {r.doc_id: r for r in spotsigs.op4_spotsigs(spark, sf).collect()}
    body = [x or "" for x in t["text"]]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (doc, x) in enumerate(zip(t["doc_id"], body)):
        after = body[(i + 1) % len(body)]
        n = len(x) // 4
        edited = x[:len(x) - n] + after[:n]
        own, other, following, r = signature_set(x), signature_set(edited), signature_set(after), got[doc]
        assert int(r.fingerprint.split(":")[0]) == len(own) and int(r.edited_fingerprint.split(":")[0]) == len(other)
        assert abs(r.near_edited - like(own, other)) < 1e-12 and abs(r.near_next - like(own, following)) < 1e-12


# ---------------------------------------------------------------- 5 packing

def test_pieces_cover_and_fill(untidy, ids_of):
    df, rows = untidy
    got = packing.pack_documents(df, 64).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and (n := int(g.length.sum())) <= 64 and n & (n - 1) == 0
    want = sorted(str((i, ids_of(t or "") + [0])) for i, t, _ in rows)
    whole: list = []
    for key, g in got.groupby("doc_id", dropna=False):
        key = None if key != key else int(key)
        copies = [t for i, t, _ in rows if i == key]
        pieces = g.sort_values(["start", "doc_tokens"])
        assert int(pieces.length.sum()) == sum(len(ids_of(t or "")) + 1 for t in copies)
        if len(copies) == 1:
            ids = np.frombuffer(b"".join(pieces.ids), "<u4").tolist()
            assert pieces.start.tolist() == [0, *np.cumsum(pieces.length).tolist()[:-1]]
            whole.append(str((key, ids)))
    assert set(whole) <= set(want) and len(whole) == len(rows) - 3


def test_solver_fills_windows():
    counts = np.zeros(64, np.int64)
    counts[[10, 54, 20, 44, 32]] = [50, 50, 30, 10, 7]
    planned, left = packing.plan(counts, 64)
    assert all(sum(lengths) == 64 for lengths, _ in planned)
    used = np.zeros(64, np.int64)
    for lengths, times in planned:
        for n in lengths:
            used[n] += times
    assert (used + left == counts).all() and left[[10, 54, 44]].sum() == 0


def test_least_squares_is_not_negative():
    combos = np.array([[0, 10, 54], [10, 10, 44]])
    counts = np.zeros(64)
    counts[[10, 54, 44]] = [30, 20, 5]
    x = packing.nonnegative_least_squares(combos, counts, 2000)
    assert (x >= 0).all() and abs(x[0] - 20) < 0.1 and abs(x[1] - 5) < 0.1


def test_packing_nothing(none):
    assert packing.pack_documents(none).count() == 0


# ---------------------------------------------------------------- 6 mixing

def brute_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            return size, {s: 2 * size[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_mix(untidy):
    df, rows = untidy
    got = mixing.take(df).toPandas()
    size, target = brute_targets(rows)
    assert len(got) == len(rows) and ((got.copies >= 0) & (got.copies <= 2)).all()
    none = {None if s != s else s for s in got.source.unique()}
    assert none == set(size)
    for s in size:
        g = got[got.source.isna()] if s is None else got[got.source == s]
        assert np.allclose(g.target, target[s]) and (g.source_size == size[s]).all()
        assert abs((g["size"] * g.copies).sum() - target[s]) <= g["size"].max() / 2 + 1e-6
    assert sorted(map(str, mixing.take(df).collect())) == sorted(map(str, mixing.take(df).collect()))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == got.copies.sum()


def test_deep_tree_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(6)
    df = documents(spark, [(i, "w " * rng.randint(1, 40), "abc"[i % 7 % 3]) for i in range(900)])
    got = mixing.take(df).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 20


def test_pivot_keeps_sum_and_expectation():
    sizes, p = np.array([5.0, 3.0, 8.0, 1.0, 4.0]), np.array([0.3, 0.6, 0.5, 0.2, 0.9])
    runs = np.array([mixing.pivot(sizes, p, np.random.default_rng(i)) for i in range(4000)])
    assert np.allclose(runs @ sizes, p @ sizes) and (((runs > 0) & (runs < 1)).sum(1) <= 1).all()
    assert np.abs(runs.mean(0) - p).max() < 0.03


def test_mix_nothing(none):
    assert mixing.take(none).count() == 0 and mixing.mix_documents(none).count() == 0


# ---------------------------------------------------------------- 7 token files

def test_token_file_round_trip(untidy, ids_of, spark, tmp_path, monkeypatch):
    df, rows = untidy
    tokenfile.write_token_file(df, f"file://{tmp_path}/t")
    got = tokenfile.read_token_file(spark, f"file://{tmp_path}/t").collect()
    start = 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    assert [r.doc_id for r in got] == [i for i, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in got) == sorted(str((i, ids_of(t or "") + [2])) for i, t, _ in rows)


def test_any_token_of_a_file(untidy, ids_of, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    df, rows = untidy
    path = f"file://{tmp_path}/t"
    tokenfile.write_token_file(df, path)
    got = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_token_file(spark, path).collect()}
    every = [x for start in sorted(got) for x in got[start]]
    assert len(every) == sum(len(ids_of(t or "")) + 1 for _, t, _ in rows)
    for place in [0, 1, 700, len(every) // 2, len(every) - 1]:
        assert tokenfile.token_at(spark, path, place) == every[place]
    with pytest.raises(IndexError):
        tokenfile.token_at(spark, path, len(every))
    asked = [(5, 0), (5, 41_000), (5, 10**9), (8, 2), (8, 2), (205, 3), (77, 0), (7, None), (1, 0), (1, 1)]
    text = {i: t for i, t, _ in rows}
    want = sorted(str((i, n, (ids_of(text[i] or "") + [2])[n] if i in text and n is not None and n <= len(ids_of(text[i] or "")) else None)) for i, n in asked)
    for most in (1 << 16, 3):
        monkeypatch.setattr(tokenfile, "LOOKED_UP", most)
        found = tokenfile.tokens_at(spark, path, spark.createDataFrame(asked, "doc_id long, i long")).collect()
        assert sorted(str((r.doc_id, r.i, r.token)) for r in found) == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    codes = tokenfile.Codes(tokenfile.write_codes(ids))
    assert codes.n == n and (codes.slice(0, n) == ids).all()
    for i in rng.integers(0, max(1, n), 60 if n else 0):
        j = min(n, int(i) + int(rng.integers(0, 700)))
        assert codes[int(i)] == ids[i] and (codes.slice(int(i), j) == ids[i:j]).all()


def test_token_file_of_nothing(none, spark, tmp_path):
    tokenfile.write_token_file(none, f"file://{tmp_path}/t")
    assert tokenfile.read_token_file(spark, f"file://{tmp_path}/t").count() == 0


# ---------------------------------------------------------------- 8 search

def brute_top(rows, k):
    most = (1 << 63) - 1
    fit = lambda x: max(-most, min(most, x))
    ok = [(i, [fit(math.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 100 == 0:
            scored = sorted((-fit(sum(x * y for x, y in zip(v, w))), j) for b, (j, w) in enumerate(ok) if a != b)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, part, summaries", [(4096, 4096, 8192), (30, 2, 3)])
def test_search_equals_brute_force(spark, block, part, summaries):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + 0.1 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    rows += [(200, rows[3][1]), (200, rows[200][1]), (7, rows[200][1]), (6000, [9e15] * 8), (6001, [9e15] * 7 + [-9e15]), (6002, [3e15, 2.5]), (6100, [0.1, 0.2, -1e18])]
    rows += [(5000, None), (5100, [1.0, None]), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (5400, []), (5500, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("score", F.lit(0))
    got = covertree.top_inner_products(df, F.col("vec_id") % 100 == 0, block=block, part=part, summaries=summaries)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 10)


def test_search_prunes():
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.normal(size=(2000, 8)) * 5 + s for s in (-900, 900)])).astype(np.int64)
    s = covertree.Search(x[:10], np.arange(10), np.full(10, -np.inf), x, np.arange(4000), np.arange(4000), 10)
    leaves = lambda n: sum(map(leaves, n.children)) if n.children else 1
    assert leaves(covertree.cover_tree(x.astype(float))[0]) == len(np.unique(x, axis=0)) and 100 <= s.scored <= 0.6 * 10 * len(x)


@pytest.mark.parametrize("dimensions, scale", [(2, 1000), (8, 1000), (64, 3), (1, 5)])
def test_cover_tree_invariants(dimensions, scale):
    x = np.round(np.random.default_rng(dimensions).normal(size=(300, dimensions)) * scale)
    x[250:] = x[:50]
    root, order = covertree.cover_tree(x)
    assert sorted(order) == list(range(300))
    far = lambda a, b: float(np.sqrt(((x[a] - x[b]) ** 2).sum()))
    level: dict = {root.at: math.inf}
    todo = [root]
    while todo:
        n = todo.pop()
        below = order[n.start:n.stop]
        assert abs(n.radius - max(far(n.at, p) for p in below)) < 1e-6
        if not n.children:
            assert n.radius == 0
            continue
        assert n.children[0].at == n.at  # nesting: a point is among its own children
        for c in n.children[1:]:
            level[c.at] = n.level
            assert far(n.at, c.at) <= 2.0 ** (n.level + 1) + 1e-6  # covering
        assert n.radius <= 2.0 ** (n.level + 2)
        todo += n.children
    for i in {v for v in level.values() if v < math.inf}:
        net = [p for p, v in level.items() if v >= i]
        assert all(far(a, b) > 2.0 ** i - 1e-6 for a in net for b in net if a < b)  # separation
        assert all(min(far(p, c) for c in net) <= 2.0 ** i + 1e-6 for p in range(300))


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.top_inner_products(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert covertree.top_inner_products(df.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------- 9 toxicity

def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("aeioubcdfgt", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.12
        w = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["zorky", "Vilefroth", "mukspawn"]) + rng.choice(["", "s", "ish"])
        rows.append((i, " ".join(w), "s"))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
        rows[-1] += (toxic,)
    docs = documents(spark, [r[:3] for r in rows])
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("score", F.lit(1))
    model = toxicity.train(docs, known)
    got = toxicity.score_documents(docs, model, "mine").select("doc_id", "mine", "score").collect()
    assert all(r.score == "own" for r in got)
    held = [(r.mine >= 0.5) == rows[r.doc_id][3] for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(held) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = toxicity.train(docs, labels)
    b = toxicity.train(docs, labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_rows_without_id_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (4,)], "doc_id long")
    assert [r[0] for r in df.select(toxicity.held_out()).collect()] == [False] + [zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 4)]


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = documents(spark, [(2, f"same id text {i}", "s") for i in range(50)] + [(3, "some other", "s")])
    ids = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert len(toxicity._sampled(docs.select("doc_id", "text"), ids, 7)) == 7
    every = toxicity._sampled(docs.select("doc_id", "text"), ids, 99)
    assert len(every) == 51
    monkeypatch.setattr(toxicity, "SHARE", 1)
    monkeypatch.setattr(toxicity, "SAMPLED", sum(map(len, every)) // 3)
    some = toxicity._sampled(docs.select("doc_id", "text"), ids, 99)
    assert 0 < len(some) < 51 and sum(map(len, some)) <= toxicity.SAMPLED and {x.tobytes() for x in some} <= {x.tobytes() for x in every}  # whole rows, but fewer
    monkeypatch.setattr(toxicity, "SAMPLED", 0)
    assert toxicity._sampled(docs.select("doc_id", "text"), ids, 99) == []


def test_risk_and_gradient_equal_brute_force(monkeypatch):
    """The fitted weights are, but for single precision, those of the same descent on the risk written out, with gradients
    by differences."""
    rng = np.random.default_rng(4)
    x, u = (rng.random((n, 3)) < p for n, p in ((12, [.8, .5, .1]), (30, [.3, .5, .4])))
    x, u = x.astype(np.float32), u.astype(np.float32)

    def parts(v, prior):
        positive, unlabelled = ((rows.astype(float) @ v[:-1] + v[-1]) for rows in (x, u))
        loss = lambda z: np.log(1 + np.exp(-z)).mean()
        return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)

    for prior, steps in ((0.2, 40), (0.8, 40)):  # with the second the corrected part falls below zero
        monkeypatch.setattr(toxicity, "STEPS", steps)
        v, m, s, below = np.append(np.zeros(3), np.log(prior / (1 - prior))), np.zeros(4), np.zeros(4), 0
        for t in range(1, steps + 1):
            clean = parts(v, prior)[1]
            below += clean < 0
            risk = (lambda w: sum(parts(w, prior))) if clean >= 0 else (lambda w: -parts(w, prior)[1])
            g = np.array([(risk(v + d) - risk(v - d)) / 2e-5 for d in np.eye(4) * 1e-5]) + toxicity.DECAY * np.append(v[:-1], 0)
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            v = v - toxicity.RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
        w, b = toxicity.nnpu(x, u, prior)
        assert np.allclose(np.append(w, b), v, atol=2e-2) and (below > 0) == (prior == 0.8)


def test_scores_untidy(untidy, none, spark):
    df, rows = untidy
    labels = spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.train(df, labels), "mine").collect()
    assert len(got) == len(rows) and all(0 <= r.mine <= 1 for r in got)
    assert toxicity.score_documents(none, toxicity.train(none, labels.limit(0)), "mine").count() == 0


# ---------------------------------------------------------------- 10 near duplicates

_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
_A_WORD = regex.compile(rf"(?V1)[[{_ALONE}]&&[\p{{L}}\p{{M}}\p{{N}}]]|[[\p{{L}}\p{{M}}\p{{N}}]--[{_ALONE}]]+")


def shingles(text):
    w = _A_WORD.findall((text or "").lower())
    return np.unique(np.array([hash(tuple(w[k:k + 5])) for k in range(max(1, len(w) - 4))] if w else [], np.int64))


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(doc), str(least.get(find(i))), links[i]) for i, (doc, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    rows, base = [], [[word() for _ in range(120)] for _ in range(3)]
    for i in range(150):
        w = list(base[0 if i < 110 else rng.randrange(3)])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "s"))
    rows += [(200 + i, " ".join(word() for _ in range(rng.randint(1, 60))), "s") for i in range(40)]
    rows += [(300, None, "s"), (301, "", "s"), (302, "!!", "s"), (303, "a b", "s"), (304, "A, b.", "s"), (305, "a b c", "s"), (305, "a b c", "s"), (None, "nobody owns this text today at all", "s")]
    return documents(spark, rows).repartition(3), rows


@pytest.mark.parametrize("paired, block", [(24, 512), (3, 16)])
def test_classes_equal_brute_force(near, paired, block):
    df, rows = near
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in lshforest.near_duplicates(df, recall=0.999999, paired=paired, block=block).collect())
    assert got == brute_classes(rows)


def test_each_set_has_a_prefix_of_its_own():
    for n in range(1, 64):
        pairs = [(b / (n + m - b)) for m in range(1, 90) for b in range(1, min(n, m) + 1) if b < max(n, m) and b / (n + m - b) >= 0.8 - 1e-12]
        assert abs(lshforest.least_similarity(n) - min(pairs, default=1.0)) < 1e-9
    assert len(set(lshforest.prefix_lengths())) >= 4


def test_words_of_many_scripts(spark):
    rng = random.Random(12)
    han = [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(2000)]
    other = list(han)
    other[700] = "好"
    curly = "“one” two—three ‘four’ five … six seven"
    rows = [(1, "".join(han), "s"), (2, "".join(other), "s"), (3, curly, "s"), (4, 'one two three four five six seven', "s"), (5, "naïve café déjà vu", "s"), (6, "हिन्दी में एक छोटा वाक्य", "s"), (7, "हिन्दी में एक छोटा वाक्य।", "s")]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in lshforest.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_classes(rows) and [c for _, c, _ in got] == ["1", "1", "3", "3", "5", "6", "6"]


def test_few_shingles_match_on_longer_prefixes(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    rows = []
    for k in range(60):
        w = [word() for _ in range(rng.randint(5, 14))]
        rows += [(4 * k, " ".join(w), "s"), (4 * k + 1, " ".join(w + [word()]), "s"), (4 * k + 2, " ".join(w[1:]), "s"), (4 * k + 3, " ".join([word()] + w), "s")]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in lshforest.near_duplicates(documents(spark, rows), recall=0.999999).collect())
    assert got == brute_classes(rows) and any(n for *_, n in got)


def test_prefix_is_the_longest_that_meets_enough():
    k = lshforest.prefix_length(0.8, 16, 8, 0.9995)
    met = lambda n: 1 - (1 - 0.8 ** n) ** 16
    assert met(k) >= 0.9995 > met(k + 1)


def test_one_of_each_stays(near):
    df, rows = near
    kept = lshforest.keep_one(df)
    classes = {c for _, c, _ in brute_classes(rows)}
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(classes)


def test_one_row_stays_where_ids_are_repeated_or_null(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, c), (7, c + " more"), (None, c + " less"), (None, d), (None, d + " more"), (None, d), (8, None), (8, "")]
    kept = lshforest.keep_one(documents(spark, [(i, t, "s") for i, t in rows]))
    got = sorted((str(r.doc_id), (r.text or "")[:2]) for r in kept.collect())
    assert got == [("1", "a0"), ("5", "b0"), ("7", "c0"), ("8", ""), ("None", "d0")]


def test_near_duplicates_of_nothing(none):
    assert lshforest.near_duplicates(none).count() == 0 and lshforest.keep_one(none).count() == 0


def test_components_of_a_chain(spark):
    from folioframe.llm.common import Scratch

    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z")], "u string, v string")
    got = {r.c: r.root for r in lshforest.components(edges, Scratch(spark, "test")).collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 61


# ---------------------------------------------------------------- the pipeline

def test_pipeline_stage_by_stage(spark, sf, ids_of):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, sf).persist()
        assert after.columns == columns
        a, b = before.toPandas(), after.toPandas()
        if name == "toxicity":
            scores = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet")).score(a.text.tolist())
            assert sorted(b.doc_id) == sorted(a.doc_id[scores < 0.5])
        elif name == "near_duplicates":
            rows = list(zip(a.doc_id.tolist(), a.text, a.source))
            assert sorted(map(str, b.doc_id)) == sorted({c for _, c, _ in brute_classes(rows)})
        else:
            size, target = brute_targets(list(zip(a.doc_id, a.text, a.source)))
            words = b.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).groupby(b.source).sum()
            largest = a.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).groupby(a.source).max()
            assert all(abs(words.get(s, 0) - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
        before = after
    pieces = corpus_pipeline.STAGES[3][1](spark, before, sf).toPandas()
    assert pieces.length.sum() == sum(len(ids_of(t)) + 1 for t in before.toPandas().text)
    fill = pieces.groupby("sequence_id").length.sum()
    assert ((fill == 1024) | ((fill & (fill - 1)) == 0)).all()


def test_pipeline_on_untidy_tables(untidy, spark, tmp_path, ids_of):
    df, rows = untidy
    labels = [(4, 1), (4, 1), (None, 1), (203, None)] + [(k, 0) for k in range(100, 140)] + [(k, 0) for k in range(204, 240)]  # few are toxic
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, str(tmp_path)).persist()
        assert after.columns == df.columns and {str((r.doc_id, r.text)) for r in after.collect()} <= {str((i, t)) for i, t, _ in rows} and all(r.target == "own" for r in after.take(3))
        assert after.count() > 20
        before = after
    assert corpus_pipeline.STAGES[3][1](spark, before, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text or "")) + 1 for r in before.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_nothing(none, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
