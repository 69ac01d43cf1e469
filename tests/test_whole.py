"""Queries over whole tables, against brute force on tables of a few rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from folioframe.plans import data_queries, text_queries, tree_queries


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def deliveries(spark, tmp_path_factory):
    """Edges (id, source, target) and the folder of their tables; two rows have the same id."""
    rng = random.Random(7)
    rows = [(k, rng.randint(1, 12), rng.randint(1, 15), rng.randint(1, 4), "N", "O") for k in range(1, 60)] + [(60, 7, 1, 1, "N", "O"), (60, 7, 1, 1, "R", "F")]
    folder = saved(spark, tmp_path_factory.mktemp("deliveries"), lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
                   supplier=([(k, f"Supplier#{k:09d}") for k in range(1, 16)], "s_suppkey long, s_name string"), part=([(k, f"part {k}", "STEEL") for k in range(1, 13)], "p_partkey long, p_name string, p_type string"))
    return [(f"e-{o}-{n}-{p}-{s}", f"s{s}", f"p{p}") for o, p, s, n, _, _ in rows], folder


def around(edges):
    near = defaultdict(list)
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)
    return near


def test_entity_first_follows_every_edge(spark, deliveries):
    edges, folder = deliveries
    near, hop = around(edges), {"s1": 0, "p7": 0}
    for k in (1, 2):
        hop |= {y: k for x in list(hop) for y in near[x] if y not in hop}
    want = {(x, k, {"s1": 0.9, "p7": 0.8}.get(x, 0.0), len(near[x])) for x, k in hop.items()}
    assert {tuple(r) for r in data_queries.entity_first(spark, folder).collect()} == want


def test_fts_entity_follows_every_edge(spark, deliveries):
    edges, folder = deliveries
    near, hits = around(edges), {f"s{k}" for k in range(1, 10)}
    want = {(x, 0, 1.0, len(near[x])) for x in hits} | {(y, 1, 0.0, min(3, len(near[y]))) for x in hits for y in near[x]}
    got = data_queries.fts_entity(spark, folder).select("entity_id", "hop", "score", "n_edges")
    assert {tuple(r) for r in got.collect()} == want


def test_relationship_first_follows_every_edge(spark, deliveries):
    edges, folder = deliveries
    seeds, seen, want = sorted(edges)[:10], set(), []
    for x, a, b in seeds:
        want.append((x, 0, None, None))
    for x, a, b in seeds:
        for via in (a, b):
            if via not in seen:
                seen.add(via)
                first = sorted((i, t if s == via else s) for i, s, t in edges if via in (s, t))[:3]
                want += [(i, 1, via, other) for i, other in first if other not in seen]
    got = [(r.id, r.hop, r.via, r.other_id) for r in data_queries.relationship_first(spark, folder).collect()]
    assert Counter(got) == Counter(want)


def test_edges_of_every_order(spark, deliveries):
    edges, folder = deliveries
    want = Counter((i, t) for i, s, t in edges if s == "s1")
    assert Counter(tuple(r) for r in data_queries.edges_of(spark, folder).collect()) == want
    want = Counter((i, t) for i, s, t in edges if s in ("s1", "s2", "s3", "s4") or t == "p7")
    assert Counter(tuple(r) for r in data_queries.edges_of_any(spark, folder).collect()) == want and max(want.values()) == 2


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def letters(spark, tmp_path_factory):
    """Documents (doc_id, text, lang, source) and the folder of their table."""
    texts = ["a long line that goes on after its fortieth character without an end\nab\n\nx", "short", "t" * 130, "  two\twords", "odd", ""]
    rows = [(k, texts[k % 6] + "!" * (k // 6), "en", f"s{k % 2}") for k in range(40)]
    return rows, saved(spark, tmp_path_factory.mktemp("letters"), documents=([(*r, len(r[1])) for r in rows], DOC))


def test_upload_takes_every_document(spark, letters):
    rows, folder = letters
    want = {(f"{s}/{lang}/{i}.txt", hashlib.sha256((t + "+").encode()).hexdigest(), len(t) + 1, 2.0 if len(t) % 2 else 1.0, 2.0) for i, t, lang, s in rows}
    got = data_queries.upload_files(spark, folder).select("key", "content_hash", "size", "created_at", "modified_at")
    assert {tuple(r) for r in got.collect()} == want


def test_spans_cover_every_line(spark, letters):
    rows, folder = letters
    want = Counter((i, k, float(k), line) for i, t, *_ in rows for k, line in enumerate(t.split("\n")) if line)
    assert Counter(tuple(r) for r in text_queries.layout_spans(spark, folder).select("book_id", "page_index", "y0", "content").collect()) == want
    want = {}
    for i, t, *_ in rows:
        at = 0
        for line in t.split("\n"):
            if line.strip():
                want.setdefault(i, []).append(at + len(line) - len(line.lstrip()))
            at += len(line) + 1
    got = text_queries.locate_spans(spark, folder).select("book_id", "n", "low", "high")
    assert {tuple(r) for r in got.collect()} == {(i, len(x), x[0], x[-1]) for i, x in want.items()}


def test_whole_texts_are_summaries_and_titles(spark, letters):
    rows, folder = letters
    names = {s for *_, s in rows}
    longest = {s: max((r for r in rows if r[3] == s), key=lambda r: (len(r[1]), -r[0]))[1] for s in names}
    assert {r.name_key: r.summary for r in data_queries.merge_by_name(spark, folder).collect()} == longest
    last = {s: max((r for r in rows if r[3] == s and r[0] % 7 == 0 and r[1].strip()), key=lambda r: r[0])[1] for s in names}
    assert {r.book: r.title for r in data_queries.merge_metadata(spark, folder).collect()} == last
    got = tree_queries.toc(spark, folder).select("doc_id", "title", "level")
    assert {tuple(r) for r in got.collect()} == {(i, t, max(i % 4 - 1, 1)) for i, t, *_ in rows if t.strip()}


def test_cycles_are_violations(spark, tmp_path):
    texts = [(k, "\n".join(f"line {i}" for i in range(k % 9)), "en", "s", 0) for k in range(60)]
    folder = saved(spark, tmp_path, documents=(texts, DOC))
    nodes = []
    for r in tree_queries.build_tree(spark, folder).collect():
        n, x = r.book_id * 31 + int(r.id.split("/")[1]), r.asDict()
        if r.level == 2 and n % 11 == 0:
            x["parent_id"] = "nowhere"
        if r.level == 1:
            x |= {"parent_id": r.id} if n % 23 == 0 else {}
            x |= {"level": 0} if n % 13 == 0 else {}
            x |= {"order_index": 0} if n % 17 == 0 else {}
        x |= {"content_length": -1} if n % 19 == 0 else {}
        nodes.append(x)
    by_id = {x["id"]: x for x in nodes}
    place = Counter((x["book_id"], x["parent_id"], x["order_index"]) for x in nodes)
    want = Counter()
    for x in nodes:
        up, seen = x, set()
        while up is not None and up["id"] not in seen:
            seen.add(up["id"])
            up = by_id.get(up["parent_id"])
        parent = by_id.get(x["parent_id"])
        want.update(p for p, holds in {
            "cycle": up is not None, "negative length": x["content_length"] < 0, "missing parent": x["parent_id"] == "nowhere", "level order": parent is not None and x["level"] <= parent["level"],
            "sibling order": x["parent_id"] != "" and place[x["book_id"], x["parent_id"], x["order_index"]] > 1}.items() if holds)
    assert {r.problem: r.n for r in tree_queries.tree_violations(spark, folder).collect()} == dict(want)
    assert want["cycle"] > sum(x["parent_id"] == x["id"] for x in nodes) > 0
