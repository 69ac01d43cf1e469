"""Keyed writes with repeated and null keys, bad input files, trees of any depth, summaries, merging and stored vectors."""

import glob
import io
import json
import os
import random
import zipfile

import numpy as np
import pytest

from folioframe import compiler
from folioframe.operators import cas, paths, progress, summary, tables, tree, usage, vector
from folioframe.operators.vectorindex import VectorIndex
from folioframe.sources import epub, files, pdf

NODE = "id string, book_id string, parent_id string, level int, order_index int, title string, title_offset long, title_length long, content_offset long, content_length long"


def test_last_row_of_a_key_wins(spark):
    old = spark.createDataFrame([(None, "n0"), (1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 9), (2, "z", 1), (None, "p", 2), (None, "q", 1), (4, "w", 0), (1, "u", 7)], "k int, v string, at int")
    got = tables.upsert(old, new, ["k"], ["at"]).collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "p"), (1, "y"), (2, "z"), (3, "c"), (4, "w")]
    assert sorted((r.k or 0, r.v) for r in tables.upsert(old, new.coalesce(1), ["k"]).collect()) == [(0, "q"), (1, "u"), (2, "z"), (3, "c"), (4, "w")]
    assert tables.upsert(old, new.limit(0), ["k"]).count() == 4 and tables.upsert(old.limit(0), new, ["k"]).count() == 4


def test_upload_of_equal_keys(spark):
    index = spark.createDataFrame([("a", "h", 1, 1.0, 1.0)], "key string, content_hash string, size long, created_at double, modified_at double")
    blobs = spark.createDataFrame([("h", b"old")], "content_hash string, content binary")
    new = spark.createDataFrame([("a", b"first", 3.0, 3.0), ("/a", b"second", 4.0, 4.0), ("b", b"second", 5.0, 5.0)], "key string, content binary, created_at double, modified_at double")
    left, stored = cas.upload(index, blobs, new)
    rows = {r.key: r for r in left.collect()}
    assert left.count() == 2 and rows["a"].size == 6 and (rows["a"].created_at, rows["a"].modified_at) == (1.0, 4.0) and rows["a"].content_hash == rows["b"].content_hash
    assert sorted(bytes(r.content) for r in stored.collect()) == [b"old", b"second"]


def test_repeated_changes(spark):
    m = spark.createDataFrame([("b", "chunk", "pending", 0, "", None, 1.0)], "book_id string, index_type string, status string, count long, error string, built_at double, created_at double")
    changes = spark.createDataFrame([("b", "chunk", "running", 1, ""), ("b", "chunk", "built", 2, "")], "book_id string, index_type string, status string, count long, error string").coalesce(1)
    assert [(r.status, r["count"], r.built_at, r.created_at) for r in tables.upsert_manifest(m, changes, 7.0).collect()] == [("built", 2, 7.0, 1.0)]
    log = spark.createDataFrame([(1, None, None), (2, 3, 4)], "id long, actual_in long, actual_out long")
    actual = spark.createDataFrame([(1, 5, 5), (1, 6, 7)], "id long, actual_in long, actual_out long").coalesce(1)
    assert sorted(map(tuple, usage.record_actual(log, actual).collect())) == [(1, 6, 7), (2, 3, 4)]


def test_trees_are_checked_before_they_are_replaced(spark):
    node = lambda i, up, level: (i, "b", up, level, 0, "t", 0, 0, 0, 1)
    old, content = spark.createDataFrame([node("r", "", 0), node("x", "r", 1)], NODE), spark.createDataFrame([("b", "text")], "book_id string, text string")
    assert sorted(r.id for r in tree.replace_tree(old, spark.createDataFrame([node("s", "", 0)], NODE), content).collect()) == ["s"]
    with pytest.raises(ValueError, match="level order"):
        tree.replace_tree(old, spark.createDataFrame([node("s", "", 0), node("y", "s", 0)], NODE), content)


# ---------------------------------------------------------------- depth

def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    nodes = spark.range(n).selectExpr("cast(id as string) id", "'b' book_id", "if(id = 0, '', cast(id - 1 as string)) parent_id", "cast(id as int) level", "0 order_index", "'t' title",
                                      "0L title_offset", "0L title_length", "0L content_offset", "0L content_length").repartition(4)
    found = tree.with_paths(nodes).selectExpr("id", "length(path) n").collect()
    assert len(found) == n and all(r.n == 7 * int(r.id) + 6 for r in found)
    assert tree.violations(nodes).count() == 0
    assert tree.descendants(nodes, "9000").count() == 999


def test_cycles_and_strays(spark):
    links = spark.createDataFrame([("r", None), ("a", "r"), ("x", "y"), ("y", "x"), ("below", "x"), ("self", "self"), ("stray", "gone"), ("s2", "stray")], "id string, up string").selectExpr("*", "id step")
    assert {r.id: r.looped for r in paths.reached(links).collect()} == {"r": False, "a": False, "x": True, "y": True, "below": True, "self": True}
    assert {r.id: r.path for r in paths.root_paths(links).collect()} == {"r": "r", "a": "r.a"}
    assert paths.root_paths(links.limit(0)).count() == 0
    node = lambda i, up: (i, "b", up, 1, 0, "t", 0, 0, 0, 1)
    with pytest.raises(ValueError, match="cycle"):
        tree.with_paths(spark.createDataFrame([node("r", ""), node("x", "y"), node("y", "x")], NODE))


def test_random_forests(spark):
    rng = random.Random(3)
    up = {i: rng.randrange(max(0, i - 5), i) if i % 40 else None for i in range(400)}
    want = {i: [i] for i in up}
    for i in up:
        while up[want[i][0]] is not None:
            want[i].insert(0, up[want[i][0]])
    rows = spark.createDataFrame([(i, u, str(i)) for i, u in up.items()], "id int, up int, step string")
    assert {r.id: r.path for r in paths.root_paths(rows).collect()} == {i: ".".join(map(str, w)) for i, w in want.items()}


def test_rollup_goes_down_all_levels(spark):
    schema = "id string, parent_id string, seq int, total double, completed double, auto_total boolean, status string, started_at double, label string"
    rows = [(str(i), str(i - 1) if i else None, 0, 2.0 if i == 99 else 0.0, 1.0 if i == 99 else 0.0, i < 99, "running", 0.0, "x") for i in range(100)]
    got = progress.rollup(spark.createDataFrame(rows, schema), 10.0).collect()
    assert len(got) == 100 and {r.total for r in got} == {2.0} and max(r.depth for r in got) == 99
    with pytest.raises(ValueError, match="cycle"):
        progress.rollup(spark.createDataFrame([*rows, ("p", "q", 0, 0.0, 0.0, True, "x", 0.0, "x"), ("q", "p", 0, 0.0, 0.0, True, "x", 0.0, "x")], schema), 10.0)
    assert {r.id: r.depth for r in progress.rollup(spark.createDataFrame([("k", "gone", 0, 1.0, 0.0, False, "x", 0.0, "x")], schema), 1.0).collect()} == {"k": 0}


# ---------------------------------------------------------------- bad input

def book(title, encrypted=False):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", f"<html><body><h1>{title}</h1><p>words</p></body></html>")
    raw = bytearray(data.getvalue())
    if encrypted:  # the flag of encryption in every header
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            i = raw.find(mark)
            while i >= 0:
                raw[i + at] |= 1
                i = raw.find(mark, i + 4)
    return bytes(raw)


def test_unreadable_books_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    broken = bytearray(book("x"))
    broken[60:90] = b"?" * 30
    for name, data in (("good", book("good")), ("locked", book("locked", True)), ("none", b"no zip"), ("broken", bytes(broken))):
        (tmp_path / "in" / f"{name}.epub").write_bytes(data)
    rows = epub.read(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 4 and [r.title for r in rows if not r.error] == ["good"] and sum(bool(r.error) for r in rows) == 3
    made = compiler.compile_epubs(spark, str(tmp_path / "in"), str(tmp_path / "data"), ["chunk"])
    failed = [r for r in made.tasks.collect() if r.status == "failed"]
    assert made.content.count() == 1 and len(failed) == 3 and all(r.book_id and ".epub: " in r.error for r in failed)
    assert {r.stage for r in made.tasks.collect() if r.status == "done"} == {"parse", "tree", "chunk"}


def test_progress_is_told_while_a_compile_runs(spark, tmp_path):
    from folioframe import registry

    (tmp_path / "in").mkdir()
    for name, data in (("a", book("A")), ("b", book("B")), ("bad", b"no zip")):
        (tmp_path / "in" / f"{name}.epub").write_bytes(data)
    data, seen = str(tmp_path / "data"), []

    def build(nodes, content):
        seen.append(([(r.completed, r.total) for r in compiler.read_tasks(spark, data).filter("stage = 'late'").collect()], {r.stage: (r.rows, r.warnings) for r in compiler.read_progress(spark, data).collect()}))
        return {"late_rows": nodes.select("book_id", "id")}

    providers = registry.IndexRegistry([*registry.PROVIDERS, registry.IndexProvider("late", "L", build)])
    made = compiler.compile_epubs(spark, str(tmp_path / "in"), data, ["chunk", "late"], providers)
    at, rows = seen[0]
    assert at == [(3, 4)] and rows["parsed"] == (3, 1) and rows["nodes"] == (4, 0) and "late_rows" not in rows
    last = [r for r in made.tasks.collect() if r.stage == "late"][0]
    assert (last.completed, last.total, last.status) == (4, 4, "done")
    after = {r.stage: (r.rows, r.warnings) for r in compiler.read_progress(spark, data).collect()}
    assert after["late_rows"] == (4, 0) and after["chunks"][0] == made.indexes["chunks"].count()
    assert sorted((r.nodes, r.deepest, r.warnings) for r in compiler.metrics(made.nodes, made.content).collect()) == [(2, 1, 0), (2, 1, 0)]


def test_bad_layouts(spark):
    good = json.dumps({"pdf_info": [{"page_idx": 0, "spans": [{"content": "two", "bbox": [0, 0, 1, 1]}]}]})
    odd = json.dumps({"pdf_info": [{"page_idx": "x", "spans": [{"content": "two", "bbox": [0, 0, "?", 1]}]}]})
    rows = spark.createDataFrame([("a", 0, 0, "one two", good), ("a", 1, 1, "bad", "{not json"), ("a", 2, 2, "two", good), ("b", 0, 0, "two", odd), ("c", 0, 0, None, None), ("d", 0, 0, "two", "[]")],
                                 "book_id string, batch int, first int, markdown string, layout string")
    assert sorted((r.book_id, r.content) for r in pdf.layout_spans(rows).collect()) == [("a", "two"), ("a", "two")]
    kept = pdf.layout_spans(rows, errors="keep").filter("error <> ''").collect()
    assert sorted(r.book_id for r in kept) == ["a", "b"] and all(r.content is None and r.error.split(":")[0].endswith("Error") for r in kept)
    assert sorted((r.content_offset, r.page_index) for r in pdf.span_mappings(rows).collect()) == [(4, 0), (10, 2)]
    assert pdf.span_mappings(rows, errors="keep").filter("error <> ''").count() == 2
    with pytest.raises(Exception, match="JSONDecodeError|invalid literal"):
        pdf.layout_spans(rows, errors="fail").collect()
    with pytest.raises(ValueError):
        pdf.layout_spans(rows, errors="other")


def test_archives(spark):
    def archive(*members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in members:
                z.writestr(name, text)
        return data.getvalue()

    markdown, layout, errors = pdf.unpack(archive(("a.md", "first"), ("b.md", "second"), ("x_layout.json", '{"n": 1}'), ("x_middle.json", '{"n": 2}'), ("y_layout.json", "{broken")))
    assert (markdown, layout) == ("first", '{"n": 2}') and errors.startswith("y_layout.json: JSONDecodeError")
    got = {r.k: r for r in pdf.unpacked(spark.createDataFrame([(1, archive(("a.md", "x"))), (2, b"none"), (3, None)], "k int, content binary")).collect()}
    assert (got[1].markdown, got[1].error) == ("x", "") and got[2].markdown == "" and got[2].error.startswith("BadZipFile") and got[3].error


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        files.shared_dir(Unset)


# ---------------------------------------------------------------- summaries

def test_summaries_follow_the_tree(spark):
    from pyspark.sql import functions as F

    shout = lambda c: F.upper(c)
    text = "root own" + "   " + "leaf" + "   " + "deep"
    node = lambda i, up, level, order, title, at, n: (i, "b", up, level, order, title, 0, 0, at, n)
    nodes = spark.createDataFrame([node("r", "", 0, 0, "R", 0, 8), node("blank", "r", 1, 0, "B", 8, 3), node("leaf", "r", 1, 1, "L", 11, 4), node("mid", "r", 1, 2, "M", 15, 3), node("deep", "mid", 2, 0, "D", 18, 4),
                                   node("none", "r", 1, 3, "N", 0, 0)], NODE)
    got = {r.node_id: r.summary for r in summary.summarise_tree(nodes, spark.createDataFrame([("b", text)], "book_id string, text string"), shout).collect()}
    assert got == {"deep": "DEEP", "mid": "[D] DEEP", "leaf": "LEAF", "r": "ROOT OWN\n\n[L] LEAF\n[M] [D] DEEP"}
    quiet = summary.summarise_tree(nodes, spark.createDataFrame([("b", text)], "book_id string, text string"), lambda c: F.when(c == "deep", "x"))
    assert {r.node_id: r.summary for r in quiet.collect()} == {"deep": "x"}


def test_budget_without_the_overhead(spark):
    from pyspark.sql import functions as F

    long = "\n\n".join(["a" * 40, "skip" * 10, "b" * 40])
    rows = spark.createDataFrame([(1, "c" * 40), (2, long), (3, "\n\n".join(["skip" * 10, "b" * 40]))], "id int, text string")
    mark = lambda c: F.when(c.contains("skip"), "").otherwise(F.concat(F.lit("<"), F.substring(c, 1, 3), F.lit(">")))
    got = {r.id: r.summary for r in summary.within_budget(rows, mark, budget=22, overhead=11).collect()}
    assert got == {1: "<ccc>", 2: "<<aa>", 3: "<bbb>"}
    assert {r.id: r.summary for r in summary.within_budget(rows, mark, budget=200, overhead=0).collect()}[2] == ""


# ---------------------------------------------------------------- vectors

def greedy(rows, at_least):
    out, reps = {}, []
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        near = [r for h, r, w in reps if h == g and float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= at_least]
        out[k] = near[0] if near else k
        reps += [] if near else [(g, k, v)]
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "equal"])
def test_greedy_merge(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "random":
        rows = [(int(rng.integers(3)), i, rng.standard_normal(4).tolist()) for i in range(150)]
    elif kind == "chain":  # each is similar to the next one only
        rows = [(0, i, [float(np.cos(i / 10)), float(np.sin(i / 10))]) for i in range(15)]
    else:
        rows = [(0, i, [1.0, 2.0]) for i in range(40)]
    at = 0.8 if kind != "chain" else float(np.cos(0.11))
    df = spark.createDataFrame(rows, "g int, id long, vector array<double>").repartition(3)
    assert {r.id: r.representative for r in vector.greedy_merge(df, at, "g").collect()} == greedy(rows, at)
    assert vector.greedy_merge(df.limit(0), at, "g").count() == 0


@pytest.mark.parametrize("at_least", [0.9, 0.3, 0.0, -0.5])
def test_similar_pairs_in_cells(spark, at_least):
    rng = np.random.default_rng(6)
    ways = rng.standard_normal((10, 8)) * 3
    rows = [(None if i % 97 == 0 else i % 2, i, (ways[i % 10] + 0.4 * rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(0, 1000, [0.0] * 8), (0, 1001, [1.0, 2.0]), (0, 1002, [2.0, 4.0]), (1, 1003, []), (1, 1004, None), (0, 1005, rows[1][2]), (0, 1006, [0.0] * 8)]
    df = spark.createDataFrame(rows, "g int, id long, vector array<double>").repartition(3)
    cos = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) if np.linalg.norm(v) and np.linalg.norm(w) else 0.0
    want = {(i, j) for g, i, v in rows for h, j, w in rows if g == h and i < j and v and w and len(v) == len(w) and cos(v, w) >= at_least}
    for block in (1024, 7):
        got = vector.similar_pairs(df, at_least, "g", block=block).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and all(abs(r.cosine - cos(rows_of(rows, r.a), rows_of(rows, r.b))) < 1e-9 for r in got)
    plain = df.select("g", df.id.alias("k"), df.vector.alias("v"))
    met = [r.met for r in vector.in_cells(plain.filter("g = 1 and size(v) = 8"), at_least, 7)[1].collect()]
    assert len(met) > 100 and any(met) if at_least > 0 else all(met)
    assert at_least < 0.9 or sum(met) < 0.5 * len(met)  # most pairs of cells are left out


def rows_of(rows, i):
    return next(v for _, k, v in rows if k == i)


def nearest(rows, queries, k, label=None):
    out = []
    for q, v in queries:
        found = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), i) for i, x, g in rows.values() if label is None or g == label)[:k]
        out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(found)]
    return sorted(out)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 6)) * 50
    return {i: (i, (centers[i % 12] + rng.standard_normal(6)).tolist(), int(i % 5)) for i in range(n)}


VECTORS = "id long, vector array<double>, label int"


def test_stored_vectors_are_kept_up(spark, tmp_path):
    rows = clustered(600, 1)
    frame = lambda some: spark.createDataFrame(list(some), VECTORS)
    index = VectorIndex(spark, f"file://{tmp_path}/vectors")
    assert index.nearest(frame(rows.values()).selectExpr("id query", "vector"), 3).count() == 0
    index.build(frame([*rows.values(), (9001, None, 1), (9002, [float("nan")] * 6, 1), (9003, [1.0], 1)]))
    queries = [(q, rows[q][1]) for q in range(0, 600, 37)] + [(-1, [1e3] * 6)]
    asked = spark.createDataFrame(queries + [(-2, None), (-3, [1.0])], "query long, vector array<double>")
    got = lambda **f: sorted((r.query, r.rank, r.id, round(r.distance, 9)) for r in index.nearest(asked, 7, **f).collect())
    assert got() == nearest(rows, queries, 7) and got(label=3) == nearest(rows, queries, 7, 3)
    n_cells = index.rows().select("cell").distinct().count()
    seen = {r.query: r.cells for r in index.nearest(asked, 7).collect()}
    assert n_cells > 15 and sum(v for q, v in seen.items() if q >= 0) < 0.4 * n_cells * (len(seen) - 1)  # most cells are ruled out

    def stamps():
        return {os.path.basename(d): sorted(os.listdir(d)) for d in glob.glob(f"{tmp_path}/vectors/rows/cell=*")}

    before = stamps()
    moved = [(0, rows[7][1], 0), (12, [float(x) for x in rows[12][1]][::-1], 2), (12, rows[13][1], 4), (5000, rows[1][1], 1)]
    index.upsert(frame(moved).coalesce(1))
    rows |= {0: moved[0], 12: moved[2], 5000: moved[3]}
    after = stamps()
    assert 0 < sum(before.get(c) != after.get(c) for c in before.keys() | after.keys()) <= 6
    assert got() == nearest(rows, queries, 7)
    gone = [i for i in rows if i % 12 == 5] + [99_999]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    rows = {i: r for i, r in rows.items() if i not in gone}
    assert got() == nearest(rows, queries, 7) and got(label=1) == nearest(rows, queries, 7, 1)
    assert index.rows().count() == len(rows) and sum(n for _, n in index._about().values()) == len(rows)
    assert [r.id for r in index.search(rows[24][1], 2).collect()][0] == 24


def test_ties_and_equal_vectors(spark, tmp_path):
    rows = {i: (i, [1.0, 1.0] if i % 3 else [2.0, float(i)], 0) for i in range(60)}
    index = VectorIndex(spark, f"file://{tmp_path}/vectors")
    index.build(spark.createDataFrame(list(rows.values()), VECTORS), cells=4)
    queries = [(1, [1.0, 1.0]), (2, [2.0, 0.0])]
    got = index.nearest(spark.createDataFrame(queries, "query long, vector array<double>"), 50).collect()
    assert sorted((r.query, r.rank, r.id, round(r.distance, 9)) for r in got) == nearest(rows, queries, 50)
    index.upsert(spark.createDataFrame([], VECTORS))
    index.delete(spark.createDataFrame([(i,) for i in range(60)], "id long"))
    assert index.nearest(spark.createDataFrame(queries, "query long, vector array<double>"), 5).count() == 0


# ---------------------------------------------------------------- answers and retrieval

def test_answers_are_salvaged(spark):
    from folioframe import models

    rows = ['```json\n{"title": "a", "extras": {"x": "1"}}\n```', '{"title": "a"}}', '{"title": "a"}, {"title": "b"}', '{"title": {"b": 1}}', '{"extras": 5}', "none", "", None, '{"title": null}', 'so {"author": "q"} it is']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string")
    got = {r.i: r.x for r in df.select("i", models.parsed(df.a, models.ANSWER).alias("x")).collect()}
    assert {i for i, x in got.items() if x is not None} == {0, 3, 8, 9} and got[0].title == "a" and got[0].extras == {"x": "1"} and got[9].author == "q"


def test_rounds_stop(spark):
    from pyspark.sql import functions as F

    from folioframe import models

    docs = spark.createDataFrame([("full", "A" * 100), ("late", "B" * 2000 + "A" * 10), ("never", "C" * 9000), ("none", None)], "book_id string, text string")
    whole = '{"title": "t", "author": "a", "language": "l", "publisher": "p", "description": "d"}'
    ask = lambda c: F.when(c.startswith("A"), whole).when(c.startswith("B"), '{"title": "old", "author": " ", "extras": {"k": "v", "e": ""}}').otherwise("{broken")
    got = {r.book_id: r for r in models.metadata_rounds(docs, ask).collect()}
    assert {k: (r.rounds, r.failures, r.stopped, r.title) for k, r in got.items()} == {
        "full": (1, 0, "complete", "t"), "late": (2, 0, "complete", "t"), "never": (3, 3, "rounds", ""), "none": (1, 1, "text", "")}
    assert got["late"].extras == {"k": "v"} and models.metadata_rounds(docs.limit(0), ask).count() == 0


EDGE = "id string, source_entity_id string, target_entity_id string, relation_type string, summary string, source_chunk_id string"


@pytest.mark.parametrize("share", [3, 4096])
def test_many_queries_equal_one_by_one(spark, share):
    from folioframe.operators import graph, retrieval

    rng = random.Random(9)
    ends = [(rng.choice(["hub", f"n{rng.randrange(60)}"]), f"n{rng.randrange(60)}") for _ in range(150)] + [("loop", "loop"), ("n1", "n2"), ("n1", "n2")]
    edges = spark.createDataFrame([(f"e{i:03d}", a, b, "r", "s", "c") for i, (a, b) in enumerate(ends)], EDGE)
    seeds = [(q, f"n{rng.randrange(60)}", rng.random()) for q in (1, 2, 3) for _ in range(2)] + [(4, "hub", 1.0), (4, "hub", 0.5), (5, "alone", 0.1), (6, "loop", 0.2), (7, None, 1.0)]
    found = retrieval.entity_first(edges, spark.createDataFrame(seeds, "query int, entity_id string, score double"), 2, share)
    got = {}
    for r in found.collect():
        got.setdefault(r.query, set()).add((r.entity_id, r.hop, r.score))
    many = {(r.query, r.entity_id): [] for r in found.collect()}
    for r in retrieval.entity_edges(found, edges).collect():
        many[r.query, r.entity_id].append(r.id)
    for q in (1, 4, 5, 6):
        one = graph.entity_first(edges, spark.createDataFrame([s[1:] for s in seeds if s[0] == q], "entity_id string, score double"), 2).collect()
        assert got[q] == {(r.entity_id, r.hop, r.score) for r in one}
        assert all(sorted(many[q, r.entity_id]) == [e.id for e in r.relationships] for r in one)
    assert 7 not in got
    ranked = spark.createDataFrame([(q, k, f"e{rng.randrange(150):03d}", 0.5) for q in (1, 2, 3) for k in range(1, 5)] + [(1, 9, "gone", 0.1)], "query int, rank int, id string, score double").dropDuplicates(["query", "id"])
    every = retrieval.relationship_first(edges, ranked)
    for q in (1, 2, 3):
        one = graph.relationship_first(edges, ranked.filter(f"query = {q}").drop("query"))
        assert sorted(str(tuple(r)) for r in one.collect()) == sorted(str(tuple(r)) for r in every.filter(f"query = {q}").select(*one.columns).collect())
    entities = spark.createDataFrame([(f"n{i}", 1, f"Name {i}", "x" if i % 2 else None) for i in range(60)] + [("hub", 1, None, None)], "id string, book_id int, name string, summary string")
    texts = [(1, "NAME 5"), (2, "x"), (3, "nothing"), (4, ""), (5, None)]
    text = retrieval.text_first(entities, edges, spark.createDataFrame(texts, "query int, text string"), 4, share=share).collect()
    for q, t in texts[:4]:
        one = graph.fts_first(entities, edges, t, 4).collect()
        assert sorted((r.entity_id, r.hop, r.score) for r in text if r.query == q) == sorted((r.entity_id, r.hop, r.score) for r in one)
    assert not [r for r in text if r.query == 5]
