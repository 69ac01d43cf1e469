import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe import models
from folioframe.functions import urls
from folioframe.operators import cas, convo, graph, summary, tables, usage, vector
from folioframe.sources import epub, markup, pdf
from folioframe.sources.files import Config, loose_files
from folioframe.streaming import streams


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_greedy_merge_equals_a_plain_pass(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(120)], "id long, g long, vector array<double>")
    got = {r.id: r.representative for r in vector.greedy_merge(df, 0.7, "g").collect()}
    want, reps = {}, []
    for i in range(120):
        want[i] = next((r for r in reps if r % 2 == i % 2 and v[r] @ v[i] >= 0.7), i)
        if want[i] == i:
            reps.append(i)
    assert got == want
    blocks = vector.similar_pairs(df, 0.7, "g", block=16)
    assert {(r.a, r.b) for r in blocks.collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and v[i] @ v[j] >= 0.7}


def test_merge_by_name(spark):
    rows = [(0, "Kant", ["philosopher"], "German philosopher"), (1, " kant ", ["18th century", "philosopher"], ""), (2, "Hegel", [], "")]
    raw = spark.createDataFrame([("b", i, n, "Person", t, s, "c", "n") for i, n, t, s in rows], "book_id string, seq int, name string, entity_type string, tags array<string>, summary string, source_chunk_id string, source_node_id string")
    got = {r.name: (r.tags, r.summary) for r in graph.merge_by_name(raw).collect()}
    assert got == {"Kant": (["philosopher", "18th century"], "German philosopher"), "Hegel": ([], "")}


@pytest.fixture(scope="module")
def ring(spark):
    edges = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a"), ("e4", "c", "d"), ("e5", "d", "e"), ("e6", "a", "x1"), ("e7", "a", "x2")]
    return spark.createDataFrame([(i, s, t, "r", "", "") for i, s, t in edges], "id string, source_entity_id string, target_entity_id string, relation_type string, summary string, source_chunk_id string")


def test_breadth_first_takes_the_smallest_hop(spark, ring):
    seeds = spark.createDataFrame([("a", 0.5)], "entity_id string, score double")
    got = {r.entity_id: (r.hop, r.score, len(r.relationships)) for r in graph.entity_first(ring, seeds, 2).collect()}
    assert got == {"a": (0, 0.5, 4), "b": (1, 0.0, 2), "c": (1, 0.0, 3), "x1": (1, 0.0, 1), "x2": (1, 0.0, 1), "d": (2, 0.0, 2)}


def test_relationship_first_is_sequential(spark, ring):
    seeds = spark.createDataFrame([(0, "e1", 0.9), (1, "e2", 0.8)], "rank int, id string, score double")
    got = [(r.id, r.hop, r.via, r.other_id) for r in graph.relationship_first(ring, seeds).collect()]
    assert got[0] == ("e1", 0, None, None) and ("e1", 1, "a", "b") in got and ("e1", 1, "b", "a") not in got and ("e2", 1, "b", "c") in got


def test_cas_round(spark):
    index = spark.createDataFrame([], "key string, content_hash string, size long, created_at double, modified_at double")
    blobs = spark.createDataFrame([], "content_hash string, content binary")
    files = spark.createDataFrame([("/books/a", bytearray(b"x"), 1.0, 1.0), ("books/b", bytearray(b"x"), 1.0, 1.0), ("c", bytearray(b"y"), 1.0, 1.0)], "key string, content binary, created_at double, modified_at double")
    index, blobs = cas.upload(index, blobs, files)
    assert blobs.count() == 2 and sorted(r.key for r in index.collect()) == ["books/a", "books/b", "c"]
    left, kept = cas.delete(index, blobs, ["c"])
    assert kept.count() == 1 and cas.delete(left, kept, ["books/a"])[1].count() == 1
    assert cas.clear(index, blobs, "books/")[1].count() == 1
    assert [r.key for r in cas.copy(index, "c", "/d").filter("key = 'd'").collect()] == ["d"]
    assert [(r.name, r.is_dir) for r in cas.list_dir(index).collect()] == [("books", True), ("c", False)]
    assert [(r.key, r.page) for r in cas.list_keys(index, "", 2).orderBy("key").collect()] == [("books/a", 0), ("books/b", 0), ("c", 1)]
    parts = spark.createDataFrame([("k", 1, bytearray(b"b")), ("k", 0, bytearray(b"a"))], "key string, part int, content binary")
    assert bytes(cas.joined_parts(parts).first().content) == b"ab"
    got = cas.content_chunks(spark.createDataFrame([("k", bytearray(b"abcde"))], "key string, content binary"), 2).orderBy("part").collect()
    assert [bytes(r.content) for r in got] == [b"ab", b"cd", b"e"]


USAGE = "id long, ts double, mode string, estimated long, actual_in long, actual_out long"


@pytest.mark.parametrize("rows, mode, limit, estimate, want", [
    ([(60, 50, 30)], "tokens", 100, 30, False), ([(30, 20, 10)], "tokens", 100, 40, True), ([(70, None, None)], "tokens", 100, 40, False),
    ([(1, None, None)] * 3, "requests", 3, 0, False), ([(1, None, None)] * 2, "requests", 3, 0, True), ([(999, None, None)], "tokens", 0, 1, True), ([], "off", 1, 9, True),
])
def test_limits(spark, rows, mode, limit, estimate, want):
    log = spark.createDataFrame([(i, 1000.0, "m", *r) for i, r in enumerate(rows)], USAGE)
    assert usage.check_allowed(log, mode, {"5h": limit}, estimate, 1000.0)[0] is want


def test_window_bound_is_inside(spark):
    log = spark.createDataFrame([(1, 0.0, "m", 5, None, None), (2, -1.0, "m", 7, None, None)], USAGE)
    assert usage.usage_by_window(log, 18000.0).first()["tokens_5h"] == 5


def test_prune_keeps_system_messages(spark):
    rows = [(1, i, "system" if i in (2, 5) else "user", "t" * 40) for i in range(10)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.turn for r in convo.prune(m, 4).orderBy("turn").collect()] == [2, 5, 8, 9]
    assert [r.turn for r in convo.truncate(m, 40).orderBy("position").collect()] == [2, 5, 8, 9]
    assert convo.compact(m, models.summarise, 50, keep=3).count() == 4


def test_keyed_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted((r.id, r.v) for r in tables.upsert(t, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(KeyError):
        tables.insert(t, new, ["id"])
    with pytest.raises(KeyError):
        tables.update(t, new, ["id"], None)
    assert tables.replace_group(t, new, "id").count() == 3
    with pytest.raises(ValueError):
        tables.merge_tools([t.withColumnRenamed("v", "name"), t.withColumnRenamed("v", "name")])


def test_manifest_status(spark):
    m = spark.createDataFrame([("b", "chunk", "pending", 0, "", None, 1.0)], "book_id string, index_type string, status string, count long, error string, built_at double, created_at double")
    assert tables.set_status(m, "b", "chunk", "built", 5.0).first()["built_at"] == 5.0
    with pytest.raises(KeyError):
        tables.set_status(m, "b", "graph", "built")
    books = spark.createDataFrame([("b",), ("c",)], "id string")
    files = spark.createDataFrame([("c", "graph")], "book_id string, index_type string")
    assert tables.backfill(m, books, ["chunk", "graph"], files, 2.0).count() == 2


def test_metadata_merge_keeps_last_non_blank(spark):
    p = spark.createDataFrame([("b", 1, "x", ""), ("b", 2, " ", "t"), ("b", 3, None, "")], "k string, seq int, author string, title string")
    r = tables.merge_metadata(p, "k", "seq", ["author", "title"]).first()
    assert (r.author, r.title) == ("x", "t")


def test_markdown():
    html = "<html><body><h2>T <b>x</b></h2><p id='q'>a<br>b <a href='u'>l</a><p>second<ul><li>one<li>two</ul><blockquote><p>c</p><p>d</p></blockquote><pre>k\n</pre><div>bare<hr></div><img src=s alt=z></body></html>"
    text, ranges = markup.convert(html)
    assert text == "## T **x**\n\na\nb [l](u)\n\nsecond\n\n- one\n- two\n> c\n> d\n\n```\nk\n\n```\n\n---\n\n![z](s)\n\n"
    assert [r[2] for r in ranges] == ["h2", "p", "p", "li", "li", "blockquote", "pre"] and ranges[1][4] == "q"
    assert all(text[a:a + n].strip() for a, n, *_ in ranges)


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:identifier>id1</dc:identifier><dc:identifier>urn:isbn:5</dc:identifier></metadata>'
                   '<manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="gone.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="x"/><itemref idref="c"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><h1>One</h1></body></html>")
        z.writestr("O/b.xhtml", "<html><body><p>Two</p></body></html>")
    (tmp_path / "x.epub").write_bytes(data.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = {r.title: r for r in epub.read(spark, str(tmp_path)).collect()}
    assert rows["T"].text == "Two\n\n# One\n\n" and rows["T"].isbn == "urn:isbn:5" and [m.content_offset for m in rows["T"].mappings] == [0, 5]
    assert rows[""].error.startswith("BadZipFile")
    assert loose_files(spark, str(tmp_path)).count() == 2


def test_pdf(spark):
    assert [(r.first, r.stop) for r in pdf.plan_batches(spark.createDataFrame([(400,), (0,)], "pages int")).collect()] == [(0, 190), (190, 380), (380, 400), (0, 0)]
    layout = {"data": [{"page_no": 3, "para_blocks": [{"lines": [{"spans": [{"text": "b  c", "box": [1, 2, 3, 4]}]}], "blocks": [{"spans": [{"content": "d", "bbox": [0, 0, 1, 1]}]}]}]}]}
    found = pdf.spans(layout)
    assert [(f[0], f[-1]) for f in found] == [(3, "b  c"), (3, "d")]
    assert [m[:3] for m in pdf.locate(found, "a b c d", 100, 10)] == [(102, 4, 13), (106, 1, 13)]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("r/full.md", "# x")
        z.writestr("r/layout.json", json.dumps(layout))
    assert pdf.unpack(archive.getvalue())[0] == "# x"


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://Example.com:80//api//users",), ("https://h",)], "u string")
    assert [r[0] for r in df.select(urls.normalize(F.col("u"))).collect()] == ["http://example.com/api/users", "https://h/"]


def test_summary_fits_and_splits(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, "\n\n".join(["A b c. D." * 9] * 5))], "id long, text string")
    got = {r.id: r.summary for r in summary.within_budget(df, models.summarise, budget=25).collect()}
    assert got[1] == "One. Two." and got[2].startswith("A b c. D.")


def test_config():
    assert Config.from_text("data_dir: x\nindex_types: [chunk, graph]\nport: 1").index_types == ["chunk", "graph"]


def test_rolling_stream(spark, tmp_path):
    rows = [(1, 0.0, "m", 60), (2, 10.0, "m", 60), (3, 200.0, "m", 60)]
    spark.createDataFrame(rows, "id long, ts double, mode string, tokens long").write.parquet(str(tmp_path / "in"))
    log = streams.read(spark, str(tmp_path / "in"), "id long, ts double, mode string, tokens long")
    out = streams.drain(streams.rolling_limit(log, 100, 100), str(tmp_path / "limits"), "append", str(tmp_path / "cp"))
    assert [(r.id, r.allowed) for r in out.orderBy("id").collect()] == [(1, True), (2, False), (3, True)]
