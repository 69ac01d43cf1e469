"""Findings of the third review."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe import models
from folioframe.llm import covertree
from folioframe.operators import fts, retrieval, tree, vector
from folioframe.sources import epub, files, markup, pdf


@pytest.mark.parametrize(("html", "want"), [
    ("<h1>a&amp;&amp</h1><p>b</p>", "# a&&amp\n\nb\n\n"), ("<p>&lt;x&gt; &lt &#38; &eacute; &notit;</p>", "<x> &lt & é &notit;\n\n"),
    ('<p><a href="n?a=1&amp;b=2&copy=3">t</a></p>', "[t](n?a=1&b=2&copy=3)\n\n")])
def test_named_references_end_with_a_semicolon(html, want):
    """F3, F4."""
    text, ranges = markup.convert(html)
    assert text == want and sum(r[1] for r in ranges) == len(want)


def test_pairs_of_parts_and_blocks_are_passed_on_in_pieces(spark, tmp_path, monkeypatch):
    """what a task holds of the pairs is bounded, and results do not depend on pieces or groups."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 4)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1)
    monkeypatch.setattr(covertree, "PAIRS", 3)
    saved, save = {}, covertree.Scratch.save

    def kept(self, df, name):
        out = save(self, df, name)
        saved[name] = out.columns, out.count()
        return out
    monkeypatch.setattr(covertree.Scratch, "save", kept)
    got = covertree.top_inner_products(rows, F.col("vec_id") % 7 == 0, 3, block=16, part=8).collect()
    assert saved["wanted0"][0] == ["id", "block"] and saved["wanted0"][1] > 100  # queries are not repeated in them
    q = np.floor(np.float32(v).astype(float) * 1024).astype(np.int64)
    want = []
    for i in range(0, 600, 7):
        score = q @ q[i]
        best = [j for j in np.lexsort((np.arange(600), -score)) if j != i][:3]
        want += [(i, n + 1, int(j), int(score[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    assert [covertree.query_block(n) for n in (0, 2000, 51282, 10 ** 7)] == [256, 256, 801, 2048]


def test_many_small_groups_meet_in_one_pass(spark):
    """groups pass through a task one after the other, however many there are and however batches cut them."""
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (900, 3)).astype(float)
    rows = [(int(i % 211) if i % 50 else None, i, x.tolist()) for i, x in enumerate(v)] + [(1, 900, None), (1, 901, []), (1, 902, [1.0])]
    df = spark.createDataFrame(rows, "g int, id int, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plan = vector.similar_pairs(df, 0.9, "g", block=16)
        got = sorted(((-1 if r.g is None else r.g), r.a, r.b) for r in plan.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norm = np.sqrt((v * v).sum(1))
    unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
    near = unit @ unit.T >= 0.9
    of = [-1 if r[0] is None else r[0] for r in rows]
    assert got == sorted((of[a], a, b) for a in range(900) for b in range(a + 1, 900) if of[a] == of[b] and near[a, b])
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def test_stand_ins_by_batches(spark):
    texts = ["Anna met Bob Stone. Anna left", "", None, "éé ÜÖ Zoë a"]
    assert models.embed_texts(texts).tolist() == [models.embed_text(t or "") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(models.extract(F.col("t")).alias("x"), models.embed(F.col("t")).alias("v")).collect()
    assert [[e.name for e in r.x.entities] for r in got] == [["Anna", "Bob Stone"], [], [], ["Zoë"]]
    assert [(e.source_name, e.target_name, e.claims) for e in got[0].x.relationships] == [("Anna", "Bob Stone", [])] and got[3].v == models.embed_text(texts[3])


def test_nodes_are_made_once_for_all_checks(spark):
    """F8, F10."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, "1/0", "", 0, 0, 0, 0, 0, 5), (1, "1/1", "1/0", 1, 0, 0, 0, 0, -1), (1, "1/1", "1/0", 0, 0, 0, 0, 0, 5), (2, "2/1", "1/0", 1, 0, 0, 0, 0, 1), (3, "3/0", "", 1, 0, 0, 0, 0, 1), (3, "3/1", "", 0, 0, 0, 0, 0, 1)]
    schema = "book_id long, id string, parent_id string, level int, order_index int, title_offset long, title_length long, content_offset long, content_length long"
    nodes = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(make, schema)
    got = sorted(tuple(r) for r in tree.violations(nodes).collect())
    assert got == [(1, "1/1", "level order"), (1, "1/1", "negative length"), (1, "1/1", "repeated id"), (1, "1/1", "sibling order"), (1, "1/1", "sibling order"),
                   (2, "", "no root"), (2, "2/1", "other book"), (3, "", "many roots"), (3, "3/0", "root level")]
    assert made.value == len(rows)


def test_whole_files_go_to_python_a_few_at_a_time(spark):
    """F5, F9, F11, F14, F16, F17."""
    key, texts = "spark.sql.execution.arrow.maxRecordsPerBatch", [(i, f"line {i}\nmore") for i in range(1500)]
    layout = '{{"pages": [{{"page_no": {0}, "spans": [{{"bbox": [0, 0, 1, 1], "content": "{0}"}}]}}]}}'
    books = spark.createDataFrame([(i, layout.format(i), i % 3) for i, _ in texts], "book_id long, layout string, n int").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows > files.FILES_SENT)
            yield batch

    before = spark.conf.get(key)
    for make in (lambda: pdf.layout_spans(books), lambda: pdf.unpacked(books.withColumn("content", F.lit(b"")))):
        spark.conf.set(key, "10000")
        try:
            made = make()
            assert int(spark.conf.get(key)) == files.FILES_SENT
            assert made.mapInArrow(watch, made.schema).count() == 1500 and seen.value == 0
            spark.conf.set(key, "7")
            make()
            assert spark.conf.get(key) == "7"  # a session that asks for fewer has fewer
        finally:
            spark.conf.set(key, before)
    epub.parse(spark.createDataFrame([("a", b"")], "path string, content binary"))
    assert 0 < int(spark.conf.get(key)) <= files.FILES_SENT
    spark.conf.set(key, before)


def test_answers_are_computed_once(spark):
    """each field is looked for once for each fragment, however often the answer is named."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ask(text):
        asked.add(1)
        return 'so: {"title": "T", "extras": {"k": "v"}}' if text else "nothing"

    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "book_id int, text string").coalesce(1)
    got = {r.book_id: (r.title, r.extras, r.failures) for r in models.metadata_rounds(docs, lambda c: ask(c), rounds=1).collect()}
    assert got == {1: ("T", {"k": "v"}, 0), 2: ("", {}, 1), 3: ("T", {"k": "v"}, 0)} and asked.value == 3
    text = spark.createDataFrame([("Title: A\nseries : S",), ("none",), (None,)], "t string")
    plan = text.select(models.parsed(models.answer_metadata(F.col("t")), models.ANSWER).alias("x"))
    assert [r.x and (r.x.title, r.x.author, r.x.extras) for r in plan.collect()] == [("A", None, {"series": "S"}), None, None]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("title\\s*:") == 1


def test_tokens_are_split_and_then_folded(spark):
    """the folding of letters sees tokens with more than ASCII only, and finds what it found before."""
    texts = ["Plain words, 2 of them", "Ünïcode été ́ x", "ΑΒΓ Ｗide नमस्ते", "", None, "á", "́", "İI ß-Straße"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(F.split(fts.fold(F.col("t")), r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")
    rows = df.select(fts.tokens(F.col("t")).alias("a"), old.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[1].a == ["unicode", "ete", "x"]
    plan = df.select(fts.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(regexp_replace(lower(t" not in plan


def test_retrievals_write_what_is_near_only(spark, monkeypatch):
    """edges of entities that no query comes to are neither written nor counted, and a small front with many
    neighbours goes to several tasks."""
    near = [(f"s{i % 7}", f"p{i}") for i in range(40)] + [("s0", "p0")] * 3 + [("s0", "s0"), ("s1", "s2")]
    far = [(f"x{i}", f"y{i % 500}") for i in range(3000)]
    rows = [(f"e{i}", a, b, "r", "s", "c") for i, (a, b) in enumerate(near + far)]
    edges = spark.createDataFrame(rows, "id string, source_entity_id string, target_entity_id string, relation_type string, summary string, source_chunk_id string")
    seeds = [(1, "p0"), (1, "p1"), (2, "p5"), (None, "s6"), (3, "alone")]
    saved, tasks, save, step = {}, [], retrieval.Rounds.save, retrieval.step

    def kept(self, df, name):
        out = save(self, df, name)
        saved[name] = out.count()
        return out

    def dealt(*a):
        out = step(*a)
        tasks.append(next((int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", out._jdf.queryExecution().optimizedPlan().toString())), 1))
        return out
    monkeypatch.setattr(retrieval.Rounds, "save", kept)
    monkeypatch.setattr(retrieval, "step", dealt)
    monkeypatch.setattr(retrieval, "REACH", 10, raising=False)
    asked = spark.createDataFrame([(q, e, 0.5) for q, e in seeds], "query int, entity_id string, score double")
    got = {(r.query, r.entity_id): (r.hop, r.n_edges) for r in retrieval.degrees(retrieval.entity_first(edges, asked, 2, 3), edges).collect()}
    ends = [(a, b) for a, b in near + far] + [(b, a) for a, b in near + far if a != b]
    want = {}
    for q in {q for q, _ in seeds}:
        hops = {e: 0 for p, e in seeds if p == q}
        for hop in (1, 2):
            hops = {b: hop for a, b in ends if hops.get(a) == hop - 1} | hops
        want |= {(q, e): (hop, sum(a == e for a, _ in ends)) for e, hop in hops.items()}
    assert got == want and len(want) > 20
    assert max(saved.values()) <= len(want) + len(near) * 2 and tasks[0] == 1 and tasks[1] > 2
