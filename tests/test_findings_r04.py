"""Findings of the fourth review."""

import io
import random
import re
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe import models
from folioframe.operators import graph, vector
from folioframe.plans import ingest_queries
from folioframe.sources import pdf


def _archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def test_an_empty_markdown_is_taken(monkeypatch):
    """the first .md file counts, whatever is in it; memory that runs out is no fault of a member."""
    assert pdf.unpack(_archive(("out/full.md", ""), ("out/notes.md", "notes"))) == ("", "", "")
    assert pdf.unpack(_archive(("out/a.md", "a"), ("out/notes.md", "notes")))[0] == "a"
    assert pdf.unpack(_archive(("out/notes.txt", "notes"))) == ("", "", "") and pdf.unpack(b"")[:2] == ("", "")

    def full(*_):
        raise MemoryError
    monkeypatch.setattr(zipfile.ZipFile, "read", full)
    with pytest.raises(MemoryError):
        pdf.unpack(_archive(("out/full.md", "a")))


def test_reports_of_archives_equal_their_sql_on_odd_texts(spark, tmp_path):
    """F1."""
    texts = [None, "", " ", "\n", "a\x00b", "a\r\nb", "﻿a", "NaN", "\U0001f600", "layout\n\n", "x" * 100_000, "\n" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (None, None), (2 ** 62 + 1, "long key")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in ingest_queries.archive_reports(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=str) == sorted(con.sql(ingest_queries.ORACLES["archive_reports"]).fetchall(), key=str)


def _greedy(rows, at_least):
    """{key: representative} by a plain pass over rows(group, key, vector)."""
    out, reps = {}, []
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        like = [r for h, r, w in reps if h == g and v and w and len(v) == len(w) and np.linalg.norm(v) * np.linalg.norm(w) > 0 and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= at_least]
        out[k] = like[0] if like else k
        reps += [] if like else [(g, k, v)]
    return out


def test_small_groups_are_settled_where_they_meet(spark, monkeypatch):
    """groups of one block write no pairs, larger ones do; other columns stay, however batches cut the groups."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 41 == 0 else int(i % 40) if i % 3 else 0, i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(700)]
    rows += [(1, 700, None), (1, 701, []), (1, 702, [1.0]), (1, 703, [2.0]), (1, 704, [0.0, 0.0, 0.0]), (77, 705, [1.0])]
    df = spark.createDataFrame([(*r, f"n{r[1]}", ["t"] * (r[1] % 3)) for r in rows], "g int, id int, vector array<double>, name string, tags array<string>").repartition(3)
    met = []
    pairs = vector.similar_pairs
    monkeypatch.setattr(vector, "similar_pairs", lambda rows, *a: met.append({r.g for r in rows.select("g").distinct().collect()}) or pairs(rows, *a))
    want = sorted((k, _greedy(rows, 0.9)[k], g, f"n{k}", ["t"] * (k % 3)) for g, k, _ in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block, large in ((1024, []), (20, [{0}]), (1, [{None, *range(40)}])):
            met.clear()
            got = vector.greedy_merge(df, 0.9, "g", block=block)
            assert sorted((r.id, r.representative, r.g, r.name, r.tags) for r in got.collect()) == want
            assert got.columns == ["g", "id", "name", "tags", "representative"]
            assert met == [large[0] & met[0]] if large else met == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_made_where_groups_meet(spark):
    """F2."""
    names = ["a b", "b a", "a b c", "", None, "B  A", "d"]
    df = spark.createDataFrame([(i % 2, i, names[i % 7]) for i in range(40)], "g int, id int, name string").repartition(3)
    plain = df.withColumn("vector", models.embed(F.col("name")))
    want = sorted(map(tuple, vector.greedy_merge(plain, 0.95, "g").select("g", "id", "representative").collect()))
    for block in (1024, 4):
        got = vector.greedy_merge(df, 0.95, "g", vector=models.embed(F.col("name")), block=block, made=(F.col("name"), models.embed.texts))
        assert sorted(map(tuple, got.select("g", "id", "representative").collect())) == want
    assert sum(r[1] != r[2] for r in want) > 10


def test_a_graph_is_built_in_few_shuffles(spark):
    """names, tags, representatives and edges are what a plain pass makes of the answers; relations find their ends by two
    joins, and nothing is numbered by windows or joined for its tags."""
    answers = "entities array<struct<name:string,entity_type:string,tags:array<string>,summary:string>>,relationships array<struct<source_name:string,target_name:string,relation_type:string,summary:string,claims:array<string>>>"
    e = lambda name, tags, summary=None, kind="T": (name, kind, tags, summary)
    r = lambda a, b: (a, b, "near", "", [])
    rows = [("b", "c2", "n", ([e("Ada", ["y", "x"], "long one", "U"), e("Ada Bob", ["q"]), e("Kurt", [])], [r("ada", "Kurt"), r("Ada", "nobody")])),
            ("b", "c1", "n", ([e(" ada ", ["x"], "short"), e("Bob Ada", ["p", "q"], None)], [r("Bob Ada", "Ada Bob"), r("ADA", "Bob Ada")])),
            ("d", "c3", "m", ([e("Ada", [], "")], [r("Ada", "Ada"), r("Ada", "Kurt")])), ("d", "c4", "m", ([], []))]
    chunks = spark.createDataFrame(rows, f"book_id string, chunk_id string, node_id string, chunk_text struct<{answers}>")
    entities, edges = graph.build_graph(chunks, lambda c: c, models.embed, 0.95)
    got = {(x.book_id, x.name_key): x for x in entities.collect()}
    pair = min((("ada bob", "bob ada")), key=lambda k: {y.k: y.id for y in graph.merge_by_name(_mentions(spark)).select(F.col("name_key").alias("k"), "id").collect()}[k])
    assert set(got) == {("b", "ada"), ("b", "kurt"), ("b", pair), ("d", "ada")}
    ada = got["b", "ada"]
    assert (ada.name, ada.entity_type, ada.tags, ada.summary, ada.source_chunk_id) == (" ada ", "T", ["x", "y"], "long one", "c1") and got["b", "kurt"].tags == [] and got["d", "ada"].summary == ""
    assert sorted(got["b", pair].tags) == ["p", "q"]
    ids = {k: x.id for k, x in got.items()}
    want = [("c1", ids["b", pair], ids["b", pair]), ("c1", ids["b", "ada"], ids["b", pair]), ("c2", ids["b", "ada"], ids["b", "kurt"]), ("c3", ids["d", "ada"], ids["d", "ada"])]
    assert sorted((x.source_chunk_id, x.source_entity_id, x.target_entity_id) for x in edges.collect()) == sorted(want)
    plain = edges._jdf.queryExecution().sparkPlan().toString()
    assert plain.count("Join") == 2 and "Broadcast" not in plain and "Window" not in plain and "Window" not in entities._jdf.queryExecution().sparkPlan().toString()
    alone, _ = graph.build_graph(chunks, lambda c: c)
    assert {(x.book_id, x.name_key) for x in alone.collect()} == {("b", "ada"), ("b", "kurt"), ("b", "ada bob"), ("b", "bob ada"), ("d", "ada")}


def _mentions(spark):
    return spark.createDataFrame([("b", i, n, "T", [], "", "c", "n") for i, n in enumerate(["Ada Bob", "Bob Ada"])], "book_id string, seq int, name string, entity_type string, tags array<string>, summary string, source_chunk_id string, source_node_id string")


def test_names_begin_where_words_do():
    """names are looked for by their first letter."""
    old = re.compile(r"\b[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*")
    rng = random.Random(1)
    for text in ["", "A", "Ab", "aBc Bc", "McDonald O'Neil", "éAb É Ab", "_Ab -Ab 1Ab", *("".join(rng.choices("AbZé_-' \n.1X", k=rng.randrange(14))) for _ in range(5000))]:
        assert models._NAME.findall(text) == old.findall(text)
