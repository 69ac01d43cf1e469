import pytest

from folioframe.operators import fts, text


def spans(cut):
    return [(a, b) for a, b in cut]


def test_long_word_is_cut_and_covered():
    got = spans(text.budget_spans("A" * 250, 25, 5))
    assert len(got) >= 2 and got[0][0] == 0 and got[-1][1] == 250


def test_empty_and_short_texts():
    assert spans(text.budget_spans("", 100, 10)) == []
    assert spans(text.budget_spans("Short text.", 500, 50)) == [(0, 11)]


def test_chunks_stay_inside():
    body = "Hello world. " * 20
    assert all(0 <= a < b <= len(body) for a, b in text.budget_spans(body, 12, 2))


def test_small_cut_still_moves_on():
    got = spans(text.budget_spans("x. " * 400, 30, 50))
    assert all(b > a for (a, _), (b, _) in zip(got, got[1:]))


@pytest.mark.parametrize("body, at, want", [
    ("a" * 300 + "\n\n" + "b" * 300, 300, 302),
    ("a" * 300 + "。" + "b." + "c" * 300, 310, 301),
    ("a" * 300 + "." + "c" * 300, 310, 301),
    ("a" * 300 + "\n" + "c" * 300, 310, 301),
    ("c" * 600, 310, 310),
    ("。" + "a" * 50 + "." + "b" * 400, 150, 150),
])
def test_cut_points(body, at, want):
    assert text.cut_point(body, at) == want


def test_builder_prefers_paragraphs():
    body = "a" * 2900 + "\n\n" + "b" * 50 + "\n" + "c" * 3000
    assert spans(text.builder_spans(body))[0] == (0, 2902)
    assert "".join(body[a:b] for a, b in text.builder_spans(body)) == body


def test_paragraph_groups():
    assert text.paragraph_groups("x", 1, 5) == ["x"]
    assert text.paragraph_groups("aaaa\n\nbbbb\n\ncccc", 2, 2) == ["aaaa\n\nbbbb", "cccc"]


def test_tags_count_boundaries():
    tagged, n, offsets = next(text._tag_rows("A. B"))
    assert (tagged, n, offsets) == ("<s0/>A.<s1/> B<s2/>", 3, "0,2,4")
    assert next(text._tag_rows(""))[0] == "<s0/><s1/>"


def test_resolve_tags(spark):
    docs = spark.createDataFrame([(1, "A. B")], "doc_id long, text string")
    tags = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 1)], "doc_id long, start_tag int, end_tag int")
    assert [(r.start, r.stop) for r in text.resolve_tags(tags, text.tagify(docs)).collect()] == [(0, 2)]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "The Résumé of a cat"), (2, "a cat of the dog"), (3, "dogs and cats"), (4, None)], "k long, t string")
    return fts.postings(docs, "k", "t")


@pytest.mark.parametrize("query, want", [
    ("cat", [1, 2]), ("cat dog", [2]), ('"of a"', [1]), ('"a of"', []), ("dog*", [2, 3]), ("resume", [1]), ("cat NOT dog", [1]),
    ("dogs OR resume", [1, 3]), ("(dogs OR resume) AND and", [3]), ("", []), ('"cat of" OR dogs', [2, 3]),
])
def test_search(index, query, want):
    assert sorted(r[0] for r in fts.search(index, "k", query).collect()) == want


def test_malformed_query_falls_back(spark, index):
    with pytest.raises(fts.QueryError):
        fts.search(index, "k", '(cat')
    files = spark.createDataFrame([("books/epub/alice.epub",), ("books/epub/bob.epub",), ("x(cat",)], "key string")
    assert [r[0] for r in fts.search_keys(files, "(cat").collect()] == ["x(cat"]
    assert [r[0] for r in fts.search_keys(files, "alice").collect()] == ["books/epub/alice.epub"]
    assert fts.search_keys(files, "book*").count() == 2


def test_book_filter_comes_before_the_limit(spark):
    chunks = spark.createDataFrame([(i, i % 2, "cat") for i in range(10)], "chunk_id long, book_id long, t string")
    got = fts.search_chunks(fts.postings(chunks, "chunk_id", "t"), chunks, "cat", 3, [1]).collect()
    assert [r.chunk_id for r in got] == [1, 3, 5]


def test_search_of_many_scripts(spark):
    rows = [(1, "हिन्दी में"), (2, "Dvořák played"), (3, "şehir ve köy"), (4, "Cafe\u0301 noir"), (5, "one two three four five"), (6, "five one"), (7, "Ελλάδα μας")]
    index = fts.postings(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    hits = lambda q: sorted(r.k for r in fts.search(index, "k", q, ("t",)).collect())
    assert [hits(q) for q in ("हिन्दी", "dvorak", "SEHIR", "café", "koy", "ελλάδα")] == [[1], [2], [3], [4], [3], [7]]
    assert hits("NEAR(one four, 2)") == [5] and hits("NEAR(one four, 1)") == [] and hits('NEAR("two three" five one)') == [5] and hits("NEAR(five one)") == [5, 6]
    assert hits("^five") == [6] and hits('^"one two"') == [5] and hits("t : one") == [5, 6] and hits("{T} : (one NOT two)") == [6]
    for bad in ("x : one", "{x t} : one"):
        with pytest.raises(fts.QueryError):
            hits(bad)
    for bad in ("NEAR(one", "NEAR(one two, x)", "one, two"):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)


def test_columns(spark):
    rows = [(1, "red house", "a blue cat"), (2, "blue", "red house cat"), (3, None, "house red"), (4, "red", None), (5, "cat red", "house"), (6, "red red", "red cat red house blue")]
    index = fts.postings(spark.createDataFrame(rows, "k int, title string, body string"), "k", ["title", "body"])
    hits = lambda q: sorted(r.k for r in fts.search(index, "k", q, ("title", "body")).collect())
    assert hits("red") == [1, 2, 3, 4, 5, 6] and hits("title : red") == [1, 4, 5, 6] and hits("- title : red") == [2, 3, 6] and hits("-{title body} : red") == []
    assert hits('"red house"') == [1, 2, 6] and hits('title : "red house"') == [1] and hits('body : "red house"') == [2, 6]
    assert hits("^red") == [1, 2, 4, 6] and hits("body : ^red") == [2, 6] and hits("title : (^cat OR blue)") == [2, 5]
    assert hits("NEAR(red house, 0)") == [1, 2, 3, 6] and hits("body : NEAR(cat blue, 2)") == [1, 6] and hits("{title} : (red NOT body : red)") == [1, 4, 5, 6]
    assert hits("title : red AND body : cat") == [1, 6] and hits("title : re* NOT body : house") == [1, 4]
    with pytest.raises(fts.QueryError):
        hits("author : red")


def test_index_is_kept_up(spark, tmp_path):
    """After each write a search equals that of a fresh index of the documents that are left."""
    import random

    from folioframe.operators.textindex import TextIndex

    rng = random.Random(4)
    index = TextIndex(spark, f"file://{tmp_path}/index", ["title", "body"], "k", "book", "int int")
    assert index.search("red").count() == 0 and index.segments().count() == 0
    text = lambda: " ".join(rng.choices(["red", "blue", "cat", "house", "é", "the"], k=rng.randint(0, 6))) or None
    live, number = {}, 0
    for step in range(7):
        books = rng.sample([None, 1, 2, 3, 4, 5], 3)
        if step in (3, 5):
            index.delete(spark.createDataFrame([(b,) for b in [*books, 77]], "book int"))
            live = {b: rows for b, rows in live.items() if b not in books}
        else:
            new = {b: [(number + 10 * n + i, b, text(), text()) for i in range(rng.randint(1, 4))] for n, b in enumerate(books)}
            number += 100
            index.put(spark.createDataFrame([r for rows in new.values() for r in rows], "k int, book int, title string, body string"))
            live |= new
        if step == 4:
            index.merge()
            assert index.segments().count() == 1
        fresh = fts.postings(spark.createDataFrame([r for rows in live.values() for r in rows], "k int, book int, title string, body string"), "k", ["title", "body"])
        for query in ("red", "title : red NOT body : blue", '"red cat" OR ^the', "hous*"):
            assert sorted(r.k for r in index.search(query).collect()) == sorted(r.k for r in fts.search(fresh, "k", query, ("title", "body")).collect()), (step, query)
    assert index.segments().agg({"live": "sum"}).first()[0] >= len(live)


def test_a_query_reads_its_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from folioframe.operators.textindex import TextIndex

    index = TextIndex(spark, f"file://{tmp_path}/index", ["t"], "k", "book", "long long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more postings, several files
    index.put(spark.range(4000).selectExpr("id k", "id % 9 book", "concat_ws(' ', transform(sequence(0, 20), i -> concat('w', hash(id, i) % 5000))) t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = index.search("w17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,w17)" in plan
    groups = [pq.ParquetFile(f).metadata.row_group(i).column(0).statistics for f in glob.glob(f"{tmp_path}/index/postings/*/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 2 and sum(g.min <= "w17" <= g.max for g in groups) < len(groups)
