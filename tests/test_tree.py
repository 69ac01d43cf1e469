import pytest

from folioframe.operators import lookup, progress, tree

NODE = "id string, book_id string, parent_id string, level int, order_index int, title string, title_offset long, title_length long, content_offset long, content_length long"


def outline(text):
    return list(tree.outline(text, "t"))


@pytest.mark.parametrize("text, want", [("# A\n\n### B\n\n## C\n", [1, 2, 2]), ("## First\n\nText.\n\n## Second\n\nMore.\n", [1, 1])])
def test_levels(text, want):
    assert [n[2] for n in outline(text)[1:]] == want


def test_no_headings():
    assert outline("")[0][7:9] == (0, 0)
    body = "This is some text without any headings.\n\nJust paragraphs."
    assert len(outline(body)) == 1 and outline(body)[0][8] == len(body)


def test_nesting_and_bodies():
    body = "# Chapter 1\n\nSome text here.\n\n## Section 1.1\n\nMore text.\n\n# Chapter 2\n\nEnd."
    got = outline(body)
    assert [n[2] for n in got] == [0, 1, 2, 1] and [n[1] for n in got] == [None, 0, 1, 0] and [n[3] for n in got] == [0, 0, 0, 1]
    assert body[got[3][7]:got[3][7] + got[3][8]] == "\nEnd."


def test_root_owns_the_introduction():
    root = outline("Introduction text.\n\n# Chapter 1\n\nBody.\n")[0]
    assert root[7:9] == (0, 20)


def test_odd_white_space_in_headings():
    assert [h[2] for h in tree.headings("# A\n# B\rC\n#D")] == ["A", "B\rC"]


@pytest.fixture(scope="module")
def slices(spark):
    rows = [("r", "b", "", 0, 0, "", 0, 5, 9, 9), ("A", "b", "r", 1, 0, "", 5, 4, 18, 10), ("B", "b", "r", 1, 1, "", 0, 0, 0, 0), ("A1", "b", "A", 2, 0, "", 0, 0, 0, 0)]
    return spark.createDataFrame(rows, NODE), spark.createDataFrame([("b", "TITLEHEADFIRSTBODYSECONDBODY")], "book_id string, text string")


def test_texts(slices):
    nodes, content = slices
    assert {r.id: r.body for r in tree.own_text(nodes, content).collect()} == {"r": "FIRSTBODY", "A": "SECONDBODY", "B": "", "A1": ""}
    assert {r.id: r.text for r in tree.subtree_text(nodes, content).collect()}["r"] == "FIRSTBODYSECONDBODY"


def test_walks(slices):
    nodes, _ = slices
    assert [r.id for r in tree.descendants(nodes, "r").collect()] == ["A", "A1", "B"]
    assert [r.id for r in tree.children(nodes, "r").collect()] == ["A", "B"]
    with pytest.raises(KeyError):
        tree.children(nodes, "nobody")
    assert tree.roots(nodes).count() == 1 and tree.violations(nodes).count() == 0


def test_range_outside_the_text_is_an_error(slices, spark):
    nodes, content = slices
    with pytest.raises(Exception, match="range outside"):
        tree.own_text(nodes, content.selectExpr("book_id", "substring(text, 1, 5) text")).collect()


@pytest.mark.parametrize("rows, problem", [
    ([("r", "b", "", 0, 0), ("s", "b", "", 0, 0)], "many roots"),
    ([("r", "b", "", 0, 0), ("a", "b", "r", 2, 0), ("c", "b", "a", 1, 0)], "level order"),
    ([("r", "b", "", 0, 0), ("a", "b", "x", 1, 0)], "missing parent"),
    ([("r", "b", "", 0, 0), ("a", "b", "r", 1, 0), ("c", "b", "r", 1, 0)], "sibling order"),
    ([("r", "b", "", 0, 0), ("a", "b", "c", 1, 0), ("c", "b", "a", 1, 0)], "cycle"),
    ([("r", "b", "", 0, 0), ("a", "b", "r", 1, 0), ("a", "b", "r", 1, 1)], "repeated id"),
    ([("a", "b", "c", 1, 0), ("c", "b", "a", 2, 0)], "no root"),
    ([("r", "b", "", 1, 0)], "root level"),
])
def test_violations(spark, rows, problem):
    nodes = spark.createDataFrame([(*r, "", 0, 0, 0, 0) for r in rows], NODE)
    assert problem in {r.problem for r in tree.violations(nodes).collect()}


def test_replay_with_rollback(spark):
    ops = [(0, 0, "open", 1, "A", 0, 5), (0, 1, "append", 0, "", 5, 9), (0, 2, "open", 2, "B", 9, 9), (0, 3, "rollback", 0, "", 0, 0), (0, 4, "rollback", 0, "", 0, 0), (1, 0, "open", 1, "C", 9, 12), (1, 1, "finish", 0, "", 0, 0)]
    log = spark.createDataFrame([("b", *o) for o in ops], "book_id string, chunk int, seq int, op string, level int, title string, start long, stop long")
    got = {r.title: (r.parent_id, r.order_index, r.content_offset, r.content_length) for r in tree.replay(log).collect()}
    assert got["A"] == ("b/0", 0, 0, 9) and got["C"] == ("b/0", 1, 9, 3) and "B" not in got


def test_interval_lookup(spark):
    maps = spark.createDataFrame([("b", 0, 10), ("b", 5, 5000), ("b", 10, 0), ("c", 0, 10)], "book_id string, content_offset long, content_length long")
    points = spark.createDataFrame([("b", 9), ("b", 10), ("b", 5004), ("b", 5005)], "book_id string, offset long")
    got = sorted((r.offset, r.content_offset) for r in lookup.lookup(points, maps, bucket=16).collect())
    assert got == [(9, 0), (9, 5), (10, 5), (5004, 5)]
    assert lookup.lookup_one(maps, "b", 9).count() == 2


def test_rollup_reaches_nested_parents(spark):
    rows = [("a", None, 0, 0.0, 0.0, True), ("b", "a", 0, 0.0, 0.0, True), ("c", "b", 0, 4.0, 1.0, False), ("d", "b", 1, 6.0, 4.0, False)]
    tasks = spark.createDataFrame([(*r, "running", 0.0, "x") for r in rows], "id string, parent_id string, seq int, total double, completed double, auto_total boolean, status string, started_at double, label string")
    got = {r.id: (r.depth, r.total, r.completed, r.eta_seconds) for r in progress.rollup(tasks, 10.0).collect()}
    assert got["a"] == got["b"][:0] + (0, 10.0, 5.0, 10.0) and got["b"][1:3] == (10.0, 5.0)
