import io
import zipfile

import pytest

from folioframe import compiler, registry


@pytest.fixture(scope="module")
def compiled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    for name in ("A", "B"):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
            z.writestr("p.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{name}</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
            z.writestr("a.xhtml", f"<html><body><h1>Start {name}</h1><p>Kant met Hegel in Jena. A cat sat.</p><h2>Deep</h2><p>Hegel wrote to Kant.</p></body></html>")
        (root / f"{name}.epub").write_bytes(data.getvalue())
    return compiler.compile_epubs(spark, str(root), str(tmp_path_factory.mktemp("data")), ["chunk", "graph", "summary"])


def epub(title, text):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", f"<html><body><h1>{title}</h1><p>{text}</p></body></html>")
    return data.getvalue()


def test_compiling_again_keeps_and_replaces(spark, tmp_path):
    for name, text in (("one", "first words"), ("two", "other words")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.epub").write_bytes(epub(name, text))
    data = str(tmp_path / "data")
    one = compiler.compile_epubs(spark, str(tmp_path / "one"), data, ["chunk"])
    two = compiler.compile_epubs(spark, str(tmp_path / "two"), data, ["chunk"])
    again = compiler.compile_epubs(spark, str(tmp_path / "one"), data, ["chunk"])
    assert two.manifest.count() == 2 and again.manifest.count() == 2 and {r.status for r in again.manifest.collect()} == {"built"}
    nodes = compiler.read_table(spark, data, "nodes", again.nodes.schema)
    assert sorted(r.id for r in nodes.collect()) == sorted([r.id for r in one.nodes.collect()] + [r.id for r in two.nodes.collect()])
    assert {r.stage: r.status for r in again.tasks.collect()} == {"parse": "done", "tree": "done", "chunk": "done"} and again.tasks.count() == 9

    def fails(*_, **__):
        raise RuntimeError("no luck")
    broken = registry.IndexRegistry([registry.IndexProvider("chunk", "C", fails)])
    with pytest.raises(RuntimeError):
        compiler.compile_epubs(spark, str(tmp_path / "two"), data, ["chunk"], broken)
    assert sorted(r.status for r in compiler.read_manifest(spark, data).collect()) == ["built", "failed"]
    assert compiler.read_tasks(spark, data).filter("status = 'failed'").first().error == "no luck"


def test_a_book_has_one_root(compiled):
    from folioframe.operators import tree

    book = compiled.books.first().id
    assert tree.root(compiled.nodes, book).first().id == f"{book}/0"
    for nodes in (compiled.nodes.filter("parent_id <> ''"), compiled.nodes.unionByName(compiled.nodes)):
        with pytest.raises(ValueError):
            tree.root(nodes, book)


def library(c):
    vectors = c.indexes["chunk_vectors"].unionByName(c.indexes["graph_vectors"])
    return registry.Library(c.books, c.nodes, c.content, c.indexes["chunks"], c.indexes["postings"], vectors, c.indexes["entities"], c.indexes["edges"], c.indexes["summaries"], c.mappings, c.manifest)


def test_compile(compiled):
    assert compiled.books.count() == 2 and compiled.nodes.count() == 6 and compiled.mappings.count() == 8
    assert {(r.index_type, r.status) for r in compiled.manifest.collect()} == {(t, "built") for t in ("chunk", "graph", "summary")}
    assert {r.deepest for r in compiler.metrics(compiled.nodes, compiled.content).collect()} == {2}


def test_tools(compiled):
    lib = library(compiled)
    tools = registry.ontology_tools(lib).merge(registry.chunk_tools(lib)).merge(registry.graph_tools(lib)).merge(registry.summary_tools(lib))
    book = compiled.books.filter("title = 'A'").first().id
    assert tools.execute("list_books").filter("size(indexes) = 3").count() == 2
    assert [r.title for r in tools.execute("get_children", {"node_id": f"{book}/0"}).collect()] == ["Start A"]
    assert tools.execute("chunk_search", '{"query": "cat", "limit": 5}').count() == 2
    assert tools.execute("chunk_search", {"query": "cat", "book_id": book}).count() == 1
    assert tools.execute("chunk_vector_search", {"query": "Hegel wrote to Kant.", "book_id": book, "top_k": 1}).first().score > 0.9
    assert tools.execute("graph_fts", {"query": "kant", "book_id": book}).count() >= 1
    assert tools.execute("graph_entity_first", {"query": "Kant", "book_id": book}).count() >= 1
    assert tools.execute("graph_relationship_first", {"query": "near", "book_id": book}).count() >= 1
    assert tools.execute("get_summary", {"book_id": book, "node_id": f"{book}/0"}).count() == 1
    assert "Kant met Hegel" in tools.execute("read_subtree", {"node_id": f"{book}/0"}).first().text
    with pytest.raises(TypeError):
        tools.execute("get_book", {"nobody": 1})
    with pytest.raises(KeyError):
        tools.execute("nothing")
    with pytest.raises(ValueError):
        tools.merge(registry.summary_tools(lib))
    assert len(tools.merge(registry.summary_tools(lib), "keep_first").names()) == len(tools.names())
    assert registry.ontology_tools(lib).schemas()[1]["parameters"]["required"] == ["book_id"]


def test_providers():
    r = registry.IndexRegistry.load()
    assert [p.name for p in r.default_enabled()] == ["chunk"] and r.letters(["summary", "chunk"]) == "CS" and r.by_type("x") is None
    with pytest.raises(KeyError):
        r.for_types(["x"])
