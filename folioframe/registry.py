"""Named retrieval functions and index providers: what a caller can run, by name, with JSON arguments."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe import models
from folioframe.operators import fts, graph, lookup, summary, tables, text, tree, vector

#: JSON types of annotations; fixed values.
JSON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}
GROUP = "folioframe.index_providers"


@dataclass(frozen=True)
class Tool:
    """A function that returns a DataFrame, and the JSON Schema of its arguments."""

    name: str
    description: str
    run: Callable[..., DataFrame]

    @property
    def parameters(self) -> dict:
        found = inspect.signature(self.run).parameters.values()
        kind = lambda p: JSON_TYPES.get(str(p.annotation).split("[")[0].split(" ")[0].removeprefix("<class '").removesuffix("'>"), "string")
        return {"type": "object", "properties": {p.name: {"type": kind(p)} for p in found}, "required": [p.name for p in found if p.default is p.empty]}

    def __call__(self, arguments: str | dict | None = None) -> DataFrame:
        values = json.loads(arguments) if isinstance(arguments, str) and arguments.strip() else arguments or {}
        if unknown := set(values) - set(self.parameters["properties"]):
            raise TypeError(f"{self.name} has no argument {', '.join(sorted(unknown))}")
        return self.run(**values)


class Toolset:
    """Tools by name."""

    def __init__(self, tools: Iterable[Tool] = ()):
        self._tools: dict[str, Tool] = {}
        for t in tools:
            self.append(t)

    def append(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"two tools are named {tool.name}")
        self._tools[tool.name] = tool

    def merge(self, other: Toolset, on_conflict: str = "raise") -> Toolset:
        """Both sets; a name in both is an error, or the first set's tool stays."""
        if on_conflict == "raise" and (both := self._tools.keys() & other._tools.keys()):
            raise ValueError(f"two tools are named {min(both)}")
        return Toolset((other._tools | self._tools).values())

    def names(self) -> list[str]:
        return list(self._tools)

    def execute(self, name: str, arguments: str | dict | None = None) -> DataFrame:
        if name not in self._tools:
            raise KeyError(name)
        return self._tools[name](arguments)

    def schemas(self) -> list[dict]:
        return [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in self._tools.values()]


@dataclass(frozen=True)
class Library:
    """The tables that tools read."""

    books: DataFrame | None = None
    nodes: DataFrame | None = None
    content: DataFrame | None = None
    chunks: DataFrame | None = None
    postings: DataFrame | None = None
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    summaries: DataFrame | None = None
    mappings: DataFrame | None = None
    manifest: DataFrame | None = None
    tasks: DataFrame | None = None


def _named(functions: dict[str, tuple[str, Callable[..., DataFrame]]]) -> Toolset:
    return Toolset(Tool(name, about, run) for name, (about, run) in functions.items())


def ontology_tools(lib: Library) -> Toolset:
    """Walking books and their trees. What goes down from a node looks at the trees of its book only."""
    def beside(node_id) -> DataFrame:
        own = lib.nodes.filter(F.col("id") == node_id).select("book_id").limit(1)  # ids are unique
        return lib.nodes.join(F.broadcast(own), "book_id", "left_semi")

    return _named({
        "list_books": ("All books with their built indexes.", lambda: tables.books_with_indexes(lib.books, lib.manifest)),
        "get_book": ("One book.", lambda book_id: lib.books.filter(F.col("id") == book_id)),
        "get_root_node": ("A book's root.", lambda book_id: tree.root(lib.nodes, book_id)),
        "get_children": ("A node's children in order.", lambda node_id: tree.children(lib.nodes, node_id)),
        "get_parent": ("A node's parent.", lambda node_id: tree.parents(lib.nodes).filter(F.col("id") == node_id)),
        "get_descendants": ("All nodes below one, in pre-order.", lambda node_id: tree.descendants(beside(node_id), node_id)),
        "list_nodes_by_level": ("A book's nodes of one level.", lambda book_id, level: tree.at_level(lib.nodes.filter(F.col("book_id") == book_id), int(level))),
        "read_node": ("A node's own text.", lambda node_id: tree.own_text(tree.node_by_id(lib.nodes, node_id), lib.content).select("id", "title", "body")),
        "read_subtree": ("The text of a node and all below it.", lambda node_id: tree.subtree_text(beside(node_id), lib.content).filter(F.col("id") == node_id)),
    })


def chunk_tools(lib: Library, embed: Callable = models.embed_text) -> Toolset:
    return _named({
        "chunk_search": ("Chunks that match a text query.", lambda query, limit=10, book_id=None: fts.search_chunks(lib.postings, lib.chunks, query, int(limit), None if book_id is None else [book_id])),
        "chunk_vector_search": ("Chunks nearest to a text.", lambda query, book_id, top_k=5: vector.search(lib.vectors.filter("kind = 'chunk'"), embed(query), int(top_k), book_id=book_id)),
        "chunks_of_node": ("A node's chunks in order.", lambda node_id: lib.chunks.filter(F.col("node_id") == node_id).orderBy("chunk_index")),
    })


def graph_tools(lib: Library, embed: Callable = models.embed_text) -> Toolset:
    def seeds(kind: str, query: str, book_id, k: int) -> DataFrame:
        return vector.search(lib.vectors.filter(F.col("kind") == kind), embed(query), int(k), book_id=book_id)

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.select(F.row_number().over(graph.Window.orderBy("distance", "id")).alias("rank"), "id", "score")

    own = lambda df, book_id, node_ids: df.filter(F.col("book_id") == book_id) if not node_ids else df.filter((F.col("book_id") == book_id) & F.col("source_node_id").isin(node_ids))
    return _named({
        "graph_entity_first": ("Entities near a text and around them.", lambda query, book_id, top_k=5, max_hop=2: graph.entity_first(
            lib.edges.filter(F.col("book_id") == book_id), seeds("entity", query, book_id, top_k).select(F.col("id").alias("entity_id"), "score"), int(max_hop))),
        "graph_relationship_first": ("Relations near a text and around them.", lambda query, book_id, top_k=5, max_hop=2: graph.relationship_first(
            lib.edges.filter(F.col("book_id") == book_id), ranked(seeds("relationship", query, book_id, top_k)), int(max_hop))),
        "graph_fts": ("Entities whose name or summary holds a text.", lambda query, book_id, limit=10, max_hop=2: graph.fts_first(lib.entities, lib.edges, query, int(limit), int(max_hop), book_id)),
        "list_entities": ("A book's entities.", lambda book_id, node_ids=None: own(lib.entities, book_id, node_ids)),
        "list_relationships": ("A book's relations.", lambda book_id, node_ids=None: own(lib.edges, book_id, node_ids)),
    })


def summary_tools(lib: Library) -> Toolset:
    at = lambda book_id: lib.summaries.filter(F.col("book_id") == book_id)
    return _named({
        "get_summary": ("A node's summary.", lambda book_id, node_id: at(book_id).filter(F.col("node_id") == node_id)),
        "list_summaries": ("A book's summaries.", lambda book_id, node_ids=None: at(book_id) if not node_ids else at(book_id).filter(F.col("node_id").isin(node_ids))),
    })


def compiler_tools(lib: Library, spark, data_dir: str) -> Toolset:
    from folioframe import compiler

    return _named({
        "compile": ("Read EPUB files, build their trees and indexes.", lambda path, index_types=None: compiler.compile_epubs(spark, path, data_dir, index_types).nodes),
        "list_tasks": ("Compile tasks and their progress.", lambda: compiler.read_tasks(spark, data_dir)),
        "get_task": ("One task.", lambda task_id: compiler.read_tasks(spark, data_dir).filter(F.col("id") == task_id)),
        "lookup_source": ("Where a text offset comes from.", lambda book_id, offset: lookup.lookup_one(lib.mappings, book_id, int(offset))),
    })


@dataclass(frozen=True)
class IndexProvider:
    """A kind of index: its name, a letter for listings, whether it is built unless asked otherwise, and its builder
    from (nodes, content, options) to tables by name."""

    name: str
    letter: str
    build: Callable[..., dict[str, DataFrame]]
    default: bool = True
    needs_model: bool = False
    options: dict = field(default_factory=dict)


def build_chunk_index(nodes: DataFrame, content: DataFrame, embed=models.embed, budget: int = text.CHUNK_TOKENS, overlap: int = text.CHUNK_OVERLAP) -> dict[str, DataFrame]:
    """Chunks of every node's own text with absolute offsets, their postings and their vectors."""
    bodies = tree.own_text(nodes, content).filter("body <> ''").select("id", "book_id", F.col("content_offset").alias("base"), "body")
    cut = text.chunks(bodies, "id", "body", budget, overlap).join(bodies.select("id", "book_id", "base"), "id")
    chunks = cut.select("book_id", F.col("id").alias("node_id"), F.concat_ws("#", "id", F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("chunk_id"), "chunk_index",
                        (F.col("base") + F.col("content_offset")).alias("content_offset"), "content_length", "chunk_text")
    vectors = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), "book_id", embed(F.col("chunk_text")).alias("vector"))
    found = fts.postings(chunks, ["chunk_id", "book_id"], "chunk_text")
    return {"chunks": chunks, "postings": found, "chunk_vectors": vectors}


def build_graph_index(nodes: DataFrame, content: DataFrame, extract=models.extract, embed=models.embed, merge_at: float = 0.85) -> dict[str, DataFrame]:
    bodies = tree.own_text(nodes, content).filter("body <> ''").select("id", "book_id", "body")
    cut = text.graph_chunks(bodies, "id", "body").join(bodies.select("id", "book_id"), "id").select(
        "book_id", F.col("id").alias("node_id"), F.concat_ws("#", "id", F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("chunk_id"), "chunk_text")
    entities, edges = graph.build_graph(cut, extract, embed, merge_at)
    vector_of = lambda df, kind, body: df.select("id", F.lit(kind).alias("kind"), "book_id", embed(body).alias("vector"))
    vectors = vector_of(entities, "entity", F.concat_ws(" ", "name", "summary")).unionByName(vector_of(edges, "relationship", F.concat_ws(" ", "relation_type", "summary")))
    return {"entities": entities, "edges": edges, "graph_vectors": vectors}


def build_summary_index(nodes: DataFrame, content: DataFrame, summarise=models.summarise, budget: int = text.SUMMARY_TOKENS) -> dict[str, DataFrame]:
    return {"summaries": summary.summarise_tree(nodes, content, summarise, budget)}


PROVIDERS = (IndexProvider("chunk", "C", build_chunk_index), IndexProvider("graph", "G", build_graph_index, False, True), IndexProvider("summary", "S", build_summary_index, False, True))


def register_functions(spark) -> None:
    """Make table functions and file formats known to a session's SQL and readers."""
    from folioframe.functions import tabled
    from folioframe.sources import datasource

    tabled.register(spark)
    datasource.register(spark)


class IndexRegistry:
    """Providers by name: the built-in ones and those that installed packages announce."""

    def __init__(self, providers: Iterable[IndexProvider] = PROVIDERS):
        self._providers = {p.name: p for p in providers}

    @classmethod
    def load(cls) -> IndexRegistry:
        return cls([*PROVIDERS, *(e.load() for e in entry_points(group=GROUP))])

    def all(self) -> list[IndexProvider]:
        return list(self._providers.values())

    def by_type(self, name: str) -> IndexProvider | None:
        return self._providers.get(name)

    def for_types(self, names: Iterable[str]) -> list[IndexProvider]:
        wanted = set(names)
        if unknown := wanted - self._providers.keys():
            raise KeyError(min(unknown))
        return [p for p in self.all() if p.name in wanted]

    def default_enabled(self) -> list[IndexProvider]:
        return [p for p in self.all() if p.default]

    def letters(self, built: Iterable[str]) -> str:
        wanted = set(built)
        return "".join(p.letter for p in self.all() if p.name in wanted)
