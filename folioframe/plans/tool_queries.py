"""Queries by way of named tools with JSON arguments, the chunk index of trees, and writes of books and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe import registry
from folioframe.operators import tables, text
from folioframe.plans import model, text_queries, tree_queries
from folioframe.sources.files import Rounds


def _all(tools: registry.Toolset, calls: list[tuple[str, str, str]]) -> DataFrame:
    """(tool, value) of all rows that the calls (tool, JSON arguments, expression for value) find."""
    found = [tools.execute(name, arguments).select(F.lit(name).alias("tool"), F.expr(value).alias("value")) for name, arguments, value in calls]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _library(spark, d) -> registry.Library:
    """Tools read stored trees."""
    return registry.Library(nodes=Rounds(spark, "tools").save(tree_queries.build_tree(spark, d), "nodes"), content=model.books(spark, d))


def ontology_tools(spark, d):
    node, book = '{"node_id": "3/1"}', '{"book_id": 3}'
    return _all(registry.ontology_tools(_library(spark, d)), [
        ("get_root_node", book, "id"), ("get_children", '{"node_id": "3/0"}', "concat_ws(' ', id, order_index, title)"), ("get_parent", '{"node_id": "3/2"}', "concat_ws(' ', id, parent_id, parent_title)"),
        ("get_descendants", node, "concat_ws(' ', id, path)"), ("list_nodes_by_level", '{"book_id": 3, "level": 2}', "concat_ws(' ', id, title)"), ("read_node", node, "concat(title, ':', sha2(body, 256))"),
        ("read_subtree", node, "sha2(text, 256)")])


def book_listing(spark, d):
    """All books by way of the tool that lists them, with their built indexes, and one of them by its id."""
    from folioframe.plans import data_queries

    books = model.docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit(1.0).alias("created_at"))
    tools = registry.ontology_tools(registry.Library(books=books, manifest=data_queries._manifest(spark, d)))
    return _all(tools, [("list_books", "", "cast(id as string)"), ("get_book", '{"book_id": 5}', "concat_ws(' ', id, title)")])


def _index(spark, d) -> dict[str, DataFrame]:
    return registry.build_chunk_index(tree_queries.build_tree(spark, d), model.books(spark, d))


def chunk_index(spark, d):
    """The chunks of every node's own text, where they stand in their book."""
    return _index(spark, d)["chunks"].withColumn("chunk_hash", F.sha2("chunk_text", 256)).drop("chunk_text")


def chunk_index_postings(spark, d):
    """How many chunks and places of each book hold a word."""
    return _index(spark, d)["postings"].filter("token in ('with', 'that', 'und', 'les')").groupBy("book_id", "token").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("places"))


def chunk_tools(spark, d):
    found = _index(spark, d)
    tools = registry.chunk_tools(registry.Library(chunks=found["chunks"], postings=found["postings"]))
    return _all(tools, [("chunks_of_node", '{"node_id": "3/1"}', "concat_ws(' ', chunk_id, content_offset, content_length)"), ("chunk_search", '{"query": "with that", "limit": 25}', "chunk_id")])


def summary_tools(spark, d):
    tools = registry.summary_tools(registry.Library(summaries=tree_queries.tree_summary(spark, d)))
    return _all(tools, [("get_summary", '{"book_id": 3, "node_id": "3/1"}', "summary"), ("list_summaries", '{"book_id": 5}', "concat_ws(' ', node_id, summary)")])


def graph_tools(spark, d):
    edges = model.edges(spark, d).withColumn("book_id", F.lit(1)).withColumn("source_node_id", F.col("relation_type"))
    tools = registry.graph_tools(registry.Library(entities=model.entities(spark, d), edges=edges))
    return _all(tools, [("list_entities", '{"book_id": 1}', "concat_ws(' ', id, name)"), ("list_relationships", '{"book_id": 1, "node_ids": ["R"]}', "id")])


def _stored(spark, d) -> DataFrame:
    return model.docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit(1.0).alias("updated_at"))


def insert_books(spark, d):
    books = _stored(spark, d)
    return tables.insert(books.filter("id % 3 <> 0"), books.filter("id % 3 = 0").withColumn("title", F.lit("new")), ["id"])


def update_books(spark, d):
    books = _stored(spark, d)
    return tables.update(books, books.filter("id % 3 = 0").withColumn("title", F.concat(F.lit("again "), "title")), ["id"], now=9.0)


def vectors_left(spark, d):
    """Vectors without those of some ids."""
    rows = model.vectors(spark, d)
    return tables.delete(rows, rows.filter("id % 7 = 2").select("id"), ["id"]).select("id", "label")


QUERIES = {"ontology_tools": ontology_tools, "book_listing": book_listing, "chunk_index": chunk_index, "chunk_index_postings": chunk_index_postings, "chunk_tools": chunk_tools,
           "summary_tools": summary_tools, "graph_tools": graph_tools, "insert_books": insert_books, "update_books": update_books, "vectors_left": vectors_left}

_BODIES = f"{tree_queries._LINES}, bodies as (select n.id doc_id, n.book_id, n.title, n.content_offset::bigint base, substr(b.text, n.content_offset::bigint + 1, n.content_length::bigint) as text from nodes n join books b using (book_id))"
_CUT = text_queries._budget_sql(text.CHUNK_TOKENS, f"greatest(1, cut - {text.CHUNK_OVERLAP * 4})").replace("from documents", "from bodies")
_CHUNKS = f"{_BODIES}, cut as ({_CUT}), chunks as (select book_id, doc_id node_id, doc_id || '#' || lpad(chunk_index::varchar, 6, '0') chunk_id, chunk_index, base + content_offset content_offset, content_length, chunk_text from cut join bodies using (doc_id))"
_WORDS = f"{_CHUNKS}, words as (select *, {text_queries._LIST.format('chunk_text')} ts from chunks)"
ORACLES = {
    "ontology_tools": f"""with {_BODIES} select 'get_root_node' tool, id as value from nodes where book_id = 3 and seq = 0
      union all select 'get_children', id || ' ' || order_index || ' ' || title from nodes where parent_id = '3/0'
      union all select 'get_parent', concat_ws(' ', n.id, n.parent_id, u.title) from nodes n join nodes u on u.id = n.parent_id where n.id = '3/2'
      union all select 'get_descendants', p.id || ' ' || p.path from paths p, paths t where t.id = '3/1' and p.book_id = t.book_id and starts_with(p.path, t.path || '.')
      union all select 'list_nodes_by_level', id || ' ' || title from nodes where book_id = 3 and level = 2
      union all select 'read_node', title || ':' || sha256(text) from bodies where doc_id = '3/1'
      union all select 'read_subtree', sha256(string_agg(b.text, '' order by p.path)) from paths t join paths p on p.book_id = t.book_id and (p.path = t.path or starts_with(p.path, t.path || '.'))
        join bodies b on b.doc_id = p.id where t.id = '3/1'""",
    "book_listing": "select 'list_books' tool, doc_id::varchar as value from documents union all select 'get_book', doc_id || ' ' || lang from documents where doc_id = 5",
    "chunk_index": f"with {_CHUNKS} select * exclude (chunk_text), sha256(chunk_text) chunk_hash from chunks",
    "chunk_index_postings": f"""with {_WORDS}, w as (select book_id, chunk_id, unnest(ts) token from words)
      select book_id, token, count(distinct chunk_id) chunks, count(*) places from w where token in ('with', 'that', 'und', 'les') group by 1, 2""",
    "chunk_tools": f"""with {_WORDS} select 'chunks_of_node' tool, chunk_id || ' ' || content_offset || ' ' || content_length as value from chunks where node_id = '3/1'
      union all select 'chunk_search', chunk_id from (select chunk_id from words where list_contains(ts, 'with') and list_contains(ts, 'that') order by chunk_id limit 25)""",
    "summary_tools": f"""with s as ({tree_queries.ORACLES["tree_summary"]}) select 'get_summary' tool, summary as value from s where book_id = 3 and node_id = '3/1'
      union all select 'list_summaries', node_id || ' ' || summary from s where book_id = 5""",
    "graph_tools": f"with {model.EDGES}, {model.ENTITIES} select 'list_entities' tool, id || ' ' || name as value from entities union all select 'list_relationships', id from edges where relation_type = 'R'",
    "insert_books": "select doc_id id, case when doc_id % 3 = 0 then 'new' else lang end title, 1.0::double updated_at from documents",
    "update_books": "select doc_id id, case when doc_id % 3 = 0 then 'again ' else '' end || lang title, case when doc_id % 3 = 0 then 9.0 else 1.0 end::double updated_at from documents",
    "vectors_left": "select vec_id id, label from embeddings where vec_id % 7 <> 2",
}
