"""Point lookups and listings: filters that reach the scan, with their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators.graph import by_ids  # noqa: F401  a batch of entities in the order asked


def book(books: DataFrame, book_id) -> DataFrame:
    return books.filter(F.col("id") == book_id)


def book_ids(books: DataFrame) -> DataFrame:
    """Ids in order of creation."""
    return books.orderBy("created_at", "id").select("id")


def indexes(manifest: DataFrame, book_id) -> DataFrame:
    return manifest.filter(F.col("book_id") == book_id).orderBy("index_type")


def built_types(manifest: DataFrame, book_id) -> DataFrame:
    return manifest.filter((F.col("book_id") == book_id) & (F.col("status") == "built")).select("index_type").distinct()


def with_built_index(rows: DataFrame, manifest: DataFrame, index_type: str, key: str = "book_id") -> DataFrame:
    """Only the rows of books that have the index."""
    built = manifest.filter((F.col("index_type") == index_type) & (F.col("status") == "built")).select(F.col("book_id").alias(key))
    return rows.join(built, key, "left_semi")


def chunks_of_node(chunks: DataFrame, node_id) -> DataFrame:
    return chunks.filter(F.col("node_id") == node_id).orderBy("chunk_index")


def of_book(rows: DataFrame, book_id, node_ids: list | None = None, node: str = "source_node_id") -> DataFrame:
    """A book's rows, of some nodes if any are named."""
    rows = rows.filter(F.col("book_id") == book_id)
    return rows.filter(F.col(node).isin(list(node_ids))) if node_ids else rows


def entity(entities: DataFrame, entity_id) -> DataFrame:
    return entities.filter(F.col("id") == entity_id)


def entities_named(entities: DataFrame, book_id, name: str) -> DataFrame:
    """By the exact name, case and all."""
    return entities.filter((F.col("book_id") == book_id) & (F.col("name") == name)).orderBy("id")


def edges_of_any(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch any of ids(entity_id), each once: an equi-join for either end, the second for edges that the
    first has not found."""
    source = ids.select(F.col("entity_id").alias("source_entity_id"))
    one = edges.join(source, "source_entity_id", "left_semi").select(*edges.columns)
    two = edges.join(ids.select(F.col("entity_id").alias("target_entity_id")), "target_entity_id", "left_semi").join(source, "source_entity_id", "left_anti").select(*edges.columns)
    return one.unionByName(two)


def summary(summaries: DataFrame, book_id, node_id) -> DataFrame:
    return summaries.filter((F.col("book_id") == book_id) & (F.col("node_id") == node_id))


def file(index: DataFrame, key: str) -> DataFrame:
    """A stored file's row, none if it does not exist."""
    return index.filter(F.col("key") == key)


def exists(index: DataFrame, key: str) -> bool:
    return not file(index, key).isEmpty()


def metadata(index: DataFrame, key: str) -> DataFrame:
    """(key, meta) of a stored file, an empty map where it has none; an unknown file is an error."""
    if not exists(index, key):
        raise FileNotFoundError(key)
    return file(index, key).select("key", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))


def providers(table: DataFrame, names: list[str] | None = None, default_only: bool = False) -> DataFrame:
    """Rows of a provider table(name, letter, is_default), by name."""
    table = table.filter(F.col("name").isin(names)) if names is not None else table
    return (table.filter("is_default") if default_only else table).orderBy("name")


def letters(table: DataFrame) -> DataFrame:
    """One row: the letters of all providers in order of name."""
    return table.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "letter"))), lambda x: x["letter"]), "").alias("letters"))
