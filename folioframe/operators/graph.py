"""The knowledge graph: merging extracted names, linking relations to entities, and three ways to retrieve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalars import gen_id, strip
from folioframe.sources.files import Rounds

#: Edges shown and followed by the one-hop retrievals.
EDGES = 3
_EDGE = ["id", "source_entity_id", "target_entity_id", "relation_type", "summary", "source_chunk_id"]


def name_key(name: Column) -> Column:
    return F.lower(strip(name))


def merge_by_name(raw: DataFrame) -> DataFrame:
    """One entity for each name of raw(book_id, seq, name, entity_type, tags, summary, source_chunk_id, source_node_id):
    the first row's fields, all tags in order of appearance, and the longest summary, the first of equal length."""
    fields = ("name", "entity_type", "source_chunk_id", "source_node_id")
    key = name_key(F.col("name")).alias("name_key")
    #: Each tag of a name once before they meet, where it comes first.
    places = raw.select("book_id", "name", "seq", F.posexplode("tags").alias("_i", "tag")).groupBy("book_id", key, "tag").agg(F.min(F.struct("seq", "_i")).alias("at"))
    tags = places.groupBy("book_id", "name_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]).alias("tags"))
    kinds = raw.schema
    first, longest = F.struct("seq", *fields).alias("_first"), F.struct(F.coalesce(-F.length("summary"), F.lit(1)).alias("n"), "seq", "summary").alias("_longest")
    rows = raw.select("book_id", key, first, longest, F.lit(None).cast(kinds["tags"].dataType).alias("tags"))
    #: Names with their tags meet their rows in one pass.
    rows = rows.unionByName(tags.select("book_id", "name_key", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_first", "_longest")], "tags"))
    merged = rows.groupBy("book_id", "name_key").agg(F.min("_first").alias("_first"), F.min("_longest").alias("_longest"), F.max("tags").alias("tags"))
    merged = merged.select("book_id", "name_key", "_first.name", "_first.entity_type", F.coalesce("tags", F.array().cast(kinds["tags"].dataType)).alias("tags"), "_longest.summary", "_first.source_chunk_id", "_first.source_node_id")
    return merged.withColumn("id", gen_id(F.col("book_id"), F.col("name_key"), prefix="ent_"))


def absorb(entities: DataFrame, merged: DataFrame) -> DataFrame:
    """Entities after a similarity merge(id, representative): representatives with the tags of those they absorb."""
    return _representatives(entities.join(merged.select("id", "representative"), "id"))


def _representatives(tied: DataFrame) -> DataFrame:
    """Those of entities with their representative, with all tags."""
    tags = tied.filter(F.size("tags") > 0).groupBy("representative").agg(F.array_distinct(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct((F.col("id") != F.col("representative")).alias("later"), "id", "tags"))), lambda x: x["tags"]))).alias("tags"))
    kept = tied.filter("id = representative").drop("tags", "representative").join(tags.withColumnRenamed("representative", "id"), "id", "left")
    return kept.withColumn("tags", F.coalesce("tags", F.array().cast(tied.schema["tags"].dataType)))


def resolve_edges(raw: DataFrame, entities: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Relations of raw(book_id, source_name, target_name, ...) with entity ids; those that name no entity drop out.
    merged(id, representative) sends names of absorbed entities to their representatives."""
    names = entities.select("book_id", name_key(F.col("name")).alias("_key"), F.col("id").alias("_id"))
    if merged is not None:
        names = names.join(merged.select(F.col("id").alias("_id"), "representative"), "_id", "left").withColumn("_id", F.coalesce("representative", "_id")).drop("representative")
    return _linked(raw, names)


def _linked(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with the ids of names(book_id, _key, _id)."""
    for side in ("source", "target"):
        end = names.select("book_id", F.col("_key"), F.col("_id").alias(f"{side}_entity_id"))
        raw = raw.withColumn("_key", name_key(F.col(f"{side}_name"))).join(end, ["book_id", "_key"]).drop("_key")
    return raw


def unresolved_edges(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations that resolve_edges leaves out."""
    names = entities.select("book_id", name_key(F.col("name")).alias("_key")).distinct()
    out = None
    for side in ("source", "target"):
        bad = raw.withColumn("_key", name_key(F.col(f"{side}_name"))).join(names, ["book_id", "_key"], "left_anti").drop("_key")
        out = bad if out is None else out.unionByName(bad)
    return out.distinct()


def incident(edges: DataFrame) -> DataFrame:
    """Every edge under each of its ends: (entity_id, other_id, *edge), once for a loop."""
    one = edges.select(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other_id"), *_EDGE)
    two = edges.filter("source_entity_id <> target_entity_id").select(F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("other_id"), *_EDGE)
    return one.unionByName(two)


def edges_of(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.filter((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id))


def find_entities(entities: DataFrame, query: str, limit: int = 10, book_id=None) -> DataFrame:
    """Entities with the query in name or summary, in any case, by id; an optional book filters first."""
    if book_id is not None:
        entities = entities.filter(F.col("book_id") == book_id)
    hit = lambda c: F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return entities.filter(hit("name") | hit("summary")).orderBy("id").limit(limit)


def find_relations(edges: DataFrame, query: str, limit: int = 10, book_id=None) -> DataFrame:
    if book_id is not None:
        edges = edges.filter(F.col("book_id") == book_id)
    hit = lambda c: F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return edges.filter(hit("summary") | hit("relation_type")).orderBy("id").limit(limit)


def by_ids(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of the given ids, in the order given; unknown ids are left out."""
    asked = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
    return rows.join(F.broadcast(asked), "id").orderBy("pos").drop("pos")


def entity_first(edges: DataFrame, seeds: DataFrame, max_hop: int = 2) -> DataFrame:
    """(entity_id, hop, score, relationships) of the entities within max_hop of seeds(entity_id, score), each once at
    its smallest hop; only seeds keep their score. relationships are all incident edges, by id.

    A round is one join of the new entities with their edges, less those seen."""
    ends = incident(edges)
    front = seeds.groupBy("entity_id").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    seen = front
    for hop in range(1, max_hop + 1):
        front = ends.join(front.select("entity_id"), "entity_id").select(F.col("other_id").alias("entity_id")).distinct().join(
            seen.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(0.0).alias("score"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(front)
    own = ends.join(seen.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*_EDGE))).alias("relationships"))
    return seen.join(own, "entity_id", "left").withColumn("relationships", F.coalesce("relationships", F.array().cast(own.schema["relationships"].dataType)))


def relationship_first(edges: DataFrame, seeds: DataFrame, max_hop: int = 2) -> DataFrame:
    """(id, score, hop, via, other_id) for seed relations seeds(rank, id, score): the seeds at hop 0, then, for each end
    not seen before in rank order, its first EDGES relations whose other end is not seen yet, at hop 1."""
    hit = edges.join(F.broadcast(seeds), "id")
    zero = hit.select("rank", F.lit(0).alias("place"), "id", "score", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("other_id"))
    if max_hop <= 0:
        return zero.drop("rank", "place")
    ends = hit.select("rank", F.posexplode(F.array("source_entity_id", "target_entity_id")).alias("end", "via")).filter("via <> ''")
    visited = ends.groupBy("via").agg(F.min(F.struct("rank", "end")).alias("at"))
    first = Window.partitionBy("via").orderBy("id")
    near = incident(edges).withColumnRenamed("entity_id", "via").join(visited, "via").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= EDGES)
    when = visited.select(F.col("via").alias("other_id"), F.col("at").alias("other_at"))
    near = near.join(when, "other_id", "left").filter("other_at is null or other_at > at")
    one = near.select(F.col("at.rank").alias("rank"), (F.col("at.end") * EDGES + F.col("n")).alias("place"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("hop"), "via", "other_id")
    return zero.unionByName(one).orderBy("rank", "place").drop("rank", "place")


def fts_first(entities: DataFrame, edges: DataFrame, query: str, limit: int = 10, max_hop: int = 2, book_id=None) -> DataFrame:
    """(entity_id, score, hop, relationships): entities that the text search finds, with all their edges, and their
    neighbours that are not among them, with the first EDGES edges of each."""
    hits = find_entities(entities, query, limit, book_id).select(F.col("id").alias("entity_id")).persist()
    ends = incident(edges)
    pack = lambda df: df.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*_EDGE))).alias("relationships"))
    out = hits.withColumn("score", F.lit(1.0)).withColumn("hop", F.lit(0)).join(pack(ends.join(hits, "entity_id", "left_semi")), "entity_id", "left")
    if max_hop > 0:
        near = ends.join(hits, "entity_id", "left_semi").select(F.col("other_id").alias("entity_id")).distinct().join(hits, "entity_id", "left_anti")
        first = Window.partitionBy("entity_id").orderBy("id")
        some = ends.join(near, "entity_id", "left_semi").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= EDGES).drop("n")
        out = out.unionByName(near.withColumn("score", F.lit(0.0)).withColumn("hop", F.lit(1)).join(pack(some), "entity_id", "left"))
    return out.orderBy("hop", "entity_id")


def build_graph(chunks: DataFrame, extract, embed=None, merge_at: float | None = 0.85) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of chunks(book_id, chunk_id, node_id, chunk_text): extract, merge by name, merge by
    similarity of embeddings, and link. extract and embed are column functions, see folioframe.models."""
    from folioframe.operators.vector import greedy_merge

    rounds = Rounds(chunks.sparkSession, "graph")
    found = rounds.save(chunks.select("book_id", "chunk_id", "node_id", extract(F.col("chunk_text")).alias("_x")), "found")
    raw = found.select("book_id", "chunk_id", "node_id", F.posexplode("_x.entities").alias("i", "e")).select(
        "book_id", F.struct("chunk_id", "i").alias("seq"), F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type"), F.col("e.tags").alias("tags"),
        F.col("e.summary").alias("summary"), F.col("chunk_id").alias("source_chunk_id"), F.col("node_id").alias("source_node_id"))
    entities = named = rounds.save(merge_by_name(raw), "entities")
    if embed is not None and merge_at is not None:
        body, inside = F.concat_ws(" ", "name", "summary"), getattr(embed, "texts", None)
        named = rounds.save(greedy_merge(entities, merge_at, "book_id", vector=embed(body), made=(body, inside) if inside else None), "merged")
        entities = _representatives(named)
        rounds.drop("entities")
    names = named.select("book_id", F.col("name_key").alias("_key"), F.col("representative" if "representative" in named.columns else "id").alias("_id"))
    relations = found.select("book_id", F.col("chunk_id").alias("source_chunk_id"), F.col("node_id").alias("source_node_id"), F.explode("_x.relationships").alias("r")).select(
        "book_id", "source_chunk_id", "source_node_id", "r.source_name", "r.target_name", "r.relation_type", "r.summary", "r.claims")
    #: Exploded rows are many more than Spark takes them for: none of the sides is broadcast.
    edges = _linked(relations, names.hint("merge")).withColumn("id", gen_id(*[F.col(c) for c in ("book_id", "source_chunk_id", "source_entity_id", "target_entity_id", "relation_type")], prefix="rel_"))
    return entities, edges
