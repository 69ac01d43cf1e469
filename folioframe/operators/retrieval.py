"""The three graph retrievals for a table of queries at once.

A frontier is a table of (query, entity), each query has visited entities of its own, and a round is one join for all
queries. Edges stay rows. An entity with many edges is cut into shares by a hash of the other end, and a frontier row goes
to each share, so a hub is many tasks. Every round is a written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.graph import _EDGE, EDGES, incident
from folioframe.sources.files import Rounds

#: Neighbours of a share.
SHARE = 4096
#: Rows that a task of a round puts out on average, and the most tasks of a round.
REACH, TASKS = 500_000, 10_000
#: Texts of queries that one pass over the entities looks for; a larger set is several passes.
TEXTS = 100_000


def neighbours(edges: DataFrame, of: DataFrame, rounds: Rounds, name: str, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(adjacent, counts) of the entities of `of`, as written tables: adjacent(entity_id, share, other_id) has each
    neighbour once, counts(entity_id, n, shares) the number of neighbours and of shares that they are cut into.

    The ids are a table of known size, so Spark leaves out other entities' edges as it reads them where the ids are few,
    and shuffles the edges where they are many."""
    ids = rounds.save(of.select("entity_id").distinct(), f"{name}-ids")
    pairs = rounds.save(incident(edges).select("entity_id", "other_id").distinct().join(ids, "entity_id", "left_semi"), f"{name}-pairs")
    counts = pairs.groupBy("entity_id").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / share).cast("int"))
    counts = rounds.save(counts, f"{name}-counts")
    cut = pairs.join(counts, "entity_id").select("entity_id", F.pmod(F.xxhash64("other_id"), "shares").cast("int").alias("share"), "other_id")
    return rounds.save(cut, f"{name}-adjacent"), counts


def step(front: DataFrame, adjacent: DataFrame, counts: DataFrame) -> DataFrame:
    """(query, entity_id) of all neighbours of front(query, entity_id), with repeats. The tasks follow the number of rows
    that come out, which a small front may have many of."""
    sent = front.select("query", "entity_id").join(counts, "entity_id")
    tasks = min((sent.agg(F.sum("n")).first()[0] or 0) // REACH + 1, TASKS)
    sent = sent.select("query", "entity_id", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).repartition(tasks, "entity_id", "share")
    return sent.join(adjacent, ["entity_id", "share"]).select("query", F.col("other_id").alias("entity_id"))


def entity_first(edges: DataFrame, seeds: DataFrame, max_hop: int = 2, share: int = SHARE) -> DataFrame:
    """(query, entity_id, hop, score): for each query of seeds(query, entity_id, score) the entities within max_hop of its
    seeds, each once at its smallest hop; only seeds keep their score, the highest of repeated ones. entity_edges() adds
    their edges.

    Defined cases: seeds that no edge has stay, at hop 0; a null entity_id is no seed; null is a query like others."""
    rounds = Rounds(edges.sparkSession, "entity-first")
    query = F.col("query")
    seeds = seeds.filter("entity_id is not null").groupBy(query, "entity_id").agg(F.max("score").cast("double").alias("score")).withColumn("hop", F.lit(0))
    front = seen = rounds.save(seeds.select("query", "entity_id", "hop", "score"), "hop0")
    for hop in range(1, max_hop + 1):
        known = seen.select(query.alias("_q"), F.col("entity_id").alias("_e"))
        new = step(front, *neighbours(edges, front, rounds, f"near{hop}", share)).distinct()
        new = new.join(known, query.eqNullSafe(F.col("_q")) & (F.col("entity_id") == F.col("_e")), "left_anti")
        front = rounds.save(new.select("query", "entity_id", F.lit(hop).alias("hop"), F.lit(0.0).alias("score")), f"hop{hop}")
        for part in ("ids", "pairs", "counts", "adjacent"):
            rounds.drop(f"near{hop}-{part}")
        seen = seen.unionByName(front)
    return seen


def entity_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, entity_id, *edge): the edges of the entities of found(query, entity_id), a row for each."""
    return found.select("query", "entity_id").join(incident(edges).drop("other_id"), "entity_id").select("query", "entity_id", *_EDGE)


def degrees(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found with n_edges, the number of each entity's edges. The edges of the entities found are counted into a written
    table, then found is joined to it."""
    rounds = Rounds(edges.sparkSession, "degrees")
    ids = rounds.save(found.select("entity_id").distinct(), "ids")
    n = rounds.save(incident(edges).groupBy("entity_id").agg(F.count("*").alias("n_edges")).join(ids, "entity_id", "left_semi"), "n")
    return found.join(n, "entity_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def first_edges(edges: DataFrame, n: int = EDGES) -> DataFrame:
    """(entity_id, other_id, *edge, n): each entity's first edges by id. They are chosen within shares of an entity first."""
    ends = incident(edges).withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = ends.withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "_share").orderBy("id", "other_id"))).filter(F.col("n") <= n)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("id", "other_id"))).filter(F.col("n") <= n).drop("_share")


def relationship_first(edges: DataFrame, seeds: DataFrame, max_hop: int = 2) -> DataFrame:
    """(query, rank, place, id, score, hop, via, other_id) for seed relations seeds(query, rank, id, score): the seeds at
    hop 0, then, for each end that the query has not seen before in rank order, its first EDGES relations whose other
    end is not seen yet, at hop 1. (rank, place) is their order.

    Defined cases: seeds that are no relation are left out; ends without a name lead nowhere."""
    hit = seeds.join(edges, "id")
    zero = hit.select("query", "rank", F.lit(0).alias("place"), "id", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("other_id"))
    if max_hop <= 0:
        return zero
    ends = hit.select("query", "rank", F.posexplode(F.array("source_entity_id", "target_entity_id")).alias("end", "via")).filter("via <> ''")
    rounds = Rounds(edges.sparkSession, "relationship-first")
    visited = rounds.save(ends.groupBy("query", "via").agg(F.min(F.struct("rank", "end")).alias("at")), "visited")
    near = visited.join(first_edges(edges).withColumnRenamed("entity_id", "via"), "via")
    when = visited.select(F.col("query").alias("_q"), F.col("via").alias("_other"), F.col("at").alias("_at"))
    near = near.join(when, F.col("query").eqNullSafe(F.col("_q")) & (F.col("other_id") == F.col("_other")), "left").filter("_at is null or _at > at")
    one = near.select("query", F.col("at.rank").alias("rank"), (F.col("at.end") * EDGES + F.col("n")).alias("place"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("hop"), "via", "other_id")
    return zero.unionByName(one)


def find_entities(entities: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, entity_id): for each of queries(query, text) the first `limit` entities by id whose name or summary holds
    the text in any case. All texts are looked for in one pass over the entities, TEXTS at a time.

    Defined cases: an empty text is in every name; null texts and null queries find nothing."""
    spark = entities.sparkSession
    asked = queries.filter("query is not null and text is not null").select("query", F.lower("text").alias("text"))
    kind = dict(asked.dtypes)["query"]
    texts = [r.text for r in asked.select("text").distinct().toLocalIterator()]
    out = None
    for at in range(0, len(texts), TEXTS):
        some = spark.sparkContext.broadcast(texts[at:at + TEXTS])

        def search(batches):
            import ahocorasick

            known, everywhere = ahocorasick.Automaton(), "" in some.value  # noqa: B023
            for t in some.value:  # noqa: B023
                if t:
                    known.add_word(t, t)
            known.make_automaton()
            for batch in batches:
                ids, found = [], []
                for i, *fields in zip(*(c.to_pylist() for c in batch.columns)):
                    hits = {t for f in fields if f and len(known) for _, t in known.iter(f)} | ({""} if everywhere and any(f is not None for f in fields) else set())
                    ids += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())], names=["entity_id", "text"])

        rows = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("name"), F.lower("summary").alias("summary"))
        hits = rows.mapInArrow(search, f"entity_id {dict(rows.dtypes)['entity_id']}, text string")
        share = Window.partitionBy("text", F.pmod(F.xxhash64("entity_id"), F.lit(64))).orderBy("entity_id")
        hits = hits.distinct().withColumn("_n", F.row_number().over(share)).filter(F.col("_n") <= limit)
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("entity_id"))).filter(F.col("_n") <= limit).drop("_n")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return asked.filter("false").select("query", F.lit("").alias("entity_id"))
    return asked.join(out, "text").select(F.col("query").cast(kind).alias("query"), "entity_id").distinct()


def text_first(entities: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = 10, max_hop: int = 2, share: int = SHARE) -> DataFrame:
    """(query, entity_id, hop, score): the entities that each query's text search finds, and their neighbours that are
    not among them. entity_edges() adds the edges of the former, first_edges() those shown of the latter."""
    rounds = Rounds(edges.sparkSession, "text-first")
    hits = rounds.save(find_entities(entities, queries, limit), "hits")
    out = hits.select("query", "entity_id", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    if max_hop > 0:
        near = step(hits, *neighbours(edges, hits, rounds, "near", share)).distinct().join(hits, ["query", "entity_id"], "left_anti")
        out = out.unionByName(rounds.save(near.select("query", "entity_id", F.lit(1).alias("hop"), F.lit(0.0).alias("score")), "found"))
    return out
