"""Stand-ins for language models: column functions that embed, extract and summarise, the same on every run.

Any function from a column to a column can take their place."""

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.scalars import once, salvage_json

DIMENSIONS = 64
_WORD = re.compile(r"\w+")
#: No letter stands before a name; told after its first one, as sets at the start are looked for faster than boundaries.
_NAME = re.compile(r"[A-Z](?<!\w[A-Z])[\w'-]+(?:\s+[A-Z][\w'-]+)*")


def embed_text(text: str, size: int = DIMENSIONS) -> list[float]:
    """Signed counts of hashed words, of length 1."""
    v = np.zeros(size)
    for w in _WORD.findall(text.lower()):
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h >> 16 & 1 else -1
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).tolist()


def embed_texts(texts: list, size: int = DIMENSIONS) -> np.ndarray:
    """embed_text of each, as one matrix."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((zlib.crc32(w.encode()) for some in words for w in some), np.int64, len(rows))
    v = np.bincount(rows * size + h % size, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * size).reshape(len(texts), size)
    n = np.sqrt((v * v).sum(1))  # of whole numbers
    return np.divide(v, n[:, None], out=v, where=n[:, None] > 0)


def embed(text: Column, size: int = DIMENSIONS) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        v = embed_texts(texts.to_pylist(), size)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, size, dtype=np.int32)), pa.array(v.ravel()))
    return run(text)


#: What embed computes inside a task; where a model has it, its vectors need not pass through Spark.
embed.texts = embed_texts


def extract(text: Column) -> Column:
    """Capitalised phrases as entities and neighbours as relations; blank names drop out."""
    schema = ("entities array<struct<name:string,entity_type:string,tags:array<string>,summary:string>>,"
              "relationships array<struct<source_name:string,target_name:string,relation_type:string,summary:string,claims:array<string>>>")

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        names = [list(dict.fromkeys(_NAME.findall(t))) if t else [] for t in texts.to_pylist()]
        near = [[p for p in zip(some, some[1:])] for some in names]

        def lists(rows: list[list], **fields) -> pa.Array:
            columns = {k: v([x for some in rows for x in some]) for k, v in fields.items()}
            items = pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.string()) if k in ("tags", "claims") else pa.string()) for k, v in columns.items()], names=list(columns))
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), items)

        same = lambda value: lambda x: [value] * len(x)
        entities = lists(names, name=lambda x: x, entity_type=same("Unknown"), tags=same([]), summary=same(""))
        relations = lists(near, source_name=lambda x: [p[0] for p in x], target_name=lambda x: [p[1] for p in x], relation_type=same("near"), summary=same(""), claims=same([]))
        return pa.StructArray.from_arrays([entities, relations], names=["entities", "relationships"])
    return run(text)


def summarise(text: Column, sentences: int = 2) -> Column:
    """The first sentences."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)[^.。!?]*[.。!?]|[^.。!?]+$"), F.lit(0))
    return F.trim(F.array_join(F.slice(found, 1, sentences), ""))


#: Fields that a book's metadata should have, and what else an answer may tell.
FIELDS, EXTRAS = ("title", "author", "language", "publisher", "description"), "extras"
ANSWER = ", ".join(f"{f} string" for f in FIELDS) + f", {EXTRAS} map<string,string>"
GRAPH_ANSWER = ("entities array<struct<name:string,entity_type:string,tags:array<string>,summary:string>>, "
                "relationships array<struct<source_name:string,target_name:string,relation_type:string,summary:string,claims:array<string>>>")


def parsed(answer: Column, schema: str) -> Column:
    """A model's answer as a struct of the schema's fields: what stands around the outermost braces, such as fences, is cut
    off; null where the rest is no JSON object of this shape. Fields that are missing are null."""
    read = lambda body: F.from_json(body, schema + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return once(salvage_json(answer), lambda body: once(read(body), lambda found: F.when(body.isNotNull() & found["broken"].isNull(), found)))


def answer_metadata(fragment: Column) -> Column:
    """A stand-in's answer about a fragment: the values of lines "Field: ..." in it as JSON, in fences; without any such
    line it is no JSON."""
    line = lambda name: once(F.trim(F.regexp_extract(fragment, rf"(?im)^\s*{name}\s*:\s*(.+)$", 1)), lambda v: F.when(v != "", v))
    series = once(line("series"), lambda v: F.when(v.isNotNull(), F.create_map(F.lit("series"), v)))
    some = F.to_json(F.struct(*[line(f).alias(f) for f in FIELDS], series.alias(EXTRAS)))
    return once(some, lambda x: F.when(x == "{}", "nothing found").otherwise(F.concat(F.lit("Here it is:\n```json\n"), x, F.lit("\n```"))))


def metadata_rounds(docs: DataFrame, ask=answer_metadata, key: str = "book_id", text: str = "text", rounds: int = 3, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, *fields, extras, rounds, failures, stopped): each round asks about the next fragment of every book that is not
    complete yet, and only of those. The last non-blank value of a field counts, of extras those of later answers win,
    an answer that cannot be read is a failure. stopped is `complete`, `rounds` or `text`, where a book has no more text.

    Defined cases: a book without text is asked once, about an empty fragment; null values and blanks do not count."""
    from folioframe.operators.text import metadata_fragments
    from folioframe.sources.files import Rounds

    saved = Rounds(docs.sparkSession, "metadata").save
    fragments = metadata_fragments(docs, key, text, most=rounds)
    parts = saved(fragments.withColumn("_of", F.lit(1)), "fragments")
    number = parts.groupBy(key).agg(F.count("*").alias("_parts"))
    empty = [F.lit("").alias(f) for f in fields]
    now = number.select(key, "_parts", *empty, F.create_map().cast("map<string,string>").alias(EXTRAS), F.lit(0).alias("rounds"), F.lit(0).alias("failures"))
    complete = reduce(Column.__and__, [F.col(f) != "" for f in fields])
    done = None
    for i in range(rounds):
        part = parts.filter(F.col("fragment") == i).select(key, parsed(ask(F.col("fragment_text")), ANSWER).alias("_x"))
        asked = now.join(part, key)
        said = lambda f: F.nullif(F.trim(F.coalesce(F.col(f"_x.{f}"), F.lit(""))), F.lit(""))
        extras = F.coalesce(F.map_filter(F.col(f"_x.{EXTRAS}"), lambda k, v: v.isNotNull() & (F.trim(v) != "")), F.create_map().cast("map<string,string>"))
        step = asked.select(key, "_parts", *[F.coalesce(said(f), F.col(f)).alias(f) for f in fields], merged_maps(F.col(EXTRAS), extras).alias(EXTRAS),
                            (F.col("rounds") + 1).alias("rounds"), (F.col("failures") + F.col("_x").isNull().cast("int")).alias("failures"))
        step = saved(step.withColumn("stopped", F.when(complete, "complete").when(F.lit(i + 1) == rounds, "rounds").when(F.col("_parts") <= i + 1, "text")), f"round{i}")
        ended = step.filter("stopped is not null").drop("_parts")
        done = ended if done is None else done.unionByName(ended)
        now = step.filter("stopped is null").drop("stopped")
    return done


def merged_maps(left: Column, right: Column) -> Column:
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def extract_metadata(docs: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """(key, title, author, language) of each text by the stand-in's answers."""
    return metadata_rounds(docs, key=key, text=text).select(key, "title", "author", "language")


def answered_graph(chunks: DataFrame, ask) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, failures) of chunks(book_id, chunk_id, node_id, chunk_text) by a model's answers, which ask
    makes of a chunk's text. Entities have the columns that graph.merge_by_name takes; blank names and relations with a
    blank end drop out, types that are not known are as they are, and null lists are empty. failures(book_id, chunks,
    failed) counts the chunks of each book whose answer could not be read."""
    from folioframe.functions.scalars import strip
    from folioframe.sources.files import Rounds

    said = chunks.select("book_id", "chunk_id", "node_id", parsed(ask(F.col("chunk_text")), GRAPH_ANSWER).alias("x"))
    said = Rounds(chunks.sparkSession, "answers").save(said, "said")
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    e = said.select("book_id", "chunk_id", "node_id", F.posexplode("x.entities").alias("i", "e"))
    entities = e.select("book_id", F.struct("chunk_id", "i").alias("seq"), text("e.name").alias("name"), F.when(text("e.entity_type") == "", "Unknown").otherwise(text("e.entity_type")).alias("entity_type"),
                        F.filter(F.coalesce("e.tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != "")).alias("tags"), text("e.summary").alias("summary"),
                        F.col("chunk_id").alias("source_chunk_id"), F.col("node_id").alias("source_node_id")).filter("name <> ''")
    r = said.select("book_id", "chunk_id", "node_id", F.explode("x.relationships").alias("r"))
    relations = r.select("book_id", F.col("chunk_id").alias("source_chunk_id"), F.col("node_id").alias("source_node_id"), text("r.source_name").alias("source_name"), text("r.target_name").alias("target_name"),
                         text("r.relation_type").alias("relation_type"), text("r.summary").alias("summary"), F.coalesce("r.claims", F.array().cast("array<string>")).alias("claims")).filter("source_name <> '' and target_name <> ''")
    failures = said.groupBy("book_id").agg(F.count("*").alias("chunks"), F.sum(F.col("x").isNull().cast("long")).alias("failed"))
    return entities, relations, failures
