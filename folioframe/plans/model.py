"""The engine's relations as views of plain tables: books, messages, usage logs, files and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.sources.files import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def books(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, text): each document as a book whose lines are, in turn, a heading of level 1, text, and headings of
    levels 3 and 2."""
    line = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.get(F.array(F.lit("# "), F.lit(""), F.lit("### "), F.lit("## ")), (i % 4).cast("int")), x)), "\n")
    return docs(spark, d).select(F.col("doc_id").alias("book_id"), line.alias("text"))


BOOKS = """books as (select doc_id book_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  case (i - 1) % 4 when 0 then '# ' when 1 then '' when 2 then '### ' else '## ' end || x), chr(10)) as text from documents)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def seconds(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) / 1e6D")


def usage(spark: SparkSession, d: str) -> DataFrame:
    """events as a usage log: a third of the rows have actual tokens."""
    actual = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 50).cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), seconds("ts").alias("ts"), F.col("event_type").alias("mode"), F.floor("value").cast("long").alias("estimated"),
        actual.alias("actual_in"), (actual * 2).alias("actual_out"))


USAGE = """usage as (select event_id id, epoch_us(ts) / 1e6 ts, event_type as mode, floor(value)::bigint estimated,
  case when event_id % 3 = 0 then user_id % 50 end actual_in, case when event_id % 3 = 0 then user_id % 50 * 2 end actual_out from events)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as stored files."""
    return docs(spark, d).select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"), F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size"))


FILES = "files as (select source || '/' || lang || '/' || doc_id || '.txt' as key, sha256(text) content_hash, octet_length(encode(text)) size from documents)"


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """The contents of files, but for some that are lost and some that are not what their name says."""
    number = F.col("doc_id") % 10
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min_by("text", "doc_id").alias("t"), F.min("doc_id").alias("doc_id")).select(
        "content_hash", F.when(number == 3, F.concat("t", F.lit("!"))).otherwise(F.col("t")).cast("binary").alias("content"), number.alias("n")).filter("n <> 7").drop("n")


BLOBS = """blobs as (select content_hash, case when m % 10 = 3 then t || '!' else t end as content from
  (select sha256(text) content_hash, any_value(text) t, min(doc_id) m from documents group by 1) where m % 10 <> 7)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a supplier delivered."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_entity_id"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("target_entity_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_linestatus").alias("summary"),
        F.col("l_orderkey").cast("string").alias("source_chunk_id"))


EDGES = """edges as (select 'e-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey id, 's' || l_suppkey source_entity_id, 'p' || l_partkey target_entity_id,
  l_returnflag relation_type, l_linestatus summary from lineitem),
ends as (select source_entity_id a, target_entity_id b, id from edges union all select target_entity_id, source_entity_id, id from edges)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit(1).alias("book_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("summary"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.lit(1).alias("book_id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"))
    return s.unionByName(p)


ENTITIES = """entities as (select 's' || s_suppkey id, s_name as name, 'supplier' summary from supplier
  union all select 'p' || p_partkey, p_name, p_type from part)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
