"""Queries by way of table functions in SQL and of streams with timers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.functions import tabled
from folioframe.operators import tree
from folioframe.plans import model, text_queries, tree_queries
from folioframe.sources.files import shared_dir
from folioframe.streaming import streams, timed


def _sql(spark, rows, query: str):
    tabled.register(spark)
    return spark.sql(query, rows=rows)


def sql_chunk_text(spark, d):
    return _sql(spark, model.docs(spark, d).select("doc_id", "text"), "select * from chunk_text(table({rows}), 500, 50)")


def sql_builder_chunks(spark, d):
    return _sql(spark, model.docs(spark, d).select("doc_id", "text"), "select * from builder_chunks(table({rows}))")


def sql_heading_scan(spark, d):
    return _sql(spark, model.books(spark, d), "select * from heading_scan(table({rows}))")


def sql_heading_levels(spark, d):
    """Levels by a fold over the heading lines of each book, in their order."""
    lines = tree.heading_scan(model.books(spark, d)).drop("level")
    return _sql(spark, lines, "select * from heading_levels(table({rows}) partition by book_id order by line_offset)")


def stream_calls(spark, d):
    """Conversations as streams of deltas, the turn that is a conversation's last one marked; each is told once."""
    talk = model.messages(spark, d)
    last = talk.groupBy("conv_id").agg(F.max("turn").alias("end"))
    events = talk.join(last, "conv_id").select(F.col("conv_id").alias("call_id"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("delta"), (F.col("turn") == F.col("end")).alias("last"),
                                              F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("ts"))
    root = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/in")
    told = timed.joined_calls(streams.read(spark, f"{root}/in", events.schema), late="1 hour")
    return streams.drain(told, f"{root}/out", "append", f"{root}/state").select("call_id", F.sha2("text", 256).alias("text_hash"), "n", "complete")


QUERIES = {"sql_chunk_text": sql_chunk_text, "sql_builder_chunks": sql_builder_chunks, "sql_heading_scan": sql_heading_scan, "sql_heading_levels": sql_heading_levels, "stream_calls": stream_calls}

ORACLES = {
    "sql_chunk_text": text_queries.ORACLES["chunk_documents"], "sql_builder_chunks": text_queries.ORACLES["builder_chunks"],
    "sql_heading_scan": tree_queries.ORACLES["heading_scan"], "sql_heading_levels": tree_queries.ORACLES["heading_scan"],
    "stream_calls": "select conv_id call_id, sha256(string_agg(text, '' order by turn)) text_hash, count(*) n, true complete from conversations group by 1",
}
