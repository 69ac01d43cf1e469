"""From text offsets back to the source: point-in-interval joins and locating spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a bucket of the interval join.
BUCKET = 4096


def lookup(points: DataFrame, mappings: DataFrame, key: str = "book_id", bucket: int = BUCKET) -> DataFrame:
    """points(key, offset, ...) with every mapping whose [content_offset, content_offset + content_length) holds the
    offset. Intervals are listed under each bucket they touch, so the join is on equal keys, not on ranges."""
    start, stop = F.col("content_offset"), F.col("content_offset") + F.col("content_length")
    spread = mappings.filter("content_length > 0").withColumn("_b", F.explode(F.sequence(F.floor(start / bucket), F.floor((stop - 1) / bucket))))
    return points.withColumn("_b", F.floor(F.col("offset") / bucket)).join(spread, [key, "_b"]).filter((start <= F.col("offset")) & (stop > F.col("offset"))).drop("_b")


def lookup_one(mappings: DataFrame, book_id, offset: int) -> DataFrame:
    return mappings.filter((F.col("book_id") == book_id) & (F.col("content_offset") <= offset) & (F.col("content_offset") + F.col("content_length") > offset)).orderBy("content_offset")


def on_page(mappings: DataFrame, book_id, page: int) -> DataFrame:
    return mappings.filter((F.col("book_id") == book_id) & (F.col("page_index") == page)).orderBy("content_offset")
