"""A content-addressed store as relations: file_index(key, content_hash, size, created_at, modified_at, metadata) and
blobs(content_hash, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.scalars import normalize_key
from folioframe.operators.tables import last_of, numbered, upsert


def hashed(files: DataFrame) -> DataFrame:
    """files(key, content) with the key in normal form and the content's hash and size."""
    return files.withColumn("key", normalize_key(F.col("key"))).withColumn("content_hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))


def upload(index: DataFrame, blobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, blobs) after storing files(key, content, created_at, modified_at, metadata): equal contents are stored
    once, a known key points to its new content and keeps created_at. Keys are equal in normal form; of several files
    with one key the last modified counts, then the one of the greater hash."""
    new = last_of(hashed(files), ["key"], ["modified_at", "content_hash"])
    kept = index.select("key", F.col("created_at").alias("_first"))
    rows = new.join(kept, "key", "left").withColumn("created_at", F.coalesce("_first", "created_at")).select(*index.columns)
    fresh = new.select("content_hash", "content").dropDuplicates(["content_hash"]).join(blobs.select("content_hash"), "content_hash", "left_anti")
    return upsert(index, rows, ["key"]), blobs.unionByName(fresh.select(*blobs.columns))


def joined_parts(parts: DataFrame) -> DataFrame:
    """(key, content) of parts(key, part, content), in order of part."""
    return parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p")).select("key", F.aggregate(
        "p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"])).alias("content"))


def delete(index: DataFrame, blobs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index, blobs) without the keys and without contents that nothing refers to any more."""
    left = index.filter(~F.col("key").isin(keys))
    return left, blobs.join(left.select("content_hash"), "content_hash", "left_semi")


def clear(index: DataFrame, blobs: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    left = index.filter(~F.col("key").startswith(prefix))
    return left, blobs.join(left.select("content_hash"), "content_hash", "left_semi")


def copy(index: DataFrame, source: str, target: str) -> DataFrame:
    """The index with target pointing to source's content."""
    return upsert(index, index.filter(F.col("key") == source).withColumn("key", normalize_key(F.lit(target))), ["key"])


def list_keys(index: DataFrame, prefix: str = "", page_size: int | None = None) -> DataFrame:
    """Keys with the prefix in order; with a page size also the page, from 0."""
    keys = index.filter(F.col("key").startswith(prefix)).select("key")
    if page_size is None:
        return keys.orderBy("key")
    return numbered(keys, ["key"], "_rank").select("key", F.expr(f"_rank div {page_size}").alias("page"))


def list_dir(index: DataFrame, prefix: str = "") -> DataFrame:
    """(name, is_dir, key) of what lies directly below a prefix, directories first."""
    prefix = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
    rows = index.filter(F.col("key").startswith(prefix)).select("key", rest.alias("rest")).filter("rest <> ''").select(
        F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("is_dir"), "key")
    return rows.groupBy("name", "is_dir").agg(F.min("key").alias("key")).select(
        "name", "is_dir", F.when(F.col("is_dir"), F.concat(F.lit(prefix), F.col("name"))).otherwise(F.col("key")).alias("key")).orderBy(~F.col("is_dir"), "name")


def reference_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("content_hash").agg(F.count("*").alias("refs"))


def duplicates(index: DataFrame) -> DataFrame:
    """(content_hash, keys, n) of contents with several keys."""
    return index.groupBy("content_hash").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count("*").alias("n")).filter("n > 1")


def orphans(index: DataFrame, blobs: DataFrame) -> DataFrame:
    return blobs.select("content_hash").join(index.select("content_hash"), "content_hash", "left_anti")


def dangling(index: DataFrame, blobs: DataFrame) -> DataFrame:
    return index.join(blobs.select("content_hash"), "content_hash", "left_anti").select("key", "content_hash")


def download(index: DataFrame, blobs: DataFrame, keys: list[str] | None = None, verify: bool = False) -> DataFrame:
    """(key, content); with verify, contents that do not have their hash are left out."""
    asked = index if keys is None else index.filter(F.col("key").isin(keys))
    rows = asked.select("key", "content_hash").join(blobs, "content_hash")
    return (rows.filter(F.sha2("content", 256) == F.col("content_hash")) if verify else rows).select("key", "content")


def content_chunks(rows: DataFrame, size: int) -> DataFrame:
    """(key, part, content) in parts of `size` bytes."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("content") / size).cast("int") - 1)
    return rows.select("key", "content", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("key", "part", F.expr(f"substring(content, part * {size} + 1, {size})").alias("content"))


def verify(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """(key, expected, actual) of keys whose content is missing or has another hash."""
    actual = blobs.select("content_hash", F.sha2("content", 256).alias("actual"))
    return index.select("key", "content_hash").join(actual, "content_hash", "left").select(
        "key", F.col("content_hash").alias("expected"), F.coalesce("actual", F.lit("<missing>")).alias("actual")).filter("actual <> expected")


def reconcile(index: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, quarantined) against the files found(content_hash, content): files whose name is not their hash are
    quarantined, and keys without a good file are dropped."""
    good = F.sha2("content", 256) == F.col("content_hash")
    return index.join(found.filter(good).select("content_hash"), "content_hash", "left_semi"), found.filter(~good)


def by_checksum(index: DataFrame, content_hash: str) -> DataFrame:
    return index.filter(F.col("content_hash") == content_hash)
