"""Keyed writes on immutable tables: a new version of a table is an expression over the old one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioframe.sources.files import shared_dir


def last_of(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key, null being a key like others, in order of the named columns or, without any, of the
    batch as it lies. One aggregation: a key with many rows is no hot task."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    at = F.struct(*order) if order else F.monotonically_increasing_id()
    return rows.withColumn("_at", at).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, "_at").alias("_row")).select("_row.*")


def without(table: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of table whose key is not in keyed; null keys are equal."""
    gone = keyed.select(*[F.col(f"`{k}`").alias(f"_gone_{k}") for k in keys])
    return table.join(gone, reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_gone_{k}`")) for k in keys]), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """table with rows put in place of those of the same keys. Of rows with one key the last counts, in order of the named
    columns or as they lie; null is a key like others."""
    rows = last_of(rows, keys, order)
    return without(table, rows, keys).select(*table.columns).unionByName(rows.select(*table.columns))


def insert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows added; a key that is there already is an error."""
    known = rows.join(table.select(*keys), keys, "left_semi")
    clash = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
    if (bad := known.select(*keys).unionByName(clash).first()) is not None:
        raise KeyError(tuple(bad))
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, rows: DataFrame, keys: list[str], stamp: str | None = "updated_at", now: float | None = None) -> DataFrame:
    """table with rows in place of those of the same keys, stamped; keys that are not there are an error."""
    if (bad := rows.join(table.select(*keys), keys, "left_anti").select(*keys).first()) is not None:
        raise KeyError(tuple(bad))
    if stamp:
        rows = rows.withColumn(stamp, F.lit(now) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6)
    return upsert(table, rows, keys)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], book_ids: list, key: str = "book_id") -> dict[str, DataFrame]:
    """Every table without the books' rows."""
    return {name: t.filter(~F.col(key).isin(book_ids)) for name, t in tables.items()}


def replace_group(table: DataFrame, rows: DataFrame, group: str = "book_id") -> DataFrame:
    """table with the groups that rows has replaced by them."""
    return table.join(rows.select(group).distinct(), group, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def write_groups(rows: DataFrame, path: str, batch: str, order: list[str] | None = None, watch: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add rows to a table as one batch, in ranges of `order`, and read the batch. Batches replace the groups they have
    when the table is read; many groups share a file, and no other batch is read or written anew. watch may observe the
    rows as they are written, once each, which they are not before they are dealt by ranges."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    watch(placed).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={batch}")


def read_groups(spark: SparkSession, path: str, schema, batches: DataFrame, group: str = "book_id") -> DataFrame:
    """The rows of each group's last batch, for batches(group, batch) of all that was written: a group that was written
    again without rows has none."""
    last = batches.groupBy(group).agg(F.max("batch").alias("batch"))
    kind = StructType([*(StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, StructField("batch", StringType())])
    return spark.read.schema(kind).parquet(path).join(last, [group, "batch"], "left_semi").drop("batch")


def numbered(rows: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """rows with their number from 0 in the order of the whole table. They are dealt by ranges and written, a row's number
    is its place in its range and the rows of the ranges before: no task sorts more than a range."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    ends = dealt.groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count("*").alias("n")).sort("part").collect()  # one row for each range
    before, run = {}, 0
    for part, n in ends:
        before[part] = run
        run += n
    first = F.get(F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)]), F.shiftright("_place", 33).cast("int"))
    return dealt.withColumn(name, first + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert_manifest(manifest: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """manifest(book_id, index_type, status, count, error, built_at, created_at) after changes(book_id, index_type,
    status, count, error): created_at stays, built_at is now for built indexes and else as it was. Of several changes
    of one index the last in the batch counts."""
    changes = last_of(changes, ["book_id", "index_type"])
    old = manifest.select("book_id", "index_type", F.col("created_at").alias("_created"), F.col("built_at").alias("_built"))
    rows = changes.join(old, ["book_id", "index_type"], "left").withColumn("created_at", F.coalesce("_created", F.lit(now))).withColumn(
        "built_at", F.when(F.col("status") == "built", F.lit(now)).otherwise(F.col("_built")))
    return upsert(manifest, rows, ["book_id", "index_type"])


def set_status(manifest: DataFrame, book_id, index_type: str, status: str, now: float | None = None) -> DataFrame:
    """One manifest row's status; a missing row is an error."""
    at = (F.col("book_id") == book_id) & (F.col("index_type") == index_type)
    if manifest.filter(at).isEmpty():
        raise KeyError((book_id, index_type))
    out = manifest.withColumn("status", F.when(at, F.lit(status)).otherwise(F.col("status")))
    return out if now is None or status != "built" else out.withColumn("built_at", F.when(at, F.lit(now)).otherwise(F.col("built_at")))


def backfill(manifest: DataFrame, books: DataFrame, index_types: list[str], existing: DataFrame, now: float) -> DataFrame:
    """Rows (count 0, built) for the index files existing(book_id, index_type) that the manifest does not have."""
    types = F.explode(F.array(*[F.lit(t) for t in index_types])).alias("index_type")
    every = books.select(F.col("id").alias("book_id"), types)
    missing = every.join(existing, ["book_id", "index_type"], "left_semi").join(manifest, ["book_id", "index_type"], "left_anti")
    return manifest.unionByName(missing.select("book_id", "index_type", F.lit("built").alias("status"), F.lit(0).cast("long").alias("count"), F.lit("").alias("error"),
                                               F.lit(now).alias("built_at"), F.lit(now).alias("created_at")).select(*manifest.columns))


def books_with_indexes(books: DataFrame, manifest: DataFrame) -> DataFrame:
    """books with the sorted list of their built indexes, by creation."""
    built = manifest.filter("status = 'built'").groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list("index_type")).alias("indexes"))
    return books.join(built, "id", "left").withColumn("indexes", F.coalesce("indexes", F.array().cast("array<string>"))).orderBy("created_at", "id")


def merge_metadata(parts: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """For each key the last non-blank value of each field in order of seq."""
    last = lambda c: F.max_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(seq)))
    return parts.groupBy(key).agg(*[F.coalesce(last(c), F.lit("")).alias(c) for c in fields])


def merge_maps(left, right):
    """The entries of both maps, the right one's values winning."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def merge_tools(sets: list[DataFrame], on_conflict: str = "raise") -> DataFrame:
    """The union of toolsets (name, ...) by name; a repeated name is an error or the first set's wins."""
    ranked = reduce(DataFrame.unionByName, (t.withColumn("_set", F.lit(i)) for i, t in enumerate(sets)))
    if on_conflict == "raise" and (bad := ranked.groupBy("name").count().filter("count > 1").first()) is not None:
        raise ValueError(f"two tools are named {bad[0]}")
    return latest(ranked, ["name"], ["_set"]).drop("_set")


def run_sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """Parameterised SQL over registered tables."""
    return spark.sql(text, args=params or None)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"create table if not exists {name} ({schema}) using parquet")


def vacuum(spark: SparkSession, name: str) -> None:
    """Write a table anew in few files, by way of a copy."""
    rows = spark.table(name)
    spark.sql(f"drop table if exists {name}_compact")
    rows.repartition(max(1, rows.rdd.getNumPartitions() // 8)).write.saveAsTable(f"{name}_compact")
    spark.sql(f"drop table {name}")
    spark.sql(f"alter table {name}_compact rename to {name}")


def ping(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("select 1").first()[0] == 1


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")
