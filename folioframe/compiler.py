"""From files to a library: parse, build trees, validate, index, and keep the manifest."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import tables, tree
from folioframe.registry import IndexRegistry
from folioframe.sources import epub

TASKS = "id string, book_id string, stage string, status string, completed long, total long, error string, updated_at double"
PROGRESS = "stage string, rows long, warnings long, seconds double, at double"
MANIFEST = "book_id string, index_type string, status string, count long, error string, built_at double, created_at double"


@dataclass(frozen=True)
class Compiled:
    books: DataFrame
    content: DataFrame
    nodes: DataFrame
    mappings: DataFrame
    manifest: DataFrame
    indexes: dict[str, DataFrame]
    tasks: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that were added to a table, with the batch that added them."""
    return spark.read.schema(schema + ", batch string").parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema + ", batch string")


def read_manifest(spark: SparkSession, data_dir: str) -> DataFrame:
    """The last row of each book and index."""
    return tables.latest(_log(spark, f"{data_dir}/manifest", MANIFEST), ["book_id", "index_type"], [F.desc("batch")]).drop("batch")


def read_tasks(spark: SparkSession, data_dir: str) -> DataFrame:
    """The last state of each compile task, one for each batch and stage."""
    return tables.latest(_log(spark, f"{data_dir}/tasks", TASKS), ["id"], [F.desc("updated_at")]).drop("batch")


def read_progress(spark: SparkSession, data_dir: str) -> DataFrame:
    """What compiles have written so far: (batch, stage, rows, warnings, seconds, at) for each table, as soon as it is there.
    rows and warnings are observed while the table is written, not counted by another pass."""
    return _log(spark, f"{data_dir}/progress", PROGRESS)


def read_table(spark: SparkSession, data_dir: str, name: str, schema) -> DataFrame:
    """A table of all compiled books, each as it was compiled last."""
    return tables.read_groups(spark, f"{data_dir}/{name}", schema, spark.read.schema("book_id string, batch string").parquet(f"{data_dir}/batches"))


def compile_epubs(spark: SparkSession, path: str, data_dir: str, index_types: list[str] | None = None, registry: IndexRegistry | None = None) -> Compiled:
    """Compile all EPUB files below a path. Each call adds a batch to the tables, and read_table takes a book's rows
    from its last batch, so compiling a book again replaces it. A file that cannot be read is a failed task with its path
    and error, counted as a warning, and the others go on. read_progress tells the rows of each table while others
    are still to come. A tree that breaks a rule is an error; a failed index is
    in the manifest beside those of earlier books, and its error is raised. The tasks table has each stage's state."""
    registry = registry or IndexRegistry.load()
    providers = registry.default_enabled() if index_types is None else registry.for_types(index_types)
    now = time.time()
    batch = f"{int(now * 1e6):020d}-{uuid.uuid4().hex}"
    done = 0

    def note(stage: str, status: str, error: str = "") -> None:
        row = (f"{batch}/{stage}", None, stage, status, done, 2 + len(providers), error[:500], time.time())
        spark.createDataFrame([row], TASKS).write.mode("append").parquet(f"{data_dir}/tasks/batch={batch}")

    def stored(df: DataFrame, name: str, warns: Column | None = None) -> DataFrame:
        """Write a table of this batch; its rows, and those that warn, are in the progress table when it is there."""
        seen, start = Observation(), time.time()
        watch = lambda rows: rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((F.lit(False) if warns is None else warns).cast("long")), F.lit(0)).alias("warnings"))
        out = tables.write_groups(df, f"{data_dir}/{name}", batch, [c for c in ("token", "book_id") if c in df.columns][:1], watch)
        row = (name, seen.get["rows"], seen.get["warnings"], time.time() - start, time.time())
        spark.createDataFrame([row], PROGRESS).write.mode("append").parquet(f"{data_dir}/progress/batch={batch}")
        return out

    note("parse", "running")
    every = stored(epub.read(spark, path).dropDuplicates(["book_id"]), "parsed", F.col("error") != "")
    parsed = every.filter("error = ''")
    unread = every.filter("error <> ''").select(F.concat(F.lit(f"{batch}/parse/"), "book_id").alias("id"), "book_id", F.lit("parse").alias("stage"), F.lit("failed").alias("status"),
                                                F.lit(0).cast("long").alias("completed"), F.lit(1).cast("long").alias("total"), F.concat_ws(": ", "path", F.substring("error", 1, 400)).alias("error"), F.lit(time.time()).alias("updated_at"))
    unread.write.mode("append").parquet(f"{data_dir}/tasks/batch={batch}")
    tables.write_groups(parsed.select("book_id"), f"{data_dir}/batches", batch)
    done += 1
    note("parse", "done")
    books = parsed.select(F.col("book_id").alias("id"), "title", "author", "language", "publisher", "isbn", "description", F.lit(now).alias("created_at"))
    content = parsed.select("book_id", "text")
    note("tree", "running")
    nodes = stored(tree.build_tree(content), "nodes")
    if (bad := tree.violations(nodes, content).first()) is not None:
        note("tree", "failed", bad.problem)
        raise ValueError(f"book {bad.book_id}: {bad.problem} {bad.id}")
    done += 1
    note("tree", "done")
    built: dict[str, DataFrame] = {}

    def record(changes: DataFrame) -> None:
        """Add the rows of the manifest that the changes make."""
        old = read_manifest(spark, data_dir).join(changes, ["book_id", "index_type"], "left_semi")
        tables.upsert_manifest(old, changes, now).write.mode("append").parquet(f"{data_dir}/manifest/batch={batch}")

    for provider in providers:
        state = lambda status, error="": content.select("book_id", F.lit(provider.name).alias("index_type"), F.lit(status).alias("status"), F.lit(0).cast("long").alias("count"), F.lit(error).alias("error"))  # noqa: B023, E731
        note(provider.name, "running")
        try:
            made = {name: stored(df, name) if "book_id" in df.columns else df for name, df in provider.build(nodes, content, **provider.options).items()}
            counts = next(iter(made.values())).groupBy("book_id").agg(F.count("*").alias("count"))
            record(state("built").drop("count").join(counts, "book_id", "left").na.fill(0, ["count"]))
            built |= made
        except Exception as e:
            record(state("failed", str(e)[:500]))
            note(provider.name, "failed", str(e))
            raise
        done += 1
        note(provider.name, "done")
    return Compiled(books, content, nodes, epub.mappings(parsed), read_manifest(spark, data_dir), built, read_tasks(spark, data_dir))


def remove_index(manifest: DataFrame, index: DataFrame, book_id, index_type: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, index) after a book's index is gone."""
    return tables.set_status(manifest, book_id, index_type, "removed"), index.filter(F.col("book_id") != book_id)


def metrics(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """(book_id, chars, nodes, deepest, warnings) of a compile; a warning is a node without a title or a book without text."""
    per = nodes.groupBy("book_id").agg(F.count("*").alias("nodes"), F.max("level").alias("deepest"), F.sum(((F.col("level") > 0) & (F.trim("title") == "")).cast("long")).alias("_untitled"))
    return content.select("book_id", F.length("text").alias("chars")).join(per, "book_id").select(
        "book_id", "chars", "nodes", "deepest", (F.col("_untitled") + (F.col("chars") == 0).cast("long")).alias("warnings"))
