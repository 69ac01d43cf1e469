"""Progress trees, tool-result statistics and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalars import LEVELS, eta, lookup
from folioframe.operators import paths
from folioframe.operators.tables import numbered


def rollup(tasks: DataFrame, now: float) -> DataFrame:
    """tasks(id, parent_id, seq, label, total, completed, auto_total, status, started_at) with depth, path, the totals
    of auto_total parents summed over all below that count themselves, and eta_seconds of running ones. Sorting by
    path is depth-first order. Trees may have any depth: ways up are found in log2(depth) rounds, and sums go up along them.
    A task whose parent is not there stands at the top; tasks on or below a cycle are an error."""
    parents = tasks.select(F.col("id").alias("_known")).distinct()
    up = tasks.join(parents, F.col("parent_id") == F.col("_known"), "left").select("id", F.col("_known").alias("up"), F.lpad(F.col("seq").cast("string"), 9, "0").alias("step"))
    known = paths.reached(up)
    if (bad := known.filter("looped").first()) is not None:
        raise ValueError(f"task {bad.id} is on or below a cycle")
    out = tasks.join(paths.root_paths(up, known), "id").withColumn("depth", F.size(F.split("path", r"\.")) - 1).select(*tasks.columns, "depth", "path")
    parents = tasks.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("_parent", F.lit(True))
    out = out.join(parents, "id", "left").withColumn("_auto", F.col("auto_total") & F.coalesce("_parent", F.lit(False))).drop("_parent")
    steps = F.split("path", r"\.")
    leaves = out.filter("not _auto").select("total", "completed", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))).alias("path"))
    sums = leaves.groupBy("path").agg(F.sum("total").alias("_total"), F.sum("completed").alias("_done"))
    out = out.join(sums, "path", "left")
    pick = lambda own, total: F.when(F.col("_auto"), F.coalesce(F.col(total), F.lit(0.0))).otherwise(F.col(own))
    out = out.withColumn("total", pick("total", "_total")).withColumn("completed", pick("completed", "_done")).drop("_auto", "_total", "_done")
    running = F.col("status") == "running"
    return out.withColumn("eta_seconds", F.when(running, eta(F.col("total"), F.col("completed"), F.lit(now) - F.col("started_at"))))


def percent(total: Column, done: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), 100.0 * done / total)).otherwise(0.0)


def result_stats(results: DataFrame) -> DataFrame:
    """(id, items, edges, max_hop, by_type) of results(id, payload), payload being a JSON list of objects."""
    schema = "array<struct<type:string,hop:int,relationships:array<string>>>"
    rows = results.select("id", F.explode_outer(F.from_json("payload", schema)).alias("x"))
    per = rows.groupBy("id", "x.type").agg(F.count("x").alias("n"), F.sum(F.coalesce(F.size("x.relationships"), F.lit(0))).alias("e"), F.max("x.hop").alias("h"))
    return per.groupBy("id").agg(F.sum("n").alias("items"), F.sum(F.greatest("e", F.lit(0))).alias("edges"), F.max("h").alias("max_hop"),
                                 F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n"))))).alias("by_type"))


def bound_logs(records: DataFrame, at_least: str = "INFO", **bound: str) -> DataFrame:
    """Log records(level, fields) of a level and above, with bound fields that a record's own override."""
    base = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]) if bound else F.create_map().cast("map<string,string>")
    fields = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("fields"), k)), "fields")
    return records.filter(lookup(F.upper("level"), LEVELS, 0) >= LEVELS[at_least]).withColumn("fields", fields)


def batched(rows: DataFrame, order: str, size: int, by: str | None = None) -> DataFrame:
    """rows with the number of their batch of `size` in order, within each group."""
    if by is None:
        return numbered(rows, [order], "_rank").withColumn("batch", F.expr(f"_rank div {size}").cast("int")).drop("_rank")
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def take_while(rows: DataFrame, order: str, condition: Column, by: str) -> DataFrame:
    """Each group's rows up to the first for which the condition does not hold."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_ok", F.min(F.coalesce(condition, F.lit(False)).cast("int")).over(w)).filter("_ok = 1").drop("_ok")


def enumerated(rows: DataFrame, order: str, by: str, start: int = 0) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1 + start)


def joined_deltas(events: DataFrame, by: str = "call_id", order: str = "seq", delta: str = "delta") -> DataFrame:
    """(by, text, n): the deltas of each call in order."""
    return events.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, delta))), lambda x: x[delta]), "").alias("text"), F.count("*").alias("n"))
