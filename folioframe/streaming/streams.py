"""Streams: transformations, batches, rolling limits and delta concatenation in Structured Streaming."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """A folder of files as an unbounded table."""
    return spark.readStream.schema(schema).format(kind).load(path)


def tap(df: DataFrame, name: str) -> DataFrame:
    """The same rows, with their number in the query's progress events."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def for_each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Run action on each micro-batch of what is available, then stop."""
    return df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream of the files that are there now produces, as the table at `path`, a folder that all executors see.
    Each batch is a folder of its own, written anew if it is repeated; of a complete result the last one counts."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")


def windowed_usage(log: DataFrame, window: str = "5 hours", slide: str = "1 hour", late: str = "1 hour", by: str = "mode") -> DataFrame:
    """Requests and tokens in sliding event-time windows; rows later than `late` are not waited for."""
    used = F.when(F.col("actual_in").isNull(), F.col("estimated")).otherwise(F.coalesce("actual_in", F.lit(0)) + F.coalesce("actual_out", F.lit(0)))
    return log.withWatermark("ts", late).groupBy(F.window("ts", window, slide), by).agg(F.count("*").alias("requests"), F.sum(used).alias("tokens")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "requests", "tokens")


def rolling_limit(log: DataFrame, seconds: int, limit: int, by: str = "mode") -> DataFrame:
    """(by, id, ts, tokens, allowed): each request in order of time within a batch, against the tokens that allowed
    requests used in the seconds before. The state of a key is the allowed requests that still count."""

    def step(key, batches, state: GroupState):
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples():
            held = [(t, n) for t, n in held if t >= r.ts - seconds]
            allowed = limit == 0 or sum(n for _, n in held) + r.tokens <= limit
            if allowed:
                held.append((float(r.ts), int(r.tokens)))
            out.append((key[0], int(r.id), float(r.ts), int(r.tokens), allowed))
        state.update(([t for t, _ in held], [n for _, n in held]))
        yield pd.DataFrame(out, columns=[by, "id", "ts", "tokens", "allowed"])

    rows = log.select(by, F.col("id").cast("long"), F.col("ts").cast("double"), F.col("tokens").cast("long"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} string, id long, ts double, tokens long, allowed boolean", "ts array<double>, tokens array<long>",
                                                   "append", GroupStateTimeout.NoTimeout)


def concat_deltas(events: DataFrame, by: str = "call_id") -> DataFrame:
    """The text of each call so far, its deltas in order of seq; for output mode complete or update."""
    return events.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"), F.count("*").alias("n"))
