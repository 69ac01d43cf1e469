"""Rolling usage limits over a log usage(ts, mode, estimated, actual_in, actual_out); ts in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.tables import last_of

#: Window names and their seconds; fixed values.
WINDOWS = {"5h": 5 * 3600, "7d": 7 * 86400, "30d": 30 * 86400}


def used_tokens() -> Column:
    """Actual tokens where they are known, else the estimate."""
    return F.when(F.col("actual_in").isNull(), F.coalesce("estimated", F.lit(0))).otherwise(F.coalesce("actual_in", F.lit(0)) + F.coalesce("actual_out", F.lit(0)))


def usage_by_window(log: DataFrame, now: float) -> DataFrame:
    """(requests_<w>, tokens_<w>) for every window that ends at now, from one scan; the lower bound belongs to it."""
    longest = max(WINDOWS.values())
    inside = {w: F.col("ts") >= now - s for w, s in WINDOWS.items()}
    columns = [c for w in WINDOWS for c in (F.count(F.when(inside[w], 1)).alias(f"requests_{w}"), F.coalesce(F.sum(F.when(inside[w], used_tokens())), F.lit(0)).alias(f"tokens_{w}"))]
    return log.filter(F.col("ts") >= now - longest).agg(*columns)


def check_allowed(log: DataFrame, mode: str, limits: dict[str, int], estimate: int, now: float) -> tuple[bool, str]:
    """Whether a request fits all limits and, if not, the first window it does not fit; a limit of 0 is none."""
    if mode == "off":
        return True, ""
    row = usage_by_window(log, now).first()
    for w in WINDOWS:
        limit = limits.get(w, 0)
        full = row[f"requests_{w}"] >= limit if mode == "requests" else row[f"tokens_{w}"] + estimate > limit
        if limit and full:
            return False, w
    return True, ""


def rolling(log: DataFrame, window: str, by: list[str], bucket: float = 60.0) -> DataFrame:
    """log with the requests and tokens of the window that ends at each row, rows of the same time included.

    What a window holds is what had come up to its row, less what had come before its start: each row is put at both
    times, and one running sum serves both. The sum runs within buckets of time, onto the totals of those before, which
    are one row for each bucket: a key with a long history is many tasks."""
    seconds = WINDOWS[window]
    row = log.withColumn("_used", used_tokens()).withColumn("_id", F.monotonically_increasing_id()).withColumn("_row", F.struct(*log.columns))
    ends = row.select(*by, "_id", "_row", "_used", F.explode(F.array(
        F.struct(F.col("ts").alias("at"), F.lit(1).alias("own")), F.struct((F.col("ts") - seconds).alias("at"), F.lit(0).alias("own")))).alias("_e"))
    ends = ends.withColumn("_bucket", F.floor(F.col("_e.at") / bucket))
    own = F.col("_e.own")
    counted, used = own.cast("long"), own * F.col("_used")
    totals = ends.groupBy(*by, "_bucket").agg(F.sum(counted).alias("_n"), F.sum(used).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"))
    frame = Window.partitionBy(*by, "_bucket").orderBy("_e.at", "_e.own").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = ends.withColumn("_n", F.sum(counted).over(frame)).withColumn("_t", F.sum(used).over(frame))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    run = run.join(before, [*same, F.col("_bucket").eqNullSafe(F.col("_of"))])
    sign = F.when(own == 1, 1).otherwise(-1)
    both = run.groupBy("_id").agg(F.first(F.when(own == 1, F.col("_row")), ignorenulls=True).alias("_row"), F.sum(sign * (F.col("_n0") + F.col("_n"))).alias("requests"),
                                  F.sum(sign * (F.col("_t0") + F.coalesce("_t", F.lit(0)))).alias("tokens"))
    return both.select("_row.*", "requests", "tokens")


def violations(log: DataFrame, window: str, by: list[str], mode: str, limit: int) -> DataFrame:
    """The rows that a limit would have blocked, if every row before had been let through."""
    rows = rolling(log, window, by)
    over = F.col("requests") - 1 >= limit if mode == "requests" else F.col("tokens") > limit
    return rows.filter(over) if limit else rows.limit(0)


def record(log: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    return log if mode == "off" else log.unionByName(rows)


def record_actual(log: DataFrame, actual: DataFrame) -> DataFrame:
    """log with the actual tokens of actual(id, actual_in, actual_out), of several for one id the last in the batch."""
    new = last_of(actual, ["id"]).select("id", F.col("actual_in").alias("_in"), F.col("actual_out").alias("_out")).filter("id <> 0")
    return log.join(new, "id", "left").withColumn("actual_in", F.coalesce("_in", "actual_in")).withColumn("actual_out", F.coalesce("_out", "actual_out")).drop("_in", "_out").select(*log.columns)
