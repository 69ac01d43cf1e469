"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a copy probability. Two fractional ones at a time exchange mass at random until one is integral;
what is left of each block of documents meets in a reduction tree, so a source's words end within one document of
its target.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, fresh, table, text_key, width

#: Weights of the sources in code point order, repeated as often as needed; fixed values.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Documents in a leaf of the tree, and residuals in an inner node; both bound a task's rows.
LEAF, FAN = 4096, 64
#: Documents in a leaf in the registered query.
QUERY_LEAF = 32
#: Bytes of source targets that may be broadcast; more are joined by a salted shuffle.
BROADCAST, SALTS = 16 << 20, 32
#: Decisions of two long integers that may be broadcast to the rows.
BROADCAST_ROWS = 1 << 19
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def size_of(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target) for sizes(source, size).

    A source's number in the order decides its weight; it is its row in a range partition plus the rows of the
    partitions before, so no task sorts all sources. Targets rise together with their weights until they reach cap
    times the source's size: each round is one sum over the sources that are not there yet."""
    stats = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    stats = scratch.save(stats.repartitionByRange(width(sizes.sparkSession), order).sortWithinPartitions(order).withColumn(
        "row", F.monotonically_increasing_id()), "sources")
    ends = stats.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n")).sort("part").collect()
    before, run = {}, 0
    for part, n in ends:  # one row for each partition
        before[part] = run
        run += n
    first = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(max(before, default=0) + 1)]), F.shiftright("row", 33).cast("int"))
    number = (first + F.col("row").bitwiseAND((1 << 33) - 1)) % len(WEIGHTS)
    stats = stats.withColumn("weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), number.cast("int")).cast("long"))
    total = stats.agg(F.sum("source_size")).first()[0] or 0
    level, left = 0.0, -1
    while True:
        free = F.col("weight") * level < cap * F.col("source_size")
        weight, full, count = stats.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("source_size"))), F.count(F.when(free, 1))).first()
        if not weight or count == left:
            break
        level, left = (share * total - cap * (full or 0)) / weight, count
    return stats.select("source", "n", "source_size", F.least(F.lit(float(level)) * F.col("weight"), cap * F.col("source_size")).alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p with at most one fractional value left, keeping sum(sizes * p) and each expectation.

    The held document and the next one exchange words: up moves the most it can to the held one, down the most to
    the other, each with the probability that keeps both expectations."""
    p, held = p.copy(), -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        step = up if rng.random() * (up + down) < down else -down
        x, y = p[held] + step / a, p[i] - step / b
        p[held], p[i] = (min(max(round(v, 0) if abs(v - round(v)) < 1e-12 else v, 0.0), 1.0) for v in (x, y))
        loose = [k for k in (held, i) if 0 < p[k] < 1]
        held = loose[0] if loose else -1
    return p


def take(docs: DataFrame, share: float = SHARE, cap: float = CAP, seed: int = SEED, leaf: int | None = None) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies): how often the mix takes each row; text_key is a hash of
    its text.

    target / size of its source is a row's expected copies: the whole part is taken, the fraction is rounded by the
    tree. Leaves, of about `leaf` documents (LEAF by default), are blocks of a source by a hash of doc_id and text, so a source with a third of all rows is many leaves. The
    last fraction of a source goes to the nearer integer.

    Defined cases: null text has size 0; a row of size 0 has the whole part of its copies; null source is a source of
    its own, last in order; rows with equal or null doc_id are decided one by one; an empty table gives no rows; other
    columns are ignored. Random numbers follow from seed, source and block: reruns agree."""
    spark, leaf = docs.sparkSession, leaf or LEAF
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "source", size_of().alias("size")), "sizes")
    targets = source_targets(sizes, scratch, share, cap)
    targets = scratch.save(targets, "targets")
    number, held, most = targets.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.max("n")).first()
    joined = targets.withColumnRenamed("source", "of")
    on = F.col("source").eqNullSafe(F.col("of"))
    if (held or 0) <= BROADCAST:
        rows = sizes.join(F.broadcast(joined), on)
    else:
        rows = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS))).join(
            joined.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col("salt") == F.col("slot")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("f", copies).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.floor("f").cast("double").alias("base"), (F.col("f") - F.floor("f")).alias("p"),
        F.pmod(F.xxhash64("doc_id", "text_key"), F.greatest(F.lit(1), F.ceil(F.col("n") / leaf)).cast("long")).alias("block"))
    schema = rows.schema

    def node(level: int, root: bool):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["size", "doc_id", "text_key", "p"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            p = np.where(rows["size"] > 0, rows["p"], 0.0)
            rng = np.random.default_rng(zlib.crc32(repr((seed, level, key[0], int(key[1]))).encode()))
            p = pivot(rows["size"].to_numpy(float), p, rng)
            rows["p"] = np.rint(p) if root else p
            return rows
        return run

    whole = F.col("p").isin(0.0, 1.0)
    out, level, blocks = None, 0, -(-(most or 1) // leaf)
    while True:
        root = blocks == 1
        done = scratch.save(rows.groupBy("source", "block").applyInPandas(node(level, root), schema), f"level{level}")
        out = done.filter(whole) if out is None else out.unionByName(done.filter(whole))
        if root:
            break
        rows = done.filter(~whole).withColumn("block", F.expr(f"block div {FAN}"))
        level, blocks = level + 1, -(-blocks // FAN)
    scratch.drop("sizes")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows with equal doc_id and text are matched in order of
    source. Defined cases are those of take()."""
    words, row, nth, copies, of = (fresh(docs, n) for n in ("_words", "_row", "_nth", "_copies", "_of"))
    taken = take(docs, share, cap, seed)
    count, distinct = taken.agg(F.count("*"), F.count_distinct("doc_id")).first()
    kept = taken.select(F.col("doc_id").alias(of), F.col("copies").alias(copies))
    if count == distinct:  # every row has a doc_id of its own, so the texts need not be sorted to tell rows apart
        kept = F.broadcast(kept) if count <= BROADCAST_ROWS else kept
        met = docs.join(kept, F.col("doc_id") == F.col(of))
    else:
        number = "row_number() over (partition by doc_id, {0} order by source)"
        key = fresh(docs, "_key")
        kept = taken.select(F.col("doc_id").alias(of), F.col("text_key").alias(key), F.col("copies").alias(copies), F.expr(number.format("text_key")).alias(nth))
        rows = docs.withColumn(words, text_key()).withColumn(row, F.expr(number.format(words)))
        met = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(words) == F.col(key)) & (F.col(row) == F.col(nth)))
    each = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies))).otherwise(F.array().cast("array<bigint>")))
    return met.withColumn(nth, each).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With leaves so small that the sources of every table have several."""
    return take(table(spark, sf_dir, "documents"), leaf=QUERY_LEAF).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
