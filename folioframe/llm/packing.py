"""Packing by non-negative least squares over length combinations.

Every text is cut into full windows and a remainder. Shallow combinations of remainder lengths that fill a window are
enumerated, their repeat counts solved against the histogram of remainders and rounded, and what is left over is
packed greedily.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, long_rows, table
from folioframe.llm.tokens import AT_A_TIME, encoder

WINDOW = 1024
STEPS = 400


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three ascending lengths, 0 for none, that occur and fill the window together."""
    here = np.flatnonzero(counts[:window])
    here = here[here > 0]
    has = np.zeros(window + 1, bool)
    has[here] = True
    low = here[here <= window // 2]
    low = low[has[window - low]]
    pairs = np.stack([np.zeros_like(low), low, window - low], 1) if len(low) else np.zeros((0, 3), np.int64)
    a, b = (g.ravel() for g in np.meshgrid(here, here, indexing="ij"))
    c = window - a - b
    keep = (a <= b) & (b <= c)
    a, b, c = a[keep], b[keep], c[keep]
    keep = has[c]
    return np.concatenate([pairs, np.stack([a[keep], b[keep], c[keep]], 1)])


def nonnegative_least_squares(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, by accelerated projected gradient steps; column k of A counts the lengths
    of combos[k]. The step is 1 / (largest row sum times largest column sum), a bound on the curvature."""
    n = len(counts)
    real = np.where(combos > 0, combos, n)
    wide = np.append(counts.astype(float), 0.0)
    use = np.bincount(real.ravel(), minlength=n + 1)
    curve = 3.0 * max(1, use[:n].max(initial=1))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        residual = np.bincount(real.ravel(), np.repeat(y, 3), minlength=n + 1) - wide
        residual[n] = 0
        new = np.maximum(0, y - residual[real].sum(1) / curve)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """([(lengths of a sequence, repeats)], remainders left over) for counts[length], length < window.

    Repeat counts are rounded, largest first, and held to what is left of each length; then each length, longest
    first, takes the exact complements that remain. Works on the histogram, so its size is the window's, not the
    corpus's."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for length in set(lengths):
            times = min(times, int(left[length]) // lengths.count(length))
        if times > 0:
            for length in lengths:
                left[length] -= times
            out.append((lengths, times))

    combos = combinations(left, window)
    if len(combos):
        x = np.rint(nonnegative_least_squares(combos, left)).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] <= 0:
                break
            take(tuple(int(v) for v in combos[k] if v), int(x[k]))
    for a in range(window - 1, 0, -1):
        while left[a] > 0:
            before = len(out)
            if window - a < window and left[window - a] > 0:
                take((a, window - a), int(left[a]))
            if len(out) == before and left[a] > 0:
                b = np.arange(1, (window - a) // 2 + 1)
                fit = b[(left[b] > 0) & (left[window - a - b] > 0)]
                for low in fit[:8]:
                    take((a, int(low), window - a - int(low)), int(left[a]))
            if len(out) == before:
                break
    return out, left


class Layout:
    """Where the remainder of a given length and rank lies: rank r of a length is the r-th place planned for it."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        planned, left = plan(counts, window)
        self.window = window
        ranges: dict[int, list[tuple[int, int, int, int, int]]] = {}
        used = np.zeros(window, np.int64)
        self.sequences = 0
        for lengths, times in planned:
            for length in dict.fromkeys(lengths):
                m, first = lengths.count(length), sum(lengths[:lengths.index(length)])
                ranges.setdefault(length, []).append((int(used[length]), m, self.sequences, first, 0))
                used[length] += m * times
            self.sequences += times
        #: What is left over is laid end to end, longest first, and cut at the windows.
        self.tail_base, run = self.sequences, 0
        for length in range(window - 1, 0, -1):
            if left[length]:
                ranges.setdefault(length, []).append((int(used[length]), 0, run, 0, 1))
                run += int(left[length]) * length
        self.tail = run
        full, rest = divmod(run, window)
        #: The last, partial window is cut into powers of two, which need no padding.
        self.ends = [full * window]
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                self.ends.append(self.ends[-1] + (1 << bit))
        self.sequences += full + len(self.ends) - 1
        self.ranges = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """[(sequence, offset, tokens)] of the pieces of a remainder, in order."""
        own = self.ranges[length]
        low, m, base, first, greedy = own[np.searchsorted(own[:, 0], rank, "right") - 1].tolist()
        rank -= low
        if not greedy:
            return [(base + rank // m, first + rank % m * length, length)]
        at, out = base + rank * length, []
        stop = at + length
        while at < stop:
            if at < self.ends[0]:
                k, start = at // self.window, at // self.window * self.window
                end = start + self.window
            else:
                i = int(np.searchsorted(self.ends, at, "right")) - 1
                k, start, end = self.ends[0] // self.window + i, self.ends[i], self.ends[i + 1]
            n = min(stop, end) - at
            out.append((self.tail_base + k, at - start, n))
            at += n
        return out


#: Bytes of placement tables that may be broadcast; larger ones are joined by a shuffle.
BROADCAST = 16 << 20


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces that fill sequences of `window` ids.

    ids are little-endian unsigned 32-bit integers; start counts the document's ids before the piece. A document is
    its text's ids and end_id. Full windows of a document are sequences of their own; remainders are placed by the
    solved combinations. Ranks come from counters that each scanning task keeps and sums over tasks, so no task or
    driver gathers the documents of a length, however many share it. No sequence needs padding: all are full but
    the last few, which are powers of two.

    Defined cases: null text is empty and has only the end id; rows with equal or null doc_id are packed one by one;
    an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    long_rows(spark)

    def tokenize(batches):
        from pyspark import TaskContext

        enc, block = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                ids, texts = (batch.column(c).slice(k, AT_A_TIME).to_pylist() for c in (0, 1))
                data = [b + end for b in enc.encode(texts)]
                ranks, fulls, sizes = [], [], []
                for b in data:
                    n = len(b) // enc.dtype.itemsize
                    sizes.append(n)
                    ranks.append(int(seen[n % window]))
                    fulls.append(full)
                    seen[n % window] += 1
                    full += n // window
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(data), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()),
                     pa.array(data, pa.binary())],
                    names=["block", "doc_id", "n", "nth", "fulls", "packed"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "block int, doc_id long, n long, nth long, fulls long, packed binary"
    texts.mapInArrow(tokenize, schema).write.option("compression", "zstd").parquet(scratch.path("ids"))
    ids = spark.read.schema(schema).parquet(scratch.path("ids"))

    by_length = scratch.save(ids.groupBy("block", (F.col("n") % window).cast("int").alias("length")).agg(
        F.count("*").alias("count"), F.sum(F.expr(f"n div {window}")).alias("full")), "lengths")
    counts = np.zeros(window, np.int64)
    for length, count in by_length.groupBy("length").agg(F.sum("count")).collect():  # at most `window` rows
        counts[length] = count
    counts[0] = 0
    layout = Layout(counts, window)
    base = layout.sequences
    ordered = "order by block rows between unbounded preceding and 1 preceding"
    blocks = by_length.groupBy("block").agg(F.sum("full").alias("full")).withColumn(
        "before", F.coalesce(F.expr(f"sum(full) over ({ordered})"), F.lit(0)))
    offsets = by_length.withColumn("low", F.coalesce(
        F.expr(f"sum(count) over (partition by length {ordered})"), F.lit(0))).groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("length", "low"))).alias("lows"))  # at most `window` entries
    where = scratch.save(blocks.join(offsets, "block").select(F.col("block").alias("of"), "before", "lows"), "blocks")
    scratch.drop("lengths")
    if where.count() * window * 16 <= BROADCAST:
        where = F.broadcast(where)
    wide = "u2" if encoder(vocabulary).dtype.itemsize == 2 else "u4"

    def pieces(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(k, AT_A_TIME)
                doc, n, rank, full, packed = (part.column(c).to_pylist() for c in range(5))
                rows = []
                for i in range(len(doc)):
                    data, at = np.frombuffer(packed[i], "<" + wide).astype("<u4"), 0
                    cut = [(base + full[i] + j, 0, window) for j in range(n[i] // window)]
                    if n[i] % window:
                        cut += layout.place(n[i] % window, rank[i])
                    for sequence, offset, length in cut:
                        rows.append((doc[i], at, length, n[i], sequence, offset, data[at:at + length].tobytes()))
                        at += length
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())],
                                                 names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    #: A row takes two numbers from its block's table inside the JVM; the table itself goes to no row.
    joined = ids.join(where, F.col("block") == F.col("of")).select(
        "doc_id", "n", (F.element_at("lows", (F.col("n") % window).cast("int")) + F.col("nth")).alias("rank"), (F.col("before") + F.col("fulls")).alias("full"), "packed")
    return joined.mapInArrow(
        pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
