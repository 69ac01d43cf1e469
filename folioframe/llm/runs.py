"""Periodic runs of words by the Lyndon arrays of two opposite orders, in the manner of Ellert and Fischer.

A run of period q holds a Lyndon word of length q for one of two opposite orders of the words, and that is the longest
Lyndon word at its place: it ends at the next smaller suffix. So all runs come from the next smaller suffixes of both
orders and from how far each pair of suffixes agrees. Both are found in one pass from left to right with a stack of
previous smaller suffixes. What a match has shown is not compared again: within the furthest match so far, pairs of
suffixes are answered by the pairs that it copies, and along the stack an agreement is carried on from the one before.
No suffix structures and no hashes of stretches are used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folioframe.llm.common import fresh, long_rows, parts, table

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place of s its next smaller suffix and the number of words in which both agree. s[0] and s[-1] stand for
    the ends and are below all other values, which may have any order. Takes time in proportion to len(s)."""
    n = len(s)
    after, agree, before, shared = [0] * n, [0] * n, [0] * n, [0] * n
    first = shift = reach = 0  # s[first:reach] equals what stands `shift` places before it
    for i in range(1, n):
        value, j = s[i], i - 1
        while s[j] > value:  # decided by the first words
            after[j] = i
            j = before[j]
        if s[j] < value or not j:
            before[i] = j
            continue
        length, carried = 1, -1
        while True:
            scan = True
            if i < reach and j >= first:
                length = agree[j - shift] if after[j - shift] == i - shift else shared[i - shift]
                if scan := i + length >= reach:
                    length = reach - i
            elif carried >= 0 and length != carried:
                scan = False
                length = min(length, carried)
            if scan:
                while s[j + length] == s[i + length]:
                    length += 1
                if i + length >= reach:
                    first, shift, reach = i, i - j, i + length
            if s[j + length] < s[i + length]:
                before[i], shared[i] = j, length
                break
            after[j], agree[j], carried = i, length, shared[j]
            j = before[j]
            if not j:
                break
    return after, agree


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` elements and `times` >= 3 periods, in ascending order.

    Elements that are there fewer than `times` times are in no run, so each stretch between them is looked at alone."""
    found = set()
    often = np.bincount(codes)[codes] >= times if len(codes) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(often, prepend=False, append=False))
    for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if high - low < least:
            continue
        part = codes[low:high]
        for s in (part + 1, part.max() + 1 - part):
            s = [0, *s.tolist(), 0]
            after, agree = (np.array(x[1:-1]) for x in next_smaller(s))
            place = np.arange(1, len(after) + 1)
            period = after - place
            rooted = np.flatnonzero((agree > (times - 2) * period) & (agree + 2 * period > least))
            ends = np.stack([after[rooted] + agree[rooted], period[rooted]], 1)
            _, one = np.unique(ends, axis=0, return_index=True)  # of the roots of one run the leftmost
            for i, (end, q) in zip(place[rooted[one]].tolist(), ends[one].tolist()):
                start = i
                while start > 1 and s[start - 1] == s[start - 1 + q]:
                    start -= 1
                if end - start >= max(least, times * q):
                    found.add((low + start - 1, end - start, q))
    return sorted(found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


_NAMES = ("start", "length", "period")
_RUN = pa.struct([(k, pa.int64()) for k in _NAMES])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with the columns `runs`, an array of (start, length, period) in ascending order, and `collapsed`, the words
    outside of repeats joined by single blanks: a word goes if it is in a run and not in that run's first period. The
    names are lengthened by _ where docs has them already. Words are what [^ \\t-\\r]+ matches, numbered from 0.

    Each row is handled alone, where it lies, in time in proportion to its words (and, for the left end of each run, to
    its period); nothing is shuffled.

    Defined cases: null and empty texts, and those of blanks, have no runs and collapse to ''; null in other columns
    does not matter; equal rows have equal results; an empty table gives no rows; other columns pass through."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    long_rows(docs.sparkSession)
    runs, collapsed, text = fresh(docs, "runs"), fresh(docs, "collapsed"), docs.columns.index("text")

    def search(batches):
        for batch in batches:
            for at, n in parts((len(x.as_py() or "") for x in batch.column(text)), rows=64, total=1 << 22):
                part, found, left = batch.slice(at, n), [], []
                for value in part.column(text).to_pylist():
                    words, number = (value or "").encode().split(), {}
                    of = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, times)
                    found.append([dict(zip(_NAMES, r)) for r in of])
                    left.append(b" ".join(words if not of else [words[i] for i in np.flatnonzero(kept_words(len(words), of))]).decode())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(_RUN)), pa.array(left, pa.string())],
                                                 names=[*part.schema.names, runs, collapsed])

    schema = StructType([*docs.schema.fields, StructField(runs, ArrayType(StructType([StructField(k, LongType()) for k in _NAMES]))), StructField(collapsed, StringType())])
    return docs.mapInArrow(search, schema)


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words joined by single blanks, where every tenth document by crc32 of its doc_id goes on
    repeating a stretch of its own from some word on. Null doc_id counts as the text `null`."""
    def edit(batches):
        for batch in batches:
            out = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, h = (value or "").encode().split(), zlib.crc32(b"null" if i is None else str(i).encode())
                g, n = h // 10, len(words)
                if h % 10 == 0 and n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = (words[a:a + p] * (-(-(n - a) // p)))[:n - a]
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(edit, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """One line of figures for each row of find_runs."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    best = F.when(F.size("runs") > 0, best)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_rows(spark)
    return digest(find_runs(plant(table(spark, sf_dir, "documents"))))
