"""Scratch tables, ordering helpers and text hashing that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where it is unset (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="folioframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            pass


class Scratch:
    """Tables of one operator call under the shared folder. What the result still reads stays until the process
    ends; drop() deletes a table as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        _KEPT[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: cuts the lineage at a table that every executor can read."""
        df.write.parquet(self.path(name))
        self.saved.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
            if name in self.saved:
                self.saved.remove(name)

    def close(self) -> None:
        _delete(self.spark, self.root)
        _KEPT.pop(self.root, None)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def long_rows(spark: SparkSession, most: int = 1000) -> None:
    """Send Python at most `most` rows at a time, as rows with whole texts are long, unless the session asks for
    fewer. A session setting, since results are computed after the operator has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until the table has no such column."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """64 bits that stand, with a doc_id, for a row; null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def range_bounds(df: DataFrame, key: str, pieces: int) -> list:
    """Ascending cut points that split the non-null keys into about equal pieces; at most `pieces` values come back."""
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = df.select(F.percentile_approx(key, shares, 20 * pieces)).first()[0]
    return sorted(set(found or []))


def range_piece(key: str, bounds: list) -> Column:
    """Number of bounds below the key, by binary search in the literal bounds; null keys go to piece 0."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    cuts = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 64 else F.expr(
        "array(" + ",".join(f"{int(b)}L" for b in bounds) + ")")
    n, x = len(bounds), F.col(key)

    def search(cut: Column) -> Column:
        at = F.lit(0)
        return F.aggregate(
            F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), at,
            lambda low, step: F.when((low + step <= n) & (F.get(cut, low + step - 1) < x), low + step).otherwise(low))

    return F.coalesce(let(cuts, search), F.lit(0))


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Code points of scripts written without blanks, whose letters are words by themselves: first, last; fixed values.
ALONE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
#: Characters that are turned into arrays at once; bounds memory, not results.
PIECE = 1 << 19
_CUT = re.compile(r"[\s,.;:!?。、，]")
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64)] * 2


@cache
def _kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, mark or digit, 2 if it is a word by itself, else 0."""
    kind = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in ALONE:
        kind[a:b + 1] *= 2
    return kind


class Words:
    """The words of some lower-case texts: whose[i] is the number of the text that word i is in, and start[i] and end[i]
    are its first character and last character + 1 in all texts. A stretch's hash is the difference of two running
    sums, scaled back."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[codes]
        start, end = (kind[1:-1] == 2) | ((kind[1:-1] == 1) & (kind[:-2] != 1)), (kind[1:-1] == 2) | ((kind[1:-1] == 1) & (kind[2:] != 1))
        self.start, self.end = np.flatnonzero(start) + 1, np.flatnonzero(end) + 2
        self.whose = np.searchsorted(np.cumsum([1 + len(t) for t in texts]), self.start, "right")
        if len(_POWERS[0]) < len(codes):
            _POWERS[:] = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes) + len(codes) // 4, b)])) for b in (_BASE, _INVERSE))
        self.run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * _POWERS[0][:len(codes)], out=self.run[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix64((self.run[end] - self.run[start]) * _POWERS[1][start] + np.uint64(salt))


def grouped_words(texts: list[str]) -> Iterator[tuple[np.ndarray, Words]]:
    """The words of the texts, some at a time, with the number of the text that each of those is, or is a part of."""
    group, whose, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text.lower(), 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (m := _CUT.search(text, at + PIECE)):
                end = m.end()
            if group and size + end - at > PIECE:
                yield np.array(whose), Words(group)
                group, whose, size = [], [], 0
            group.append(text[at:end])
            whose.append(i)
            size, at = size + end - at, end
    if group:
        yield np.array(whose), Words(group)


def parts(sizes: Iterable[int], rows: int = 256, total: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that have at most `rows` rows and, but for single ones, a total of at most `total`."""
    first = n = held = 0
    for size in sizes:
        if n and (n == rows or held + (size or 0) > total):
            yield first, n
            first, n, held = first + n, 0, 0
        n, held = n + 1, held + (size or 0)
    if n:
        yield first, n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
