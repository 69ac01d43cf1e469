"""Phrase collocations: merged count-min sketches find what may be frequent, a second pass counts exactly that.

Every task counts the hashes of all stretches of one to five words in a count-min sketch of its own; the sketches are
merged cell by cell, and a stretch whose cells all reach the least count may be frequent. A sketch never counts too
little, so nothing frequent is lost. The second pass counts the stretches that may be frequent, and all of whose parts
may be, by their words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.bytewords import byte_words, kinds
from folioframe.llm.common import Scratch, long_rows, mix64, parts, table

LONGEST, LEAST, BEST = 5, 100, 2000
#: Rows of a sketch, cells of a block, the fewest and most cells of a row, and the bytes of text for which a row has one
#: cell, which then counts some 40 stretches. With the most cells, for 3 GB of text and more, the merged marks take 16 MB;
#: larger corpora fill more cells, so the second pass counts more stretches exactly, and none fewer.
DEPTH, CELLS, FEWEST, MOST, BYTES_A_CELL = 2, 1 << 16, 1 << 16, 1 << 26, 48
#: Different phrases that a task counts before it hands them on; bounds memory, not results.
HELD = 1 << 19

_WORDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def _grams(batches):
    """(langs, number of the language of each word, words, usable, hash) of some texts: usable[k - 1][i] says whether k words
    from word i on stand in one piece, and hash[k - 1][i] is their hash with their language."""
    for batch in batches:
        for at, n in parts((len(x.as_py() or "") for x in batch.column(1)), rows=4096, total=1 << 20):
            lang = batch.column(0).slice(at, n).to_pylist()
            for first, count, words in byte_words(batch.column(1).slice(at, n).to_pylist(), _WORDS):
                names = {x: i for i, x in enumerate(dict.fromkeys(lang[first:first + count]))}
                of = np.array([names[x] for x in lang[first:first + count]])[words.whose]
                salt = mix64(np.array([zlib.crc32(x.encode()) for x in names], np.uint64))
                usable, hashed = [np.ones(len(of), bool)], [words.hash ^ salt[of]]
                for k in range(1, LONGEST):
                    ok = np.zeros(len(of), bool)
                    ok[:len(of) - k] = words.piece[k:] == words.piece[:len(of) - k]
                    h = hashed[-1] * _GRAM
                    h[:len(of) - k] += words.hash[k:]
                    usable.append(ok)
                    hashed.append(mix64(h))
                yield list(names), of, words, usable, hashed


def _cells(hashed: np.ndarray, cells: int, row: int) -> np.ndarray:
    return ((mix64(hashed ^ np.uint64(row + 1)) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def sketched(texts: DataFrame, cells: int, least: int) -> DataFrame:
    """(row, block, marks) of the merged sketch of texts(lang, text): a bit for each cell whose count is at least `least`."""
    def count(batches):
        sketch = np.zeros((DEPTH, cells), np.uint8)  # counts above `least` say no more than `least`
        for _, _, _, usable, hashed in _grams(batches):
            for ok, h in zip(usable, hashed):
                for d, row in enumerate(sketch):
                    at, n = np.unique(_cells(h[ok], cells, d), return_counts=True)
                    row[at] = np.minimum(row[at] + np.minimum(n, least), least)
        for d, row in enumerate(sketch):
            for b in range(0, cells, CELLS):
                if (some := row[b:b + CELLS]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b // CELLS], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["row", "block", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(2).to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["row", "block", "marks"])

    return texts.mapInArrow(count, "row int, block int, counts binary").groupBy("row", "block").applyInArrow(merge, "row int, block int, marks binary")


class _Held:
    """Counts of a task's phrases, told apart by their 64-bit hashes."""

    def __init__(self):
        self.hash, self.slot, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[tuple[str, str]] = []

    def add(self, hashed: np.ndarray, name) -> None:
        """Count the hashes; name(i) is the language and phrase of the i-th."""
        value, first, number = np.unique(hashed, return_index=True, return_counts=True)
        at = np.searchsorted(self.hash, value)
        old = at < len(self.hash)
        old[old] = self.hash[at[old]] == value[old]
        self.count[self.slot[at[old]]] += number[old]
        new = ~old
        if new.any():
            slot = np.arange(len(self.names), len(self.names) + int(new.sum()))
            self.names += [name(i) for i in first[new].tolist()]
            self.count = np.concatenate([self.count, number[new]])
            every, slots = np.concatenate([self.hash, value[new]]), np.concatenate([self.slot, slot])
            order = np.argsort(every, kind="stable")
            self.hash, self.slot = every[order], slots[order]

    def rows(self) -> pa.RecordBatch:
        lang, phrase = zip(*self.names) if self.names else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(self.count, pa.int64())], names=["lang", "phrase", "f"])


def counted(texts: DataFrame, marks: np.ndarray, cells: int) -> DataFrame:
    """(lang, phrase, f) of the stretches that may be frequent by the marked cells, and (lang, null, number of all words)."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def count(batches):
        marks, words_of, held = shared.value, Counter(), _Held()
        for names, of, words, usable, hashed in _grams(batches):
            for i, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                words_of[names[i]] += n
            before = None
            for k, (ok, h) in enumerate(zip(usable, hashed)):
                if before is not None:  # both parts that are one word shorter may be frequent
                    ok = ok & before
                    ok[:-1] &= before[1:]
                at = np.flatnonzero(ok)
                for d in range(DEPTH):
                    cell = _cells(h[at], cells, d)
                    at = at[marks[d][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 > 0]
                before = np.zeros(len(ok), bool)
                before[at] = True
                held.add(h[at], lambda i: (names[of[at[i]]], words.text(at[i], at[i] + k)))  # noqa: B023
            if len(held.names) > HELD:
                yield held.rows()
                held = _Held()
        yield held.rows()
        langs = list(words_of)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array([words_of[x] for x in langs], pa.int64())], names=["lang", "phrase", "f"])

    few = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)  # a task adds up more before it hands on
    return few.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(lang, phrase, f): exactly the phrases of one to five words that are there at least `least` times in a language,
    and (lang, null, number of all its words)."""
    spark = docs.sparkSession
    if not 0 < least < 256:
        raise ValueError("least must be from 1 to 255, as a cell of a task's sketch is a byte")
    scratch = scratch or Scratch(spark, "phrases")
    long_rows(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST, max(FEWEST, -(-size // (BYTES_A_CELL * CELLS)) * CELLS))
    merged = scratch.save(sketched(texts.coalesce(spark.sparkContext.defaultParallelism), cells, least), "sketch")  # a sketch for each core
    marks = np.zeros((DEPTH, cells // 8), np.uint8)
    for r in merged.toLocalIterator():  # DEPTH * cells bits, at most 16 MB
        marks[r.row, r.block * CELLS // 8:][:CELLS // 8] = np.frombuffer(r.marks, np.uint8)
    found = scratch.save(counted(texts, marks, cells).filter(F.col("phrase").isNull() | (F.col("f") >= least)), "counts")
    scratch.drop("sketch")
    return found


def collocations(docs: DataFrame, least: int = LEAST, best: int | None = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the phrases of two to five words that are there a >= least
    times, best first (all, if best is None). n is the number of the language's words; of all cuts of the phrase in two
    parts, there l and r times, the one of the lowest score floor(1000 * a * n / (l * r)) counts, of equal ones the
    first. A phrase that a longer one with the same count holds is left out.

    A part is there as often as its phrase at least, so all counts that are needed are those of frequent phrases. If a
    longer phrase holds one with the same count, so does one that is longer by one word: the stretches between them have
    that count too.

    Defined cases: null lang is `und`; null and empty texts have no words; a language without such a phrase has no rows;
    ties in score go by a, then by the bytes of the phrase; repeated rows count each time; an empty table gives no rows;
    other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    found = frequent(docs, least, scratch)
    words = F.split("phrase", " ")
    total = found.filter("phrase is null").select("lang", F.col("f").alias("n"))  # a row for each language
    known = found.filter("phrase is not null")
    longer = known.filter(F.instr("phrase", " ") > 0).withColumn("w", words)
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (wide("a") * 1000) * wide("n")).withColumn("score", F.expr("above div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    inner = longer.filter(F.size("w") > 2).select("lang", "f", F.explode(F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1))).alias("w"))
    inner = inner.select("lang", F.array_join("w", " ").alias("phrase"), F.col("f").alias("a")).distinct()
    ranked = scored.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if best is not None:  # first among shares of a language, so that none is sorted in one task
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= best).drop("rank")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if best is None else ranked.filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
totals as (select lang, sum(len(w))::bigint n from words group by lang),
starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from words, range(1, 6) t(k) where len(w) >= k),
counts as (select lang, array_to_string(w[i:i + k - 1], ' ') phrase, k m, count(*) f from starts group by all having count(*) >= 100),
cuts as (select c.lang, c.phrase, c.m, c.f a, l.f l, r.f r, n, k, ((1000::hugeint * c.f * n) // (l.f::hugeint * r.f))::bigint score
  from counts c, range(1, 5) t(k), counts l, counts r, totals
  where c.m > k and l.lang = c.lang and r.lang = c.lang and totals.lang = c.lang
    and l.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ') and r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) nth from cuts),
ranked as (select lang, phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from lowest x where nth = 1
  and not exists (select 1 from counts y where y.lang = x.lang and y.m > x.m and y.f >= x.a and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""
