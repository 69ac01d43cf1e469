"""Token files of directly addressable codes.

Each id is split into 8-bit chunks. Level 0 holds the low chunk of every id, level k the k-th chunk of the ids that
have one. A bitmap for each level says which ids go on, and a rank directory counts its set bits before each block of
512, so the place of an id's next chunk, and with it any id, is found without decoding what lies before.

A file is a Parquet table of short segments, neither compressed nor encoded: its index of pages leads a reader from a
place in the corpus to the page of one segment, and in it the codes lead to the id.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, long_rows, table, width
from folioframe.llm.tokens import AT_A_TIME, encoder

MAGIC, BLOCK = b"FDAC0001", 512
#: A segment is closed at the first document end after this many ids.
SEGMENT_IDS = 1 << 13
#: Bytes of a Parquet page and of a row group, and of the text that one writing task gets.
PAGE, GROUP, TASK = 1 << 16, 1 << 25, 1 << 28
#: Places that may be looked up by a broadcast.
LOOKED_UP = 1 << 16


def write_codes(ids: np.ndarray) -> bytes:
    """The bytes of one segment: magic, id count, level count, then for each level its size, chunks, bitmap and rank
    directory, all little-endian."""
    parts, rest, levels = [], ids.astype(np.uint32), 0
    while len(rest) or not levels:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        steps = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(steps)]).astype("<u4")
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        levels += 1
        rest = rest[more] >> 8
    return b"".join([MAGIC, struct.pack("<QI", len(ids), levels), *parts])


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, count = struct.unpack_from("<QI", data, 8)
        at, self.levels = 20, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            level = []
            for dtype, size in ((np.uint8, n), (np.uint8, (n + 7) // 8), ("<u4", (n + BLOCK - 1) // BLOCK + 1)):
                level.append(np.frombuffer(data, dtype, size, at))
                at += level[-1].nbytes
            self.levels.append(level)

    def _rank(self, level: int, i: int) -> int:
        """Ids before i that go on to the next level."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8:(i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:i - block * BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b, end excluded; reads only their chunks."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if level + 1 < len(self.levels) and b > a:
            more = np.unpackbits(bitmap[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:][:b - a].astype(bool)
            if more.any():
                low = self._rank(level, a)
                out[more] |= self.slice(low, low + int(more.sum()), level + 1) << 8
        return out


SCHEMA = "part int, at long, n long, low long, high long, doc_ids array<bigint>, ends array<bigint>, codes binary"


def write_token_file(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None) -> None:
    """Write the ids of every text and an end id, in ascending doc_id order, as a table of segments.

    The texts are dealt by ranges of doc_id and text and sorted, so a task writes one run of the order (part) in
    segments of about SEGMENT_IDS ids and knows how many ids it wrote before (at); no task sees more than its range at
    a time. n is the number of a segment's ids, low and high are its first and last doc_id, doc_ids and ends index its
    documents. A document lies in one segment.

    Defined cases: null text is empty and has only the end id; null doc_ids come first; rows with equal doc_id are
    in an order of their texts; an empty table gives an empty file; other columns are ignored."""

    def segments(batches):
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        names, ends, data, size, at = [], [], [], 0, 0

        def close():
            ids = np.frombuffer(b"".join(data), enc.dtype)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (at, size, names[0], names[-1])),
                 *(pa.array([x], pa.list_(pa.int64())) for x in (names, ends)), pa.array([write_codes(ids)], pa.binary())],
                names=["part", "at", "n", "low", "high", "doc_ids", "ends", "codes"])

        for batch in batches:
            for k in range(0, batch.num_rows, AT_A_TIME):
                ids, texts = (batch.column(c).slice(k, AT_A_TIME).to_pylist() for c in (0, 1))
                for doc, packed in zip(ids, enc.encode(texts)):
                    data += [packed, end]
                    size += len(packed) // enc.dtype.itemsize + 1
                    names.append(doc)
                    ends.append(size)
                    if size >= SEGMENT_IDS:
                        yield close()
                        at += size
                        names, ends, data, size = [], [], [], 0
        if names:
            yield close()

    long_rows(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ordered = texts.repartitionByRange(max(width(docs.sparkSession), -(-total // TASK)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(segments, SCHEMA).write.options(**{
        "compression": "none", "parquet.page.size": str(PAGE), "parquet.block.size": str(GROUP), "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "64"}).parquet(path)


def part_starts(spark: SparkSession, path: str) -> list[int]:
    """The ids before each part; one number for each writing task."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    totals = {r[0]: r[1] for r in segments.groupBy("part").agg(F.sum("n")).collect()}
    return np.cumsum([0] + [totals.get(part, 0) for part in range(max(totals, default=-1) + 1)]).tolist()


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place of the whole file, counted from 0. The filter reaches the table's index of row groups and pages,
    so of the codes only the page of the segment that holds the place is read; in it only the chunks of the id are."""
    starts = part_starts(spark, path)
    if not 0 <= place < starts[-1]:
        raise IndexError(place)
    part = int(np.searchsorted(starts, place, "right")) - 1
    inside = place - starts[part]
    found = spark.read.schema(SCHEMA).parquet(path).filter(
        (F.col("part") == part) & (F.col("at") <= inside) & (F.col("at") > inside - SEGMENT_IDS) & (F.col("at") + F.col("n") > inside)).select("at", "codes").first()
    if found is None:  # in a document that is longer than a segment
        found = spark.read.schema(SCHEMA).parquet(path).filter((F.col("part") == part) & (F.col("at") <= inside) & (F.col("at") + F.col("n") > inside)).select("at", "codes").first()
    return Codes(bytes(found["codes"]))[inside - found["at"]]


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of wanted(doc_id, i) with token, the i-th id of the document from 0; null where there is none. Of documents
    with equal or no doc_id the first in the file counts.

    The segments' index gives the number of each wanted document without the codes; few wanted rows then go to the
    segments, so that no codes are shuffled, and many are joined with them."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    index = segments.select("part", "at", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("k", "x")).select(
        "part", "at", "k", F.col("x.doc_ids").alias("doc_id"), F.col("x.ends").alias("stop"))
    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("i").cast("long").alias("i"))
    number = keys.limit(LOOKED_UP + 1).count()
    near = keys.select("doc_id").distinct()
    near = F.broadcast(near) if number <= LOOKED_UP else near
    first = index.join(near, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("part", "at", "k", "stop")).alias("s"))
    every = keys.join(first, "doc_id", "left").select("doc_id", "i", "s.part", "s.at", "s.k")
    keys = every.filter("part is not null")
    asked = keys.groupBy("part", "at").agg(F.collect_list(F.struct("doc_id", "i", "k")).alias("asked")) if number <= LOOKED_UP else \
        keys.groupBy("part", "at", F.floor(F.rand(7) * 64).alias("salt")).agg(F.collect_list(F.struct("doc_id", "i", "k")).alias("asked"))

    def look(batches):
        for batch in batches:
            rows: list[list] = [[], [], []]
            for some, ends, codes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                codes = Codes(codes)
                for x in some:
                    low, stop = ends[x["k"] - 1] if x["k"] else 0, ends[x["k"]]
                    ok = x["i"] is not None and 0 <= x["i"] < stop - low
                    for column, value in zip(rows, (x["doc_id"], x["i"], codes[low + x["i"]] if ok else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "i", "token"])

    asked = F.broadcast(asked) if number <= LOOKED_UP else asked
    met = segments.select(F.col("part").alias("p"), F.col("at").alias("a"), "ends", "codes").join(asked, (F.col("p") == F.col("part")) & (F.col("a") == F.col("at")))
    return met.select("asked", "ends", "codes").mapInArrow(look, "doc_id long, i long, token long").unionByName(
        every.filter("part is null").select("doc_id", "i", F.lit(None).cast("long").alias("token")))


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as little-endian unsigned 32-bit integers, and the ids of
    all documents before it. Only the ids of each part are summed on the driver, one number for each writing task."""
    segments, before = spark.read.schema(SCHEMA).parquet(path), part_starts(spark, path)

    def read(batches):
        for batch in batches:
            for part, at, names, ends, codes in zip(*(batch.column(k).to_pylist() for k in range(5))):
                codes, low = Codes(codes), 0
                for k in range(0, len(names), 1024):  # a run of documents at a time
                    stops = np.array(ends[k:k + 1024])
                    starts = np.append(low, stops[:-1])
                    ids = pa.py_buffer(codes.slice(low, int(stops[-1])).astype("<u4").tobytes())
                    cuts = pa.py_buffer(np.append(0, (stops - low) * 4).astype("<i4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[k:k + 1024], pa.int64()), pa.array(starts + before[part] + at), pa.array(stops - starts),
                         pa.Array.from_buffers(pa.binary(), len(stops), [None, cuts, ids])],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    low = int(stops[-1])

    return segments.select("part", "at", "doc_ids", "ends", "codes").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op7_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "codes").path("tokens")
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
