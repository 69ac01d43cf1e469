"""Table functions for SQL: cutting texts and folding ordered rows, called with TABLE arguments.

    select * from chunk_text(table(select doc_id, text from documents), 500, 50)
    select * from heading_levels(table(select book_id, line_offset, raw_level from scan) partition by book_id order by line_offset)

The first column of a text function's table is its key, and `text` its text; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from folioframe.operators import text, tree

_SPAN = [("chunk_index", T.IntegerType()), ("content_offset", T.LongType()), ("content_length", T.LongType()), ("chunk_text", T.StringType())]
_HEADING = [("line_offset", T.LongType()), ("raw_level", T.IntegerType()), ("title", T.StringType()), ("level", T.IntegerType())]


def _schema(rows: AnalyzeArgument, fields: list[tuple[str, T.DataType]]) -> AnalyzeResult:
    if not rows.isTable or not isinstance(rows.dataType, T.StructType) or "text" not in rows.dataType.names or rows.dataType.names[0] == "text":
        raise ValueError("the first argument must be a table with a key as its first column and a column text")
    key = rows.dataType.fields[0]
    return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), *(T.StructField(n, t) for n, t in fields)]))


def _whole(name: str, argument: AnalyzeArgument, least: int) -> None:
    if argument.value is not None and (not isinstance(argument.value, int) or argument.value < least):
        raise ValueError(f"{name} must be a whole number of at least {least}")


def _spans(row, cut: Callable[[str], Iterator[tuple[int, int]]]) -> Iterator[tuple]:
    body = row["text"] or ""
    for i, (a, b) in enumerate(cut(body)):
        yield row[0], i, a, b - a, body[a:b]


class ChunkText:
    """Chunks of about `budget` tokens with an overlap, as the chunk index has them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        for name, argument, least in (("budget", budget, 1), ("overlap", overlap, 0)):
            if argument is not None:
                _whole(name, argument, least)
        return _schema(rows, _SPAN)

    def eval(self, row: T.Row, budget: int = text.CHUNK_TOKENS, overlap: int = text.CHUNK_OVERLAP):
        yield from _spans(row, lambda t: text.budget_spans(t, budget, overlap))


class GraphChunks:
    """Chunks of the graph index, without overlap."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument = None) -> AnalyzeResult:
        if budget is not None:
            _whole("budget", budget, 1)
        return _schema(rows, _SPAN)

    def eval(self, row: T.Row, budget: int = text.GRAPH_TOKENS):
        yield from _spans(row, lambda t: text.budget_spans(t, budget, None))


class BuilderChunks:
    """Chunks of at most `size` characters that end at paragraphs or lines."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument = None) -> AnalyzeResult:
        if size is not None:
            _whole("size", size, 1)
        return _schema(rows, _SPAN)

    def eval(self, row: T.Row, size: int = text.BUILDER_CHARS):
        yield from _spans(row, lambda t: text.builder_spans(t, size))


class HeadingScan:
    """The Markdown heading lines of each text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _schema(rows, _HEADING)

    def eval(self, row: T.Row):
        found = tree.headings(row["text"] or "")
        for (at, _, title, raw), level in zip(found, tree.levels([h[3] for h in found])):
            yield row[0], at, raw, title, level


class HeadingLevels:
    """The rows of a table with raw_level, in their order within a partition, with the level that each is used as."""

    def __init__(self):
        self.seen, self.last = {}, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "raw_level" not in rows.dataType.names:
            raise ValueError("the argument must be a table with a column raw_level")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("level", T.IntegerType())]))

    def eval(self, row: T.Row):
        self.last = tree.next_level(self.seen, self.last, row["raw_level"])
        yield *row, self.last


FUNCTIONS = {"chunk_text": ChunkText, "graph_chunks": GraphChunks, "builder_chunks": BuilderChunks, "heading_scan": HeadingScan, "heading_levels": HeadingLevels}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
