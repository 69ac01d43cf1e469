"""Cutting texts: token-budget chunks, builder chunks, summary fragments, metadata fragments and boundary tags.

Each cut depends on the one before, so a text is cut in one pass inside an Arrow batch; texts are independent and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults of the index builders.
CHUNK_TOKENS, CHUNK_OVERLAP, GRAPH_TOKENS, CHARS_PER_TOKEN = 500, 50, 1000, 4
BUILDER_CHARS, FRAGMENT_CHARS, FRAGMENTS = 3000, 2000, 3
SUMMARY_TOKENS = 3000
REACH = 200
#: Characters after which a boundary tag is put; fixed values.
BOUNDARIES = "。！？.!?;；:：\n"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def cut_point(text: str, at: int) -> int:
    """The end of the last paragraph, else sentence, else line that ends within REACH characters of `at`, else `at`.
    An ideographic full stop anywhere in the window rules out the Latin one, even at its very start."""
    low, high = max(0, at - REACH), min(len(text), at + REACH)
    if (p := text.rfind("\n\n", low, high)) > 0:
        return p + 2
    p = text.rfind("。", low, high)
    p = text.rfind(".", low, high) if p < 0 else p
    if p > 0 or (p := text.rfind("\n", low, high)) > 0:
        return p + 1
    return at


def budget_spans(text: str, budget: int, overlap: int | None) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks of about `budget` tokens. Each begins overlap tokens before the last one's end and at
    least one character after its start; None is no overlap."""
    start = 0
    while start < len(text):
        rest = len(text) - start
        tokens = max(1, rest // CHARS_PER_TOKEN)
        if tokens <= budget:
            yield start, len(text)
            return
        near = max(100, min(int(rest * budget / tokens), rest))
        cut = cut_point(text[start:start + near + REACH], near)  # nothing beyond the window matters
        yield start, start + cut
        start += cut if overlap is None else max(1, cut - overlap * CHARS_PER_TOKEN)


def builder_spans(text: str, size: int = BUILDER_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks of at most `size` characters that end after a paragraph or line of the last REACH."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            low = max(start, end - REACH)
            for mark in ("\n\n", "\n"):
                if (p := text.rfind(mark, low, end)) > start:
                    end = p + len(mark)
                    break
        yield start, end
        start = end


def paragraph_groups(text: str, fragments: int, budget: int) -> list[str]:
    """Paragraphs packed in order into fragments of at most `budget` estimated tokens, a longer one alone."""
    if fragments <= 1:
        return [text]
    out, group, used = [], [], 0
    for paragraph in text.split("\n\n"):
        cost = max(1, len(paragraph) // CHARS_PER_TOKEN)
        if group and used + cost > budget:
            out.append("\n\n".join(group))
            group, used = [], 0
        group.append(paragraph)
        used += cost
    return [*out, "\n\n".join(group)]


def each_text(docs: DataFrame, key: str, text: str, rows: Callable[[str], Iterator[tuple]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """A row (key, *fields) for each tuple that rows(text) gives."""
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field(0), *(pa.field(n, _arrow(t)) for n, t in fields)])
            for at in range(0, batch.num_rows, 256):
                keys, texts = (batch.column(k).slice(at, 256).to_pylist() for k in (0, 1))
                out = [(k, *row) for k, t in zip(keys, texts) for row in rows(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind.simpleString()]


_SPAN = [("chunk_index", T.IntegerType()), ("content_offset", T.LongType()), ("content_length", T.LongType()), ("chunk_text", T.StringType())]


def _spans(cut: Callable[[str], Iterator[tuple[int, int]]]) -> Callable[[str], Iterator[tuple]]:
    return lambda text: ((i, a, b - a, text[a:b]) for i, (a, b) in enumerate(cut(text)))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, content_offset, content_length, chunk_text) of the chunk index; an empty text has none."""
    return each_text(docs, key, text, _spans(lambda t: budget_spans(t, budget, overlap)), _SPAN)


def graph_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = GRAPH_TOKENS) -> DataFrame:
    """Chunks of the graph index, which do not overlap."""
    return each_text(docs, key, text, _spans(lambda t: budget_spans(t, budget, None)), _SPAN)


def builder_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BUILDER_CHARS) -> DataFrame:
    return each_text(docs, key, text, _spans(lambda t: builder_spans(t, size)), _SPAN)


def summary_fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", fragments: int = 2, budget: int = SUMMARY_TOKENS) -> DataFrame:
    rows = lambda t: ((i, len(f), f) for i, f in enumerate(paragraph_groups(t, fragments, budget)))
    return each_text(docs, key, text, rows, [("fragment", T.IntegerType()), ("length", T.LongType()), ("fragment_text", T.StringType())])


def metadata_fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = FRAGMENT_CHARS, most: int = FRAGMENTS) -> DataFrame:
    """(key, fragment, fragment_text): the first `most` slices of `size` characters; an empty text has one, empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(F.length(body) / size).cast("int")) - 1)
    return docs.select(key, body.alias("body"), F.explode(F.sequence(F.lit(0), last)).alias("fragment")).select(
        key, "fragment", F.expr(f"substring(body, fragment * {size} + 1, {size})").alias("fragment_text"))


def _tag_rows(text: str) -> Iterator[tuple]:
    parts, offsets = ["<s0/>"], [0]
    low = 0
    for i, c in enumerate(text):
        if c in BOUNDARIES:
            parts += [text[low:i + 1], f"<s{len(offsets)}/>"]
            offsets.append(i + 1)
            low = i + 1
    parts += [text[low:], f"<s{len(offsets)}/>"]
    offsets.append(len(text))
    yield "".join(parts), len(offsets), ",".join(map(str, offsets))


def tagify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tagged_text, n_tags, tag_offsets); offsets are those of tags 0, 1, ... in order."""
    return each_text(docs, key, text, _tag_rows, [("tagged_text", T.StringType()), ("n_tags", T.LongType()), ("tag_offsets", T.StringType())])


def resolve_tags(tags: DataFrame, tag_map: DataFrame) -> DataFrame:
    """(key, start_tag, end_tag, start, stop) for ranges whose tags are both known and in order; others drop out."""
    m = tag_map.select("doc_id", F.transform(F.split("tag_offsets", ","), lambda x: x.cast("long")).alias("at"))
    j = tags.join(m, "doc_id").withColumn("start", F.get("at", F.col("start_tag"))).withColumn("stop", F.get("at", F.col("end_tag")))
    return j.filter("start is not null and stop is not null and start <= stop").drop("at")


def neighbour(text: Column, start: Column, stop: Column, direction: str, count: int = 50) -> Column:
    """The `count` characters before start ("prev") or from stop on ("next")."""
    if direction == "prev":
        low = F.greatest(F.lit(0), start - count)
        return F.substring(text, low + 1, (start - low).cast("int"))
    return F.substring(text, stop + 1, F.lit(count))


def citations(answer: Column) -> Column:
    """The ids of <entity id/> style citation tags in an answer, in order."""
    return F.regexp_extract_all(answer, F.lit(r"<(?:entity|chunk|node|summary|relationship)\s+([\w\-.:]+)\s*/>"), F.lit(1))
