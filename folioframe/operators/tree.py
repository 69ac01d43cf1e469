"""Heading trees: building them from Markdown, validating them, and walking them.

A tree is an adjacency list with a materialised path, so pre-order is a sort and a subtree a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.operators import paths
from folioframe.operators.tables import replace_group
from folioframe.operators.text import each_text
from folioframe.sources.files import Rounds

_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
#: Digits of one step of a path.
STEP = 6


def headings(text: str) -> list[tuple[int, int, str, int]]:
    """(offset, line length, title, raw level) of each Markdown heading line."""
    out, at = [], 0
    for line in text.split("\n"):
        if line[:1] == "#" and (m := _HEADING.match(line)):
            out.append((at, len(line), m[2].strip(), len(m[1])))
        at += len(line) + 1
    return out


def levels(raw: list[int]) -> list[int]:
    """Heading levels without gaps: the first is 1, a level seen before is as before, one deeper than all seen is a
    step below the previous heading, and any other is that of the next deeper one seen."""
    seen: dict[int, int] = {}
    last = 0
    return [last := next_level(seen, last, level) for level in raw]


def next_level(seen: dict[int, int], last: int, level: int) -> int:
    """The level that a heading of raw level `level` is used as, after the one used last; seen is kept up."""
    if level not in seen:
        deeper = [k for k in seen if k > level]
        seen[level] = seen[min(deeper)] if deeper else last + 1
    return seen[level]


def outline(text: str, title: str = "") -> Iterator[tuple]:
    """(seq, parent_seq, level, order_index, title, title_offset, title_length, content_offset, content_length, path) of
    the tree's nodes in pre-order; node 0 is the root and owns what stands before the first heading."""
    found = headings(text)
    level = levels([h[3] for h in found])
    top = "0" * STEP
    yield 0, None, 0, 0, title, 0, 0, 0, found[0][0] if found else len(text), top
    stack: list[tuple[int, int, str]] = [(0, 0, top)]
    children = {0: 0}
    for i, ((at, size, name, _), depth) in enumerate(zip(found, level), 1):
        while stack[-1][1] >= depth:
            stack.pop()
        parent = stack[-1][0]
        path = f"{stack[-1][2]}.{children[parent]:0{STEP}}"
        start = min(at + size + 1, len(text))
        stop = found[i][0] if i < len(found) else len(text)
        yield i, parent, depth, children[parent], name, at, size, start, max(0, stop - start), path
        children[parent] += 1
        children[i] = 0
        stack.append((i, depth, path))


_NODE = [("seq", T.LongType()), ("parent_seq", T.LongType()), ("level", T.IntegerType()), ("order_index", T.IntegerType()), ("title", T.StringType()),
         ("title_offset", T.LongType()), ("title_length", T.LongType()), ("content_offset", T.LongType()), ("content_length", T.LongType()), ("path", T.StringType())]


def heading_scan(books: DataFrame, book: str = "book_id", text: str = "text") -> DataFrame:
    """(book, line_offset, raw_level, title, level): the heading lines with their levels as they are and as used."""
    def rows(t: str):
        found = headings(t)
        return ((h[0], h[3], h[2], n) for h, n in zip(found, levels([h[3] for h in found])))
    return each_text(books, book, text, rows, [("line_offset", T.LongType()), ("raw_level", T.IntegerType()), ("title", T.StringType()), ("level", T.IntegerType())])


def build_tree(books: DataFrame, book: str = "book_id", text: str = "text") -> DataFrame:
    """Nodes of every book, with ids <book>/<seq> and paths; the root's parent_id is empty."""
    nodes = each_text(books, book, text, outline, _NODE)
    ident = lambda c: F.concat_ws("/", F.col(book).cast("string"), c.cast("string"))
    return nodes.select(
        ident(F.col("seq")).alias("id"), F.col(book).alias("book_id"),
        F.when(F.col("parent_seq").isNull(), "").otherwise(ident(F.col("parent_seq"))).alias("parent_id"),
        *[c for c, _ in _NODE[2:]])


def _links(nodes: DataFrame) -> DataFrame:
    """(id, up, step) for paths: ids are those of a book."""
    up = F.when(F.col("parent_id") != "", F.struct("book_id", F.col("parent_id").alias("id")))
    return nodes.select(F.struct("book_id", "id").alias("id"), up.alias("up"), F.lpad(F.col("order_index").cast("string"), STEP, "0").alias("step"))


def with_paths(nodes: DataFrame) -> DataFrame:
    """nodes with path, the order_index of every step from the root in fixed digits, joined by dots: sorting by
    (book_id, path) is pre-order. Trees that were built here have it already; others, of any depth, get it in log2(depth)
    rounds of joins over their ids. Nodes that no root reaches are left out; a cycle is an error."""
    if "path" in nodes.columns:
        return nodes.filter("path is not null")
    links = _links(nodes)
    known = paths.reached(links)
    if (bad := known.filter("looped").first()) is not None:
        raise ValueError(f"book {bad.id.book_id}: {bad.id.id} is on or below a cycle")
    found = paths.root_paths(links, known).select(F.col("id.book_id").alias("book_id"), F.col("id.id").alias("id"), "path")
    return nodes.join(found, ["book_id", "id"])


def preorder(nodes: DataFrame) -> DataFrame:
    """(book_id, id, path, position): every node that the root reaches, position counting from 0 in its book."""
    order = Window.partitionBy("book_id").orderBy("path")
    return with_paths(nodes).withColumn("position", F.row_number().over(order) - 1)


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def roots(nodes: DataFrame) -> DataFrame:
    """The root of each book that has exactly one; the others are what violations() names "no root" or "many roots"."""
    one = Window.partitionBy("book_id")
    return nodes.filter("parent_id = ''").withColumn("_n", F.count("*").over(one)).filter("_n = 1").drop("_n")


def root(nodes: DataFrame, book_id) -> DataFrame:
    """A book's root; none or several are an error."""
    found = nodes.filter((F.col("book_id") == book_id) & (F.col("parent_id") == ""))
    if (n := found.limit(2).count()) != 1:
        raise ValueError(f"book {book_id} has {'no root' if not n else 'many roots'}")
    return found


def children(nodes: DataFrame, node_id: str) -> DataFrame:
    """In order; an unknown node is an error."""
    if node_by_id(nodes, node_id).isEmpty():
        raise KeyError(node_id)
    return nodes.filter(F.col("parent_id") == node_id).orderBy("order_index")


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, parent_title): null for roots."""
    up = nodes.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    return nodes.select("id", "parent_id").join(up, "parent_id", "left").select("id", F.expr("nullif(parent_id, '')").alias("parent_id"), "parent_title")


def descendants(nodes: DataFrame, node_id: str) -> DataFrame:
    """The nodes below one, in pre-order: those whose path extends its path."""
    walked = with_paths(nodes)
    top = walked.filter(F.col("id") == node_id).select(F.col("book_id").alias("_book"), F.concat("path", F.lit(".")).alias("_top"))
    return walked.join(F.broadcast(top), (F.col("book_id") == F.col("_book")) & F.col("path").startswith(F.col("_top"))).drop("_book", "_top").orderBy("path")


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    return with_paths(nodes).filter(F.col("level") == level).orderBy("book_id", "path")


def own_text(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """nodes with body, their own part of the text; a range outside the text is an error."""
    joined = nodes.join(content.select("book_id", "text"), "book_id")
    inside = (F.col("content_offset") >= 0) & (F.col("content_length") >= 0) & (F.col("content_offset") + F.col("content_length") <= F.length("text"))
    body = F.substring(F.col("text"), (F.col("content_offset") + 1).cast("int"), F.col("content_length").cast("int"))
    return joined.withColumn("body", F.when(inside, body).otherwise(F.raise_error(F.concat(F.lit("range outside the text: "), F.col("id"))))).drop("text")


def subtree_text(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """(id, text): every node's own text and that of all below it, in pre-order; a range outside the text is an error.

    A book's text meets the ranges of its nodes once. Their own texts in pre-order are one string, of which each
    subtree is a slice: nothing is sent to ancestors."""
    places = with_paths(nodes).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("path", "id", F.col("content_offset").cast("long").alias("content_offset"), F.col("content_length").cast("long").alias("content_length")))).alias("nodes"))
    kind = dict(nodes.dtypes)["id"]

    def slices(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if (bad := next((r for r in rows if not 0 <= r["content_offset"] <= r["content_offset"] + max(r["content_length"], -1) <= len(text) or r["content_length"] < 0), None)) is not None:
                    raise ValueError(f"range outside the text: {bad['id']}")
                ends = list(accumulate((r["content_length"] for r in rows), initial=0))
                whole = "".join(text[r["content_offset"]:r["content_offset"] + r["content_length"]] for r in rows)
                stop, inside = [len(rows)] * len(rows), []
                for i, r in enumerate(rows):
                    while inside and not r["path"].startswith(rows[inside[-1]]["path"] + "."):
                        stop[inside.pop()] = i
                    inside.append(i)
                yield from parted([r["id"] for r in rows], [(ends[i], ends[stop[i]]) for i in range(len(rows))], whole)

    def parted(ids, spans, whole):
        at = 0
        while at < len(ids):  # about 16 million characters at a time
            to, size = at, 0
            while to < len(ids) and (to == at or size < 1 << 24):
                size += spans[to][1] - spans[to][0]
                to += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:to]), pa.array([whole[a:b] for a, b in spans[at:to]], pa.string())], names=["id", "text"])
            at = to

    return content.select("book_id", F.coalesce("text", F.lit("")).alias("text")).join(places, "book_id").select("text", "nodes").mapInArrow(slices, f"id {kind}, text string")


def violations(nodes: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """(book_id, id, problem): every breach of the rules of a tree, none for valid trees. Problems: repeated id,
    negative length, no root, many roots, root level, missing parent, other book, level order, sibling order, cycle.

    Every check reads the nodes, so what they are made of is computed once and written."""
    wanted = [c for c in ("book_id", "id", "parent_id", "level", "order_index", "title_offset", "title_length", "content_offset", "content_length") if c in nodes.columns]
    saved = Rounds(nodes.sparkSession, "violations")
    nodes = saved.save(nodes.select(*wanted), "nodes")
    row = lambda df, problem: df.select("book_id", "id", F.lit(problem).alias("problem"))

    def rows(df, ident, **problems):
        """A row for each problem whose test holds, in one pass."""
        found = F.array_compact(F.array(*[F.when(F.expr(test), name.replace("_", " ")) for name, test in problems.items()]))
        return df.select("book_id", ident.alias("id"), F.explode(found).alias("problem"))

    ident = F.col("id")
    per_book = nodes.groupBy("book_id").agg(F.sum((F.col("parent_id") == "").cast("int")).alias("n"))
    up = nodes.select(F.col("id").alias("_up"), F.col("level").alias("_level"), F.col("book_id").alias("_book"))
    tied = nodes.filter("parent_id <> ''").join(up, F.col("parent_id") == F.col("_up"), "left")
    tied = rows(tied, ident, missing_parent="_up is null", other_book="_book <> book_id", level_order="level <= _level")
    tied = saved.save(tied, "tied")
    siblings = Window.partitionBy("book_id", "parent_id", "order_index")
    #: Levels that only grow rule a cycle out, so only books with a node at or above its parent's level can have one.
    out = [
        row(nodes.groupBy("book_id", "id").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated id"),
        rows(nodes, ident, negative_length="title_length < 0 or content_length < 0 or title_offset < 0 or content_offset < 0", root_level="parent_id = '' and level <> 0"),
        rows(per_book, F.lit(""), no_root="n = 0", many_roots="n > 1"), tied,
        row(nodes.filter("parent_id <> ''").withColumn("_n", F.count("*").over(siblings)).filter("_n > 1"), "sibling order"),
    ]
    base = nodes.dropDuplicates(["id"])
    suspects = tied.filter("problem = 'level order'").select("book_id").distinct()
    base = base.join(suspects, "book_id", "left_semi")
    looped = paths.reached(base.select("id", F.expr("nullif(parent_id, '')").alias("up"))).filter("looped").select("id")
    out.append(row(base.join(looped, "id"), "cycle"))
    if content is not None:
        wide = nodes.join(content.select("book_id", F.length("text").alias("_len")), "book_id")
        out.append(row(wide.filter("content_offset + content_length > _len or title_offset + title_length > _len"), "outside the text"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def replace_tree(table: DataFrame, nodes: DataFrame, content: DataFrame) -> DataFrame:
    """table with the trees of the books in nodes replaced, after a check: nodes that break a rule are an error."""
    if (bad := violations(nodes, content).first()) is not None:
        raise ValueError(f"book {bad.book_id}: {bad.problem} {bad.id}")
    return replace_group(table, nodes)


def toc(items: DataFrame) -> DataFrame:
    """Table-of-contents items with a title, levels at least 1."""
    return items.filter(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("level", F.greatest("level", F.lit(1)))


NODE = ["id", "book_id", "parent_id", "level", "order_index", "title", "content_offset", "content_length"]


class _Build:
    """The nodes of one book while its log is replayed; a node is (number, parent, level, order, title, start, stop)."""

    def __init__(self):
        self.done: list[tuple] = []
        self.open: list[tuple] = [(0, -1, 0, 0, "", 0, 0)]
        self.kids: dict[int, int] = {}
        self.undo: list[tuple] = []  # for each operation: the nodes it closed, the node it opened, the node it replaced
        self.undone: set = set()
        self.number = 0

    def apply(self, chunk, op: str, level: int, title: str, start: int, stop: int) -> None:
        if op == "rollback":
            self._roll_back(chunk)
            return
        closed, opened, replaced = [], None, None
        if op == "open":
            while self.open and self.open[-1][2] >= level:
                closed.append(self.open.pop())
            parent = self.open[-1][0] if self.open else -1
            self.number += 1
            opened = (self.number, parent, level, self.kids.get(parent, 0), title or "", start, stop)
            self.kids[parent] = opened[3] + 1
            self.open.append(opened)
        elif op == "append" and self.open:
            replaced = n = self.open[-1]
            self.open[-1] = (*n[:5], start if n[5] == n[6] else n[5], stop)
        elif op in ("complete", "finish"):
            while len(self.open) > 1 and (op == "finish" or not closed):
                closed.append(self.open.pop())
        self.done += closed
        self.undo.append((closed, opened, replaced))

    def _roll_back(self, chunk) -> None:
        if chunk in self.undone or not self.undo:
            return
        closed, opened, replaced = self.undo.pop()
        if opened:
            self.kids[self.open.pop()[1]] -= 1
        if replaced:
            self.open[-1] = replaced
        del self.done[len(self.done) - len(closed):]
        self.open += reversed(closed)
        self.undone.add(chunk)

    def nodes(self) -> list[tuple]:
        return sorted([*self.done, *self.open])


def replay(operations: DataFrame) -> DataFrame:
    """Nodes that a log of builder operations makes, for operations(book_id, chunk, seq, op, level, title, start, stop).

    open starts a node below the last open one of a smaller level, closing those it passes; append widens the open
    node's text to [start, stop); complete closes it, except the root; rollback undoes the last operation, once in a
    chunk; finish closes all. Logs are sorted by book and replayed as they come, in time linear in them; of a book only its nodes and
    what undoes its operations are held."""
    names, kind = ["book_id", "chunk", "op", "level", "title", "start", "stop"], dict(operations.dtypes)["book_id"]

    def run(batches):
        import pyarrow as pa

        def table(nodes: list[tuple], book: pa.DataType) -> pa.RecordBatch:
            rows = [(f"{b}/{n[0]}", b, "" if n[1] < 0 else f"{b}/{n[1]}", n[2], n[3], n[4], 0 if n[1] < 0 else n[5], max(0, n[6] - n[5])) for b, n in nodes]
            kinds = [pa.string(), book, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=NODE)

        at = build = None
        for batch in batches:
            whole = []
            for book, chunk, *operation in zip(*(batch.column(c).to_pylist() for c in names)):
                if build is None or book != at:
                    whole += [(at, n) for n in build.nodes()] if build else []
                    at, build = book, _Build()
                build.apply(chunk, *operation)
            yield table(whole, batch.schema.field("book_id").type)
        if build:
            yield table([(at, n) for n in build.nodes()], batch.schema.field("book_id").type)

    ordered = operations.repartition("book_id").sortWithinPartitions("book_id", "chunk", "seq").select(*names)
    return ordered.mapInArrow(run, f"id string, book_id {kind}, parent_id string, level int, order_index int, title string, content_offset long, content_length long")
