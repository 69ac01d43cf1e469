"""Exact top-k inner products by dual-tree cover-tree search.

Queries and data are both indexed by cover trees, whose levels are nested nets at distances 2^i. A pair of nodes is
skipped where the covering radii show that no inner product between them can reach the worst k-th score of the node's
queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, table

K, SCALE = 10, 1024
#: Rows of a block of data and of a part of its queries; block summaries looked at in one pass.
BLOCK, PART, SUMMARIES = 2048, 2048, 8192
#: Rows of a block in the registered query: so few in small tables that they have several blocks too, more in tables of
#: more than BLOCKS blocks, as the pairs of parts and blocks are the square of their number, up to BLOCK.
QUERY_BLOCK, BLOCKS = 256, 64
#: Pairs of parts and blocks that a task holds before it passes them on.
PAIRS = 1 << 16
#: Pivots that data are dealt by, chosen from a sample; both are bounds.
PIVOTS, SAMPLE = 256, 2048
#: Rounding errors of a bound, as a part of the product of the norms.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


class Node:
    """A point of one level with all that is below it: rows start to stop of the tree's order. radius is the distance to
    the farthest of them. A node without children is one point, whose rows are equal."""

    __slots__ = ("at", "level", "center", "radius", "norm", "start", "stop", "children", "stack")

    def __init__(self, at, level, center, radius, start, stop, children):
        self.at, self.level, self.center, self.radius, self.norm = at, level, center, radius, float(np.sqrt(center @ center))
        self.start, self.stop, self.children = start, stop, children
        self.stack = _stack(children) if children else None


def _stack(nodes: list[Node]):
    return (np.stack([c.center for c in nodes]), np.array([c.radius for c in nodes]), np.array([c.norm for c in nodes]), np.array([not c.children for c in nodes]))


def nets(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, parent, same) of each point, for the distances of all pairs: the net of level i is the points of level i
    and above. Its points are more than 2^i apart, all points are within 2^i of it, and a point's parent is the nearest
    one of the net above its level. same is a point's first equal one, itself for most; only those are in a net."""
    n = len(gap)
    same = (gap == 0).argmax(1)
    level, parent = np.zeros(n, np.int64), np.full(n, -1)
    near, nearest = gap[0].copy(), np.zeros(n, np.int64)
    left = np.flatnonzero(same == np.arange(n))[1:]
    i = math.ceil(math.log2(near.max())) if n and near.max() > 0 else 0
    level[0] = i
    while len(left):
        i = min(i - 1, math.ceil(math.log2(near[left].max())) - 1)  # empty levels are passed over
        above = nearest.copy()
        for p in left:
            if near[p] > 2.0 ** i:
                level[p], parent[p] = i, above[p]
                closer = gap[p] < near
                near[closer], nearest[closer] = gap[p][closer], p
        left = left[near[left] > 0]
    return level, parent, same


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """(root, order) of the cover tree of the points, without the levels at which a node has no child but itself."""
    square = (points ** 2).sum(1)
    gap = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * points @ points.T))
    unequal = np.unique(points, axis=0, return_inverse=True)[1].ravel()
    gap[unequal[:, None] == unequal[None]] = 0
    gap[(unequal[:, None] != unequal[None]) & (gap == 0)] = np.finfo(float).tiny
    level, parent, same = nets(gap)
    copies: dict[int, list[int]] = {}
    for row, first in enumerate(same):
        copies.setdefault(int(first), []).append(row)
    below: dict[int, dict[int, list[int]]] = {}
    for p in copies:
        if parent[p] >= 0:
            below.setdefault(int(parent[p]), {}).setdefault(int(level[p]), []).append(p)
    order: list[int] = []

    def leaf(p: int) -> Node:
        order.extend(copies[p])
        return Node(p, None, points[p], 0.0, len(order) - len(copies[p]), len(order), [])

    def build(p: int, levels: list[int]) -> Node:
        """The node of p whose children are those of levels[0], and p itself with those of the lower ones."""
        if not levels:
            return leaf(p)
        start = len(order)
        children = [build(p, levels[1:])] + [build(c, sorted(below.get(c, ()), reverse=True)) for c in below[p][levels[0]]]
        return Node(p, levels[0], points[p], float(gap[p][order[start:]].max()), start, len(order), children)

    return build(0, sorted(below.get(0, ()), reverse=True)), np.array(order)


class Search:
    """The k best data rows of each query, by score and then the smaller id, among those that reach `floor`. A row is no
    candidate for a query of the same row number."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, data: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        wide = max(queries.shape[1], data.shape[1])
        queries, data = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (queries, data))
        self.k = k
        most = max(1, wide) * int(np.abs(queries.astype(float)).max(initial=0)) * int(np.abs(data.astype(float)).max(initial=0))
        qroot, qorder = cover_tree(queries.astype(float))
        droot, dorder = cover_tree(data.astype(float))
        self.q, self.row, self.limit = queries[qorder], query_rows[qorder], floor[qorder].astype(float)
        self.d, self.drow, self.did = data[dorder], rows[dorder], ids[dorder]
        self.exact = most < 1 << 52
        if self.exact:
            self.q, self.d = self.q.astype(float), self.d.astype(float)
        elif most > LONGEST:  # whole numbers of any size
            self.q, self.d = self.q.astype(object), self.d.astype(object)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.q)
        self.scored = self.skipped = 0
        self.visit([qroot], _stack([qroot]), [droot], _stack([droot]))

    def least(self, q: Node) -> float:
        """The worst k-th score of the node's queries, less what rounding it to a double may add."""
        low = self.limit[q.start:q.stop].min()
        return low if self.exact or low == -math.inf else low - abs(low) * SLACK

    def base(self, q: Node, at: np.ndarray) -> None:
        """Score the node's queries against the data rows at these places."""
        self.scored += (q.stop - q.start) * len(at)
        scores = self.q[q.start:q.stop] @ self.d[at].T
        if scores.dtype == object:
            scores = np.clip(scores, -LONGEST, LONGEST)
        scores = scores.astype(np.int64)
        for i in range(q.stop - q.start):
            place = q.start + i
            good = (scores[i] >= self.limit[place] - (0 if self.exact else abs(self.limit[place]) * SLACK)) & (self.drow[at] != self.row[place])
            if not good.any():
                continue
            score, name = np.concatenate([self.best[place][0], scores[i][good]]), np.concatenate([self.best[place][1], self.did[at][good]])
            top = np.lexsort((name, -score))[:self.k]
            self.best[place] = score[top], name[top]
            if len(top) == self.k:
                self.limit[place] = max(self.limit[place], float(score[top[-1]]))

    def visit(self, qs: list[Node], q_stack, ds: list[Node], d_stack) -> None:
        """All pairs of two lists of nodes: what one product of their centres leaves of them."""
        (qc, qr, qn, _), (dc, dr, dn, single) = q_stack, d_stack
        reach = qc @ dc.T + qr[:, None] * dn + dr * qn[:, None] + qr[:, None] * dr
        reach += SLACK * (1 + (qn + qr)[:, None] * (dn + dr))
        starts, stops = (np.array([getattr(d, x) for d in ds]) for x in ("start", "stop"))
        near = reach >= np.array([self.least(q) for q in qs])[:, None]
        self.skipped += near.size - int(near.sum())
        for a in np.flatnonzero((near & single).any(1)):
            alone = np.flatnonzero(near[a] & single)
            alone = alone[np.argsort(-reach[a][alone], kind="stable")]
            for k in range(0, len(alone), 256):  # the best first, as they raise the limit for the rest
                some = alone[k:k + 256]
                some = some[reach[a][some] >= self.least(qs[a])]
                if len(some):
                    self.base(qs[a], np.concatenate([np.arange(x, y) for x, y in zip(starts[some], stops[some])]))
        inner = np.flatnonzero(~single & near.any(0))
        for j in inner[np.argsort(-reach[:, inner].max(0), kind="stable")]:  # all queries that still can gain go down together
            left = [q for a, q in enumerate(qs) if near[a, j] and reach[a, j] >= self.least(q)]
            below = [c for q in left for c in (q.children or [q])]
            if below:
                self.visit(below, left[0].stack if len(left) == 1 and left[0].children else _stack(below), ds[j].children, ds[j].stack)

    def found(self):
        for row, (scores, ids) in zip(self.row, self.best):
            yield from ((int(row), int(i), int(s)) for s, i in zip(scores, ids))


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of each component, for vectors whose components are all finite."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & whole).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(packed) -> np.ndarray:
    rows = [np.frombuffer(b, np.int64) for b in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _padded(rows: list[np.ndarray], least: int = 0) -> np.ndarray:
    out = np.zeros((len(rows), max([least, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """The first row and then the farthest from those chosen."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(number, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def query_block(number: int) -> int:
    return min(BLOCK, max(QUERY_BLOCK, number // BLOCKS))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = K, block: int | None = BLOCK, part: int = PART, summaries: int = SUMMARIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query names, the k other rows of the highest integer inner
    product, ties to the smaller vec_id.

    Data are dealt to blocks by the nearest of a few pivots and, where a pivot has many rows, by a hash, so equal
    vectors share the load. Queries of one block are a part, a row with its ball. A part first searches its own block; the
    worst k-th score of its queries then rules out blocks by both balls, and the others are searched as pairs of cover
    trees, in which each query has a limit of its own. Summaries of blocks are looked at `summaries` at a time, so
    what the driver holds does not grow with the data. Pairs of a part and a block are named only; the part's queries join
    them where they are searched. Without a block size it is QUERY_BLOCK, and up to BLOCK rows in a larger table.

    Defined cases: rows with null vec_id, a null vector, or a null or non-finite component take no part; an empty
    vector scores 0; shorter vectors count as padded with zeros; rows that share a vec_id are each a query of its own and
    a candidate for the others, told apart in no column; components and scores beyond 64 bits count as the largest or
    smallest such number; a query with fewer than k candidates has them all; an empty table gives no rows; other columns
    are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "covertree")
    rows = quantized(vectors)
    number = rows.count()
    block = block or query_block(number)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _pivots(_matrix([np.array(r[0], np.int64).tobytes() for r in sample]).astype(float), max(1, min(PIVOTS, math.ceil(number / block))))
    square = (pivots ** 2).sum(1)

    def deal(batches):
        for batch in batches:
            v = [np.array(x, np.int64) for x in batch.column(1).to_pylist()]
            wide = np.zeros((len(v), pivots.shape[1]))
            for i, x in enumerate(v):
                wide[i, :min(len(x), wide.shape[1])] = x[:wide.shape[1]]
            cell = (square[None] - 2 * wide @ pivots.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell.astype(np.int64))],
                                             names=["vec_id", "v", "cell"])

    dealt = scratch.save(rows.select("vec_id", "v").mapInArrow(deal, "vec_id long, v binary, cell long").withColumn("row", F.monotonically_increasing_id()), "dealt")
    counts = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")))  # PIVOTS rows at most
    dealt = scratch.save(dealt.join(counts, "cell").select(
        "row", "vec_id", "v", (F.col("cell") + F.lit(PIVOTS) * F.pmod(F.xxhash64("row"), "parts")).alias("block")), "blocks")
    scratch.drop("dealt")
    queries = dealt.filter(is_query).select("row", F.col("v").alias("q"), F.col("block").alias("home"))
    out_schema = "row long, vec_id long, score long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        """The queries of a part as one row: a node of the queries' tree, with its ball and its worst k-th score."""
        v = _matrix(rows["q"])
        x = v.astype(float)
        center = x.mean(0) if len(x) else np.zeros(0)
        return pd.DataFrame({"home": rows["home"][:1], "number": [len(rows)], "rows": [rows["row"].to_numpy(np.int64).tobytes()], "q": [v.tobytes()], "floors": [rows["floor"].to_numpy(float).tobytes()],
                             "center": [center.tobytes()], "radius": [float(np.sqrt(((x - center) ** 2).sum(1)).max())], "floor": [float(rows["floor"].min())]})

    def packed(asked: DataFrame) -> DataFrame:
        """The parts of asked(row, q, floor, home): queries of one home, at most about `part` of them."""
        sizes = asked.groupBy("home").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
        dealt_out = asked.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
        return dealt_out.groupBy("home", "part").applyInPandas(pack, "home long, number int, rows binary, q binary, floors binary, center binary, radius double, floor double")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            q = [row.tobytes() for b, n in zip(left["q"], left["number"]) for row in np.frombuffer(b, np.int64).reshape(n, -1)]
            rows, floors = (np.concatenate([np.frombuffer(b, kind) for b in left[c]]) for c, kind in (("rows", np.int64), ("floors", float)))
            data = _matrix(right["v"]), right["of"].to_numpy(), right["vec_id"].to_numpy()
            pieces = math.ceil(len(q) / part)  # a group is about `part` queries, a tree no more
            for at in np.array_split(np.arange(len(q)), pieces):
                found += Search(_matrix(q[at[0]:at[-1] + 1]), rows[at], floors[at], *data, k).found()
        return pd.DataFrame(found, columns=["row", "vec_id", "score"]).astype("int64")

    def pairs(wanted: DataFrame) -> DataFrame:
        """Parts of queries, each for a block, against the rows of the blocks; of a block that many queries want, about
        `part` queries meet its rows at a time."""
        groups = wanted.groupBy("block").agg(F.ceil(F.sum("number") / part).cast("int").alias("groups"))
        asked = wanted.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("rows"), "groups").cast("int"))
        data = dealt.join(groups, "block").withColumn("group", F.explode(F.expr("sequence(0, groups - 1)"))).select("block", "group", F.col("row").alias("of"), "vec_id", "v")
        return asked.select("block", "group", "number", "rows", "q", "floors").groupBy("block", "group").cogroup(data.groupBy("block", "group")).applyInPandas(search, out_schema)

    none = F.lit(float("-inf"))
    home = scratch.save(pairs(packed(queries.withColumn("floor", none)).withColumn("block", F.col("home"))), "home")
    floors = home.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = scratch.save(packed(queries.join(floors, "row", "left").withColumn("floor", F.coalesce(F.col("floor").cast("double"), none))).withColumn("id", F.monotonically_increasing_id()), "asked")

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(rows["v"]).astype(float)
        center = v.mean(0)
        return pd.DataFrame({"block": rows["block"][:1], "center": [center.tobytes()], "radius": [float(np.sqrt(((v - center) ** 2).sum(1)).max())]})

    balls = scratch.save(dealt.groupBy("block").applyInPandas(summary, "block long, center binary, radius double"), "balls")
    n_blocks, found = balls.count(), home
    passes = math.ceil(n_blocks / summaries)
    for turn in range(passes):
        some = balls.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == turn).collect()  # about `summaries` rows
        names = np.array([r[0] for r in some], np.int64)
        center = _padded([np.frombuffer(r[1]) for r in some])
        radius = np.array([r[2] for r in some])

        def reach(batches, names=names, center=center, radius=radius):
            """(id, block): each part with the blocks that can hold an inner product as high as its floor: of two balls the
            highest one is that of the centres, and what each radius adds along the other's farthest point."""
            long = np.sqrt((center ** 2).sum(1))

            def batch_of(ids, blocks):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, blocks)], names=["id", "block"])

            for batch in batches:
                ids, blocks, held = [], [], 0
                for i, h, b, r, f in zip(*(batch.column(c).to_pylist() for c in ("id", "home", "center", "radius", "floor"))):
                    x = _padded([np.frombuffer(b)], center.shape[1])[0]
                    norm = np.sqrt(float((x ** 2).sum()))
                    most = center @ x[:center.shape[1]] + radius * norm + r * (long + radius)
                    slack = SLACK * (1 + (norm + r) * (long + radius)) + (abs(f) * SLACK if f > -math.inf else 0)
                    good = names[(most + slack >= f) & (names != h)]
                    ids.append(np.full(len(good), i, np.int64))
                    blocks.append(good)
                    held += len(good)
                    if held >= PAIRS:
                        yield batch_of(ids, blocks)
                        ids, blocks, held = [], [], 0
                if held:
                    yield batch_of(ids, blocks)

        wanted = scratch.save(asked.select("id", "home", "center", "radius", "floor").mapInArrow(reach, "id long, block long"), f"wanted{turn}")
        wanted = wanted.join(asked.select("id", "number", "rows", "q", "floors"), "id")
        found = found.unionByName(scratch.save(pairs(wanted), f"found{turn}"))
        scratch.drop(f"wanted{turn}")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(dealt.filter(is_query).select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op8_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, candidates all rows. Every table has several blocks."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, block=None)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint score
  from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s)
select * from r where rank <= 10
"""
