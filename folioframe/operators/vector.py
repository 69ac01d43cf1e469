"""Vector operators: similarities, top-k, similar pairs and greedy merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.sources.files import Rounds

#: Most cells of a group; their directions are held by the driver and each task.
CELLS = 256
#: Most large groups that are told to every task.
LISTED = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def search(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", **equal) -> DataFrame:
    """The k nearest by squared distance, ties by key, with score = 1 - distance. Equalities on payload columns filter
    before the limit, so they never cost results; a partial top-k of each task is all that moves."""
    for column, value in equal.items():
        vectors = vectors.filter(F.col(column) == F.lit(value))
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", squared_l2(F.col(vector), q)).orderBy("distance", key).limit(k).withColumn("score", 1 - F.col("distance"))


def _unit(wide: list) -> np.ndarray:
    """Vectors of one length scaled to 1; zero vectors stay."""
    m = np.array(wide, np.float64)
    norm = np.sqrt((m * m).sum(1))
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)


def _pivots(rows: DataFrame, number: int) -> np.ndarray:
    """Directions that lie far apart: the first of a sample and then always the one farthest from those chosen."""
    sample = [r.v for r in rows.filter(F.size("v") > 0).select("v").orderBy(F.xxhash64("k"), "k").limit(8 * number).collect()]
    sample = _unit([v for v in sample if len(v) == len(sample[0])]) if sample else np.zeros((0, 0))
    chosen, near = [], np.full(len(sample), -2.0)  # the cosine to the nearest one chosen
    while len(chosen) < min(number, len(sample)) and (not chosen or near.min() < 1 - 1e-12):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def in_cells(rows: DataFrame, at_least: float, block: int, most: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): rows(g, k, v) with the cell and the block of each, and pairs(g, a, b, met) of the cells of each group,
    a <= b, with whether rows of both can have a cosine of at least `at_least`.

    A group has about as many cells as blocks, at most `most`: each row is in that of the direction nearest to it. Two
    cells are left out if the angle between their directions is wider than both cells and the threshold together."""
    n = rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("cells", F.least(F.lit(most), F.ceil(F.col("n") / block)).cast("int"))
    rows = rows.join(n.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g", "n")
    largest = n.agg(F.max("cells")).first()[0] or 1
    pivots = _pivots(rows, largest) if largest > 1 and at_least > 0 else np.zeros((0, 0))
    kinds = dict(rows.dtypes)

    def place(batches):
        for batch in batches:
            wide, cells = batch.column(2).to_pylist() if len(pivots) else [], np.array(batch.column(3))
            cell, angle = np.zeros(len(cells), np.int32), np.full(len(cells), np.pi)  # what has no direction may be like all
            at = np.array([i for i, v in enumerate(wide) if v is not None and len(pivots) and len(v) == pivots.shape[1]], np.int64)
            if len(at):
                to = _unit([wide[i] for i in at]) @ pivots.T
                to[np.arange(len(pivots))[None] >= cells[at][:, None]] = -2
                cell[at] = to.argmax(1)
                angle[at] = np.arccos(np.clip(to.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(angle)], names=["g", "k", "v", "cell", "angle"])

    placed = rows.select("g", "k", "v", "cells").mapInArrow(place, f"g {kinds['g']}, k {kinds['k']}, v array<double>, cell int, angle double")
    placed = Rounds(rows.sparkSession, "cells").save(placed, "placed")
    sizes = placed.groupBy("g", "cell").agg(F.max("angle").alias("wide"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((1, 1))
    limit = float(np.arccos(min(1.0, at_least))) if at_least > 0 else float(np.pi)

    def near(batches):
        for batch in batches:
            a, b, wa, wb = (np.array(batch.column(c)) for c in ("a", "b", "wa", "wb"))
            met = (a == b) | (between[a, b] <= wa + wb + limit + 1e-6)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "a", "b", "pa", "pb")), pa.array(met)], names=["g", "a", "b", "pa", "pb", "met"])

    left = sizes.select("g", F.col("cell").alias("a"), F.col("wide").alias("wa"), F.col("parts").alias("pa"))
    right = sizes.select(F.col("g").alias("_g"), F.col("cell").alias("b"), F.col("wide").alias("wb"), F.col("parts").alias("pb"))
    pairs = left.join(right, F.col("g").eqNullSafe(F.col("_g")) & (F.col("a") <= F.col("b"))).drop("_g")  # at most `most` squared for a group
    return placed, pairs.mapInArrow(near, f"g {kinds['g']}, a int, b int, pa int, pb int, met boolean")


def similar_pairs(vectors: DataFrame, at_least: float, group: str, key: str = "id", vector: str = "vector", block: int = 1024) -> DataFrame:
    """(group, a, b, cosine), a < b by key, within each group. A group's rows lie in cells of like directions, cells in
    blocks; blocks of cells that can hold a pair meet inside tasks, as matrix products that return only pairs over the
    threshold. A large group is many tasks."""
    rows = vectors.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    placed, pairs = in_cells(rows, at_least, block)
    met = pairs.filter("met").select(F.col("g").alias("_g"), "a", "b", "pa", "pb")
    ways = met.select("_g", F.col("a").alias("_cell"), F.col("b").alias("_to"), F.col("pa").alias("_own"), F.col("pb").alias("_parts")).unionByName(
        met.filter("a < b").select("_g", F.col("b").alias("_cell"), F.col("a").alias("_to"), F.col("pb").alias("_own"), F.col("pa").alias("_parts")))
    dealt = placed.join(ways, F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_cell")))
    name = lambda cell, part: F.shiftleft(cell.cast("long"), 32) + part
    dealt = dealt.withColumn("own", name(F.col("cell"), F.pmod(F.xxhash64("k"), "_own"))).withColumn("other", F.explode(F.transform(F.expr("sequence(0, _parts - 1)"), lambda x: name(F.col("_to"), x))))
    dealt = dealt.select("g", "k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def meet(table: pa.Table) -> tuple[list, list, list]:
        keys, own, wide = table.column("k").to_pylist(), np.array(table.column("own")), table.column("v").combine_chunks()
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        out: tuple[list, list, list] = [], [], []
        long = np.array(pc.fill_null(pc.list_value_length(wide), 0))
        if len(long) == 1 or i != j and (own == own[0]).all():
            return out
        for size in set(long.tolist()) - {0}:
            at = np.flatnonzero(long == size)
            m = wide.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
            norm = np.sqrt((m * m).sum(1))
            m = np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)
            left, right = at[own[at] == i], at[own[at] == j]
            both = m[own[at] == i] @ m[own[at] == j].T
            for p, q in zip(*np.nonzero(both >= at_least)):
                a, b = keys[left[p]], keys[right[q]]
                if i == j and a >= b:
                    continue
                for column, value in zip(out, (min(a, b), max(a, b), float(both[p, q]))):
                    column.append(value)
        return out

    def run(batches):
        """Rows come in the order of their groups of blocks; the last group waits for the next batch."""
        held = schema = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            schema, cuts = table.schema, np.zeros(max(0, table.num_rows - 1), bool)
            for c in ("g", "i", "j"):
                code = table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                cuts |= code[1:] != code[:-1]
            edges = [0, *(np.flatnonzero(cuts) + 1).tolist()]
            yield from told((table.slice(a, b - a) for a, b in zip(edges, edges[1:])), schema)
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from told([held], schema)

    def told(groups, schema):
        for table in groups:
            a, b, score = meet(table)
            if a:
                kind = schema.field("k").type
                yield pa.RecordBatch.from_arrays([pa.array([table.column("g")[0].as_py()] * len(a), schema.field("g").type), pa.array(a, kind), pa.array(b, kind), pa.array(score, pa.float64())], names=["g", "a", "b", "cosine"])

    types = dict(rows.dtypes)
    #: Groups of blocks pass through a task one after the other, as there may be as many as books.
    ordered = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = ordered.mapInArrow(run, f"g {types['g']}, a {types['k']}, b {types['k']}, cosine double")
    return found.withColumnRenamed("g", group)


def _merged_blocks(dealt: DataFrame, at_least: float, group: str, key: str, matrix: Callable[[list], np.ndarray] | None) -> DataFrame:
    """The rows of dealt(group, key, ..., _v) with their representative in place of _v, which are vectors or what matrix makes
    vectors of. The rows of a group follow each other in key order, within one task, and are few."""
    kind = T.StructType([*dealt.drop("_v").schema.fields, T.StructField("representative", dealt.schema[key].dataType)])

    def settle(near: np.ndarray, at: np.ndarray, rep: np.ndarray) -> None:
        """near(i, j) of rows at positions `at`: each row that is still its own takes later ones that are."""
        for i in np.flatnonzero(near.any(1)):
            if rep[at[i]] == at[i]:
                own = at[near[i]]
                rep[own[rep[own] == own]] = at[i]

    def by_size(wide: pa.Array):
        """(positions, matrix) of the vectors of each length."""
        if matrix is not None:
            yield np.arange(len(wide)), matrix(wide.to_pylist())
            return
        long = np.array(pc.fill_null(pc.list_value_length(wide), 0))
        for size in set(long.tolist()) - {0}:
            at = np.flatnonzero(long == size)
            yield at, wide.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)

    def merged(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        rep = np.arange(table.num_rows)
        for at, m in by_size(table.column("_v").combine_chunks()):
            m, ends = _unit(m), np.searchsorted(at, cuts).tolist()
            for a, b in zip(ends, ends[1:]):
                if b - a > 1:
                    settle(np.triu(m[a:b] @ m[a:b].T >= at_least, 1), at[a:b], rep)
        out = table.drop_columns("_v").combine_chunks()
        columns = [c.combine_chunks() for c in out.columns]
        return pa.RecordBatch.from_arrays([*columns, out.column(key).combine_chunks().take(pa.array(rep))], names=[*out.column_names, "representative"])

    def run(batches):
        held = None  # the last group waits for the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            code = table.column(group).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()]
            if edges[-1]:
                yield merged(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield merged(held, [0, held.num_rows])

    return dealt.mapInArrow(run, kind)


def greedy_merge(vectors: DataFrame, at_least: float, group: str, key: str = "id", vector: str | Column = "vector", block: int = 1024,
                 made: tuple[Column, Callable[[list], np.ndarray]] | None = None) -> DataFrame:
    """(group, key, ..., representative), with the other columns but the vector: in key order, a row that no earlier
    representative is similar to becomes one, and any other joins its earliest similar representative. A vector that is a
    column function is computed where groups meet, so that vectors are not shuffled; with made(column, function) the function
    makes the same vectors there of a list of the column's values, so that they do not pass through Spark at all.

    Groups of at most `block` rows, of which there may be as many as books, are settled inside the tasks that they are dealt
    to. Of larger ones only similar pairs take part, and a pair is written once. In each round the rows that no open pair
    joins to an earlier one are settled as representatives, and all rows that they are similar to leave with their pairs; so
    pairs only become fewer, and nothing is read again. Where keys say nothing about similarity the rounds grow with the
    logarithm of the rows; a chain in which each row is similar to the next one only takes a round for every two of its rows."""
    rounds = Rounds(vectors.sparkSession, "merge")
    value = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>").alias("_v")
    kept = [group, key, *[c for c in vectors.columns if c not in (group, key, vector if isinstance(vector, str) else None)]]
    seed, matrix = (made[0].alias("_v"), made[1]) if made else (value, None)

    def settled(rows: DataFrame) -> DataFrame:
        return _merged_blocks(rows.repartition(group).sortWithinPartitions(group, key).select(*kept, seed), at_least, group, key, matrix)
    large = rounds.save(vectors.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("_g"), "large")
    number = large.count()
    if not number:
        return settled(vectors)
    large = F.broadcast(large) if number <= LISTED else large
    of_large = F.col(group).eqNullSafe(F.col("_g"))
    rows = rounds.save(vectors.join(large, of_large, "left_semi").select(*kept, value), "rows")
    return settled(vectors.join(large, of_large, "left_anti")).unionByName(_merged_rounds(rows, rounds, at_least, group, key, block))


def _merged_rounds(rows: DataFrame, rounds: Rounds, at_least: float, group: str, key: str, block: int) -> DataFrame:
    """The rows of rows(group, key, ..., _v) with their representative in place of _v, by rounds over similar pairs."""
    pairs = rounds.save(similar_pairs(rows, at_least, group, key, "_v", block).select("a", "b"), "pairs")
    open_, joined, n = pairs, [], 0
    while not open_.isEmpty():
        heads = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = rounds.save(open_.join(heads, "a", "left_semi").select("b").distinct(), f"joined{n}")
        joined.append(gone)
        open_ = rounds.save(open_.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti"), f"open{n}")
        if n:
            rounds.drop(f"open{n - 1}")
        n += 1
    rows = rows.drop("_v")
    if not joined:
        return rows.withColumn("representative", F.col(key))
    every = reduce(DataFrame.unionByName, joined)
    first = pairs.join(every, "b", "left_semi").join(every.select(F.col("b").alias("a")), "a", "left_anti").groupBy(F.col("b").alias(key)).agg(F.min("a").alias("representative"))
    return rows.join(first, key, "left").select(*rows.columns, F.coalesce("representative", key).alias("representative"))
