"""A stored vector index: vectors in cells around centres, searched exactly for many queries at once.

Every row lies in the cell of its nearest centre, one partition of a table; a small table has each cell's centre, radius and
number of rows. A query first looks into the cells nearest to it until they hold k rows; the k-th distance found there rules
out each cell whose centre is further away than that distance and the cell's radius together. Queries and rows meet by
cell, a block of each at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.operators.tables import last_of, without
from folioframe.sources.files import Rounds, remove

#: Most cells (their centres are held by the driver and each task), and rows of a block of vectors and of queries.
CELLS, BLOCK, QUERIES = 4096, 4096, 1024


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _squares(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The squared distances of each row to one point, from the differences: equal rows have equal distances."""
    return ((rows - to) ** 2).sum(1)


class VectorIndex:
    """An index below `path` of rows with a unique key, a vector and columns that searches may filter by. One writer at a time.

    Defined cases: rows whose vector is null, empty, of another length than the first one's, or has null or non-finite
    components are not indexed, and such queries have no results; of rows with one key in a batch the last counts;
    an index without rows gives no results; a batch of no rows changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", vector: str = "vector"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    # ------------------------------------------------------------ writing

    def build(self, rows: DataFrame, cells: int | None = None) -> None:
        """Write the index anew. The centres are rows chosen by a hash of their keys, one for each of about sqrt(n) cells."""
        rows = self._fit(last_of(rows, [self.key]))
        n = rows.count()
        cells = min(CELLS, cells or max(1, round(n ** 0.5)))
        centers = rows.select(self.vector).orderBy(F.xxhash64(self.key), self.key).limit(cells)
        self._write_centers(np.unique(_matrix(pa.array([r[0] for r in centers.collect()])), axis=0) if n else np.zeros((0, 0)))
        rounds = Rounds(self.spark, "vectors")
        placed = rounds.save(self._placed(rows), "placed")
        self._put(placed, "overwrite")
        self._describe(placed, None)
        rounds.close()

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in place of those with their keys. Only the cells that lose or gain a row are written."""
        rows = last_of(rows, [self.key])
        self._change(rows.select(self.key), self._fit(rows).select(*self.rows().drop("cell", "reach").columns))

    def delete(self, keys: DataFrame) -> None:
        """Take out the rows with these keys."""
        self._change(keys.select(self.key), None)

    def _change(self, keys: DataFrame, new: DataFrame | None) -> None:
        rounds, now = Rounds(self.spark, "vectors"), self.rows()
        placed = rounds.save(self._placed(new), "placed") if new is not None else None
        keys = rounds.save(keys.distinct(), "keys")
        old = now.select(self.key, "cell").join(keys, self.key, "left_semi").select("cell")  # reads keys and cells only
        touched = sorted(r.cell for r in (old if placed is None else old.unionByName(placed.select("cell"))).distinct().collect())  # at most CELLS
        if touched:
            left = without(now.filter(F.col("cell").isin(touched)), keys, [self.key])
            after = rounds.save(left if placed is None else left.unionByName(placed.select(*left.columns)), "after")
            full = {r.cell for r in after.select("cell").distinct().collect()}
            self._put(after, "dynamic")
            for cell in set(touched) - full:
                remove(self.spark, f"{self.path}/rows/cell={cell}")
            self._describe(after, touched)
        rounds.close()

    def _fit(self, rows: DataFrame, size: int | None = None) -> DataFrame:
        """The rows whose vectors can be compared."""
        v = F.col(self.vector)
        whole = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        if size is None:
            centers = self._centers()
            first = None if centers is not None and len(centers) else whole.select(F.size(v)).orderBy(F.xxhash64(self.key), self.key).first()
            size = centers.shape[1] if centers is not None and len(centers) else first[0] if first else 0
        return whole.filter(F.size(v) == size)

    def _write_centers(self, centers: np.ndarray) -> None:
        remove(self.spark, f"{self.path}/rows")
        remove(self.spark, f"{self.path}/about")
        rows = [(i, c.tolist()) for i, c in enumerate(centers)]
        self.spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")

    def _centers(self) -> np.ndarray | None:
        try:
            found = self.spark.read.schema("cell int, center array<double>").parquet(f"{self.path}/centers").orderBy("cell").collect()  # at most CELLS
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return np.array([r.center for r in found]).reshape(len(found), -1)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with their cell and their distance to its centre."""
        centers, at = self._centers(), rows.columns.index(self.vector)
        norms = (centers ** 2).sum(1)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    m = _matrix(batch.column(at))
                    cell = (norms - 2 * (m @ centers.T)).argmin(1)
                    reach = np.sqrt(((m - centers[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "reach", "cell"])

        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(place, f"{kinds}, reach double, cell int")

    def _put(self, rows: DataFrame, mode: str) -> None:
        """Write cells, a large one in several files."""
        dealt = rows.repartition(F.col("cell"), F.pmod(F.xxhash64(self.key), F.lit(4))).sortWithinPartitions("cell", self.key)
        writer = dealt.write.mode("overwrite").partitionBy("cell")
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "dynamic" else writer).parquet(f"{self.path}/rows")

    def _describe(self, rows: DataFrame, touched: list[int] | None) -> None:
        """Write (cell, radius, n) anew for the touched cells, or all."""
        new = {r.cell: (float(r.radius), r.n) for r in rows.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()}
        if touched is not None:
            new |= {cell: x for cell, x in self._about().items() if cell not in touched}
        self.spark.createDataFrame([(c, *x) for c, x in new.items()], "cell int, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")

    def _about(self) -> dict[int, tuple[float, int]]:
        return {r.cell: (r.radius, r.n) for r in self.spark.read.schema("cell int, radius double, n long").parquet(f"{self.path}/about").collect()}

    # ------------------------------------------------------------ reading

    def rows(self) -> DataFrame:
        """The indexed rows with their cell and its distance."""
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").withColumn("cell", F.col("cell").cast("int"))

    def nearest(self, queries: DataFrame, k: int, query_key: str = "query", query_vector: str = "vector", **equal) -> DataFrame:
        """(query_key, rank, key, distance, score, cells): the k nearest rows of each query by squared distance, ties by key,
        with score = 1 - distance and the number of cells that the query was compared with. Equalities on columns filter
        before the limit. Queries need a unique key."""
        q = queries.select(F.col(query_key).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v"))
        kind = dict(q.dtypes)["_q"]
        key_kind = next((t for n, t in self.rows().dtypes if n == self.key), "long") if self._about_or_none() else "long"
        about = self._about_or_none()
        if not about:
            return q.filter("false").select(F.col("_q").alias(query_key), F.lit(0).alias("rank"), F.lit(None).cast(key_kind).alias(self.key), F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("cells"))
        centers, rounds = self._centers(), Rounds(self.spark, "nearest")
        cells = np.array(sorted(about))
        radius, number = (np.array([about[c][i] for c in cells]) for i in range(2))
        whole = q.filter(F.col("_v").isNotNull() & (F.size("_v") == centers.shape[1]) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

        def to_cells(bounded: bool):
            """(query, vector, cell) for the nearest cells of each query, or for all others that its bound leaves."""
            def run(batches):
                for batch in batches:
                    for i in range(0, batch.num_rows, 256):
                        part = batch.slice(i, 256)
                        m = _matrix(part.column(1))
                        to = np.sqrt(np.maximum(((m[:, None, :] - centers[cells][None]) ** 2).sum(2), 0)) if len(cells) * m.size < 1 << 24 else np.stack([np.sqrt(_squares(centers[cells], x)) for x in m])
                        order = np.argsort(to, 1, kind="stable")
                        first = (np.cumsum(number[order], 1) - number[order] < k)  # until the cells before hold k rows
                        near = np.zeros(to.shape, bool)
                        np.put_along_axis(near, order, first, 1)
                        if bounded:
                            bound = np.array([np.inf if b is None else b for b in part.column(2).to_pylist()])
                            near = ~near & (to - radius[None] <= np.sqrt(bound)[:, None] * (1 + 1e-9) + 1e-9)
                        row, at = np.nonzero(near)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cells[at].astype(np.int32))], names=["_q", "_v", "cell"])
            return run

        rows = self.rows()
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == F.lit(value))
        vectors = rows.select(F.col(self.key).alias("_k"), F.col(self.vector).cast("array<double>").alias("_x"), "cell")
        parts = {c: -(-n // BLOCK) for c, (_, n) in about.items()}
        part_of = F.coalesce(F.get(F.array(*[F.lit(parts.get(c, 1)) for c in range(max(parts) + 1)]), F.col("cell")), F.lit(1))

        def search(pairs: DataFrame) -> DataFrame:
            """(_q, _k, d): the k nearest of each query in each block of the cells it is sent to."""
            blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / QUERIES)).cast("int")
            sent = pairs.join(pairs.groupBy("cell").agg(blocks.alias("_blocks")), "cell")
            left = sent.select("_q", "_v", "cell", F.pmod(F.xxhash64("_q"), "_blocks").cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), part_of - 1)).alias("_part"))
            dealt = vectors.join(F.broadcast(sent.select("cell", "_blocks").distinct()), "cell")  # at most CELLS rows
            right = dealt.select("_k", "_x", "cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_qb"), F.pmod(F.xxhash64("_k"), part_of).cast("int").alias("_part"))

            def meet(a: pa.Table, b: pa.Table) -> pa.Table:
                out: list[list] = [[], [], []]
                if a.num_rows and b.num_rows:
                    qs, ks, m = a.column("_q").to_pylist(), b.column("_k").to_pylist(), _matrix(b.column("_x").combine_chunks())
                    for name, v in zip(qs, _matrix(a.column("_v").combine_chunks())):
                        d = _squares(m, v)
                        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                        for i in sorted(at.tolist(), key=lambda i: (d[i], ks[i]))[:k]:
                            for column, value in zip(out, (name, ks[i], float(d[i]))):
                                column.append(value)
                return pa.table({"_q": pa.array(out[0], a.schema.field("_q").type), "_k": pa.array(out[1], b.schema.field("_k").type), "d": pa.array(out[2], pa.float64())})

            by = ["cell", "_qb", "_part"]
            return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"_q {kind}, _k {key_kind}, d double")

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("d", "_k"))).filter(F.col("rank") <= k)

        schema = f"_q {kind}, _v array<double>, cell int"
        near = rounds.save(whole.mapInArrow(to_cells(False), schema), "near")
        first = rounds.save(search(near), "first")
        bound = best(first).filter(F.col("rank") == k).select("_q", F.col("d").alias("_bound"))
        far = rounds.save(whole.join(bound, "_q", "left").select("_q", "_v", "_bound").mapInArrow(to_cells(True), schema), "far")
        second = rounds.save(search(far), "second")
        seen = near.select("_q").unionByName(far.select("_q")).groupBy("_q").agg(F.count("*").alias("cells"))
        found = best(first.unionByName(second)).join(seen, "_q")
        return found.select(F.col("_q").alias(query_key), "rank", F.col("_k").alias(self.key), F.col("d").alias("distance"), (1 - F.col("d")).alias("score"), "cells")

    def _about_or_none(self) -> dict:
        try:
            return self._about()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def search(self, query: list[float], k: int, **equal) -> DataFrame:
        """The k nearest rows of one query, as nearest() has them."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query int, vector array<double>")
        return self.nearest(one, k, **equal).drop("query").orderBy("rank")
