"""A stored full-text index of several columns that is kept in step with its documents.

The index is a set of segments that are never changed: the postings of one write in the order of their tokens, in ranges,
beside a list of the groups (books) it holds. A group's postings are those of its last segment, so adding, replacing and
deleting books writes one small segment and reads nothing; merge() writes what is left of all segments into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import fts
from folioframe.sources.files import remove

#: Groups that may be broadcast to leave out what was replaced.
BROADCAST = 1 << 18


class TextIndex:
    """An index below `path` of documents with a key, a group and text columns. One writer at a time; readers see the
    segments that were complete when they asked.

    Defined cases: null texts have no tokens; a null group is a group like others; keys should be in one group only; a
    group in a write without texts counts as replaced; a search of an index without segments finds nothing."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "chunk_id", group: str = "book_id", kinds: str = "string"):
        self.spark, self.path, self.columns, self.key, self.group = spark, path.rstrip("/"), list(columns), key, group
        self.schema = f"token string, `{group}` {kinds.split()[-1]}, `{key}` {kinds.split()[0]}, place long"
        self._kind = kinds.split()[-1]

    def _groups(self) -> DataFrame | None:
        """(group, segment, last): every group of every segment, and whether that is the group's last one."""
        try:
            rows = self.spark.read.schema(f"`{self.group}` {self._kind}, segment string").parquet(f"{self.path}/groups")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        last = rows.groupBy(F.col(self.group).alias("_group")).agg(F.max("segment").alias("_last"))
        return rows.join(last, F.col(self.group).eqNullSafe(F.col("_group"))).select(self.group, "segment", (F.col("segment") == F.col("_last")).alias("last"))

    def _next(self) -> str:
        """A segment's name, after all others in their order."""
        known = self._groups()
        number = 0 if known is None else int(known.agg(F.max(F.substring("segment", 1, 12))).first()[0] or 0)
        return f"{number + 1:012d}-{uuid.uuid4().hex}"

    def _write(self, postings: DataFrame, groups: DataFrame, segment: str) -> None:
        """The postings first: a segment counts as soon as its groups are there."""
        by = ["token", self.group, self.key]
        postings.select(*by, "place").repartitionByRange(*by).sortWithinPartitions(*by, "place").write.option(
            "parquet.block.size", str(8 << 20)).mode("overwrite").parquet(f"{self.path}/postings/segment={segment}")
        groups.select(self.group).distinct().write.mode("overwrite").parquet(f"{self.path}/groups/segment={segment}")

    def put(self, docs: DataFrame) -> None:
        """Add the documents; groups that are there already have these documents only from now on."""
        segment = self._next()
        self._write(fts.postings(docs, [self.group, self.key], self.columns), docs, segment)

    def delete(self, groups: DataFrame) -> None:
        """Take out the documents of the groups; groups that are not there do not matter."""
        segment = self._next()
        self._write(self.spark.createDataFrame([], self.schema), groups, segment)

    def postings(self) -> DataFrame:
        """(token, group, key, place) of what is in the index now. Token filters reach the files."""
        known = self._groups()
        if known is None:
            return self.spark.createDataFrame([], self.schema)
        complete = [r.segment for r in known.select("segment").distinct().collect()]  # one for each write since the last merge
        rows = self.spark.read.schema(self.schema + ", segment string").parquet(f"{self.path}/postings").filter(F.col("segment").isin(complete))
        old = known.filter("not last").select(F.col(self.group).alias("_group"), F.col("segment").alias("_segment"))
        n = old.count()
        if not n:
            return rows.drop("segment")
        old = F.broadcast(old) if n <= BROADCAST else old
        return rows.join(old, F.col(self.group).eqNullSafe(F.col("_group")) & (F.col("segment") == F.col("_segment")), "left_anti").drop("segment")

    def search(self, query: str) -> DataFrame:
        """The keys of the documents that match, each once; columns are called by their names."""
        return fts.search(self.postings(), self.key, query, tuple(self.columns))

    def search_documents(self, docs: DataFrame, query: str, limit: int, groups: list | None = None) -> DataFrame:
        """The first `limit` matching rows of docs by key; the group filter comes before the limit."""
        if groups is not None:
            docs = docs.filter(F.col(self.group).isin(groups))
        return docs.join(self.search(query), self.key, "left_semi").orderBy(self.key).limit(limit)

    def segments(self) -> DataFrame:
        """(segment, groups, live): the groups of each segment and how many of them have no later one."""
        known = self._groups()
        if known is None:
            return self.spark.createDataFrame([], "segment string, groups long, live long")
        return known.groupBy("segment").agg(F.count("*").alias("groups"), F.sum(F.col("last").cast("long")).alias("live"))

    def merge(self) -> None:
        """Write all that is left as one segment; the old ones are deleted after it is complete. Deleted groups leave no
        trace."""
        old = sorted(r.segment for r in self.segments().select("segment").collect())
        if len(old) < 2:
            return
        live, segment = self.postings(), self._next()
        self._write(live, live.select(self.group), segment)
        for name in old:  # from the oldest, so that nothing comes back; its groups first, without which its postings do not count
            for part in ("groups", "postings"):
                remove(self.spark, f"{self.path}/{part}/segment={name}")
