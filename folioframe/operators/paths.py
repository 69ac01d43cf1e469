"""Ways to the root in forests of any depth, by pointer doubling.

Each round every node looks up what its furthest known ancestor knows, so that it knows twice as many steps of its way: a
tree of depth n takes log2(n) rounds. A round is a written table in the shared folder, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.sources.files import Rounds


class _Rounds(Rounds):
    """Of the tables only the last stays."""
    n = 0

    def next(self, df: DataFrame) -> DataFrame:
        found = self.save(df, str(self.n))
        if self.n:
            self.drop(str(self.n - 1))
        self.n += 1
        return found


def reached(links: DataFrame) -> DataFrame:
    """(id, looped) for links(id, up, ...), up being null for roots: the nodes that have a root above, and those on or below
    a cycle, looped. Nodes whose way up ends at an id that is not there are left out."""
    rounds = _Rounds(links.sparkSession, "paths")
    now = rounds.next(links.select("id", F.col("up").alias("to")))
    open_ = now.filter("to is not null").count()
    while open_:
        up = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        now = rounds.next(now.filter("to is null").unionByName(now.filter("to is not null").join(up, "to").select("id", F.col("next").alias("to"))))
        left = now.filter("to is not null").count()
        if left == open_:  # of finite ways the shortest would have ended
            break
        open_ = left
    return now.select("id", F.col("to").isNotNull().alias("looped"))


def root_paths(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, path) of the nodes of links(id, up, step) that have a root above: the steps from the root down, joined by dots.
    known is what reached() gives for the links, where the caller has it."""
    rounds = _Rounds(links.sparkSession, "paths")
    fine = (reached(links) if known is None else known).filter("not looped").select("id")
    now = rounds.next(links.join(fine, "id").select("id", F.col("up").alias("to"), F.col("step").alias("path")))
    while not now.filter("to is not null").isEmpty():
        up = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("path").alias("above"))
        further = now.filter("to is not null").join(up, "to").select("id", F.col("next").alias("to"), F.concat_ws(".", "above", "path").alias("path"))
        now = rounds.next(now.filter("to is null").unionByName(further))
    return now.select("id", "path")
