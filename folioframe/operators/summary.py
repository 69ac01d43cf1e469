"""Bottom-up tree summaries within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators.text import SUMMARY_TOKENS, estimate_tokens, paragraph_groups
from folioframe.sources.files import Rounds

#: Tokens of the budget that a prompt takes; fixed value.
OVERHEAD = 200


def within_budget(rows: DataFrame, summarise, text: str = "text", budget: int = SUMMARY_TOKENS, overhead: int = OVERHEAD) -> DataFrame:
    """rows with summary: of the text as it is if it fits the budget without the overhead; else of the joined summaries of
    its fragments, blank ones left out, or the only one that is not blank. A row without any has a blank summary."""
    room = max(1, budget - overhead)

    @F.udf("array<string>")
    def fragments(t):
        return paragraph_groups(t, -(-max(1, len(t) // 4) // room), room)

    small = estimate_tokens(F.col(text)) <= room
    keyed = rows.withColumn("_parts", F.when(small, F.array(text)).otherwise(fragments(F.col(text)))).withColumn("_row", F.monotonically_increasing_id())
    each = keyed.select("*", F.posexplode("_parts").alias("_i", "_part")).withColumn("_s", F.coalesce(summarise(F.col("_part")), F.lit("")))
    said = F.sort_array(F.collect_list(F.when(F.col("_s") != "", F.struct("_i", "_s"))))  # a fragment for each budget of tokens
    joined = each.groupBy(*rows.columns, "_row").agg(said.alias("_all"))
    lines = F.array_join(F.transform("_all", lambda x: x["_s"]), "\n\n")
    only = F.coalesce(F.get("_all", F.lit(0))["_s"], F.lit(""))
    return joined.withColumn("summary", F.when(F.size("_all") < 2, only).otherwise(F.coalesce(summarise(lines), F.lit("")))).select(*rows.columns, "summary")


def summarise_tree(nodes: DataFrame, content: DataFrame, summarise, budget: int = SUMMARY_TOKENS) -> DataFrame:
    """(book_id, node_id, summary), from each node's own text and a line "[title] summary" for each child that has a summary,
    in their order. Nodes with neither have no summary, and so have those for which the summariser has none to give.

    Levels are done from the deepest up, each as one join and one pass of the summariser over all books; each is a written
    table."""
    from folioframe.operators.tree import own_text

    saved = Rounds(nodes.sparkSession, "summaries").save
    bodies = saved(own_text(nodes, content).select("book_id", "id", "parent_id", "level", "order_index", "title", "body"), "bodies")
    deepest = bodies.agg(F.max("level")).first()[0]
    columns = ["book_id", "id", "parent_id", "order_index", "title"]
    done = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = bodies.filter(F.col("level") == level)
        below = F.lit(None).cast("string")
        if done is not None:
            line = F.struct("order_index", "id", F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), "summary").alias("line"))
            lines = done.groupBy("book_id", F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("below"))
            here, below = here.join(lines, ["book_id", "id"], "left"), F.col("below")
        text = F.concat_ws("\n\n", F.when(F.trim("body") != "", F.col("body")), below)
        here = within_budget(here.select(*columns, text.alias("text")).filter("text <> ''"), summarise, budget=budget).filter("summary <> ''")
        here = saved(here.select(*columns, "summary"), f"level{level}")
        done = here if done is None else done.unionByName(here)
    if done is None:
        return bodies.select("book_id", F.col("id").alias("node_id"), F.lit("").alias("summary"))
    return done.select("book_id", F.col("id").alias("node_id"), "summary")
