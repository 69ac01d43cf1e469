"""Chat formatting by cumulative-snapshot collapse.

A logged conversation is often written again after every turn. Rolling turn-prefix hashes find each log that is a
prefix of a longer one; an anti-join keeps the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import table

#: Markers around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """One row for each different turn with its position from 1; null role and text count as empty. k tells rows without
    conv_id apart, each a conversation of its own."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct().withColumn("k", F.when(F.col("conv_id").isNull(), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)).otherwise(""))
    order = Window.partitionBy("conv_id", "k").orderBy("turn", "role", "text")
    return turns.withColumn("pos", F.row_number().over(order))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, pos, a, b, is_last): two 64-bit hashes of the turns 1..pos of each conversation.

    A turn's hash covers its position, so xor over the turns is a rolling hash of the sequence that needs no
    buffering: the running frame is one pass over rows that are already sorted."""
    turns = _turns(conversations).select(
        "conv_id", "k", "turn", "role", "text", "pos",
        F.xxhash64("pos", "role", "text").alias("x"), F.xxhash64(F.lit("b"), "text", "role", "pos").alias("y"))
    order = Window.partitionBy("conv_id", "k").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select(
        "conv_id", "k", "pos", F.expr("bit_xor(x)").over(running).alias("a"), F.expr("bit_xor(y)").over(running).alias("b"),
        F.lead("pos").over(order).isNull().alias("is_last"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, n_turns, n_copies) of each conversation that no longer one begins with.

    Identical logs are one conversation: the smallest conv_id, null the last, stands for them and n_copies counts them. Prefixes are
    aggregated before the join, so a first turn that many logs share is one row on either side."""
    hashed = prefix_hashes(conversations)
    whole = hashed.filter("is_last").groupBy("pos", "a", "b").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "k")).alias("first"), F.count("*").alias("n_copies"))
    longer = hashed.filter("not is_last").select("pos", "a", "b").distinct()
    return whole.join(longer, ["pos", "a", "b"], "left_anti").select(
        "first.conv_id", "first.k", F.col("pos").alias("n_turns"), "n_copies")


def render(turns: Column) -> Column:
    """The marked-up text of an array of (pos, role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): one row for each maximal conversation, rendered.

    Defined cases: null role or text is the empty string; turns are ordered by (turn, role, text), nulls first;
    a turn row that is repeated in a conversation counts once; a row with null conv_id is a conversation of one turn,
    equal ones of which are one row; an empty table gives no rows; other columns are ignored."""
    kept = maximal_conversations(conversations)
    turns = _turns(conversations).select(F.col("conv_id").alias("of"), F.col("k").alias("by"), F.struct("pos", "role", "text").alias("t"))
    kept = kept.join(turns, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("by")))
    return kept.groupBy("conv_id", "k", "n_turns", "n_copies").agg(
        render(F.sort_array(F.collect_list("t"))).alias("chat")).drop("k")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
with d as (select distinct conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text,
  case when conv_id is null then coalesce(turn::varchar, '-') || chr(1) || coalesce(role, '') || chr(1) || coalesce(text, '') else '' end k from conversations),
t as (select *, cast(row_number() over (partition by conv_id, k order by turn nulls first, role, text) as integer) pos from d),
f as (select conv_id, k, cast(max(pos) as integer) n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) chat
  from t group by conv_id, k),
g as (select min(conv_id) conv_id, n_turns, count(*) n_copies, chat from f group by n_turns, chat),
p as (select string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
  over (partition by conv_id, k order by pos rows between unbounded preceding and current row) chat, conv_id, k, pos from t),
q as (select distinct p.pos, p.chat from p join f on p.conv_id is not distinct from f.conv_id and p.k = f.k where p.pos < f.n_turns)
select conv_id, n_turns, n_copies, chat from g
where not exists (select 1 from q where q.pos = g.n_turns and q.chat = g.chat)
"""
