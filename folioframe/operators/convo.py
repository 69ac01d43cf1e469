"""Conversations: message logs, pruning, truncation to a budget, compaction and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalars import gen_id
from folioframe.operators.tables import merge_maps, upsert
from folioframe.operators.text import estimate_tokens

#: Defaults of the message store.
CONVERSATIONS, MESSAGES, KEPT, SHARE = 100, 500, 20, 0.8


def counts(messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    return messages.groupBy(conversation).agg(F.count("*").alias("message_count"))


def newest(conversations: DataFrame, limit: int, offset: int = 0, updated: str = "updated_at", key: str = "conv_id") -> DataFrame:
    """A page of conversations, the last updated first."""
    return conversations.orderBy(F.desc(updated), key).offset(offset).limit(limit)


def excess(conversations: DataFrame, keep: int = CONVERSATIONS, updated: str = "updated_at", key: str = "conv_id") -> DataFrame:
    """The conversations beyond the newest `keep`: all less a top-k, which no task sorts whole."""
    return conversations.join(F.broadcast(newest(conversations, keep, 0, updated, key).select(key)), key, "left_anti")


def messages_of(messages: DataFrame, conv_id, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.filter(F.col(conversation) == conv_id).orderBy(order)


def decodable(messages: DataFrame, column: str = "payload") -> DataFrame:
    """Messages whose payload is JSON."""
    return messages.filter(F.try_parse_json(column).isNotNull())


def prune(messages: DataFrame, most: int = MESSAGES, conversation: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Each conversation without its oldest messages beyond `most`; system messages stay."""
    whole = Window.partitionBy(conversation)
    loose = F.col(role) != "system"
    rank = F.sum(loose.cast("int")).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    excess_ = F.least(F.count("*").over(whole) - most, F.sum(loose.cast("int")).over(whole))
    return messages.withColumn("_rank", rank).withColumn("_excess", excess_).filter(~loose | (F.col("_rank") > F.col("_excess"))).drop("_rank", "_excess")


def truncate(messages: DataFrame, budget: int, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation's system messages and the newest others whose tokens fit the budget with them; position
    counts the system messages first."""
    whole = Window.partitionBy(conversation)
    system = F.col(role) == "system"
    rows = messages.withColumn("_tokens", estimate_tokens(F.coalesce(F.col(text), F.lit(""))))
    later = F.sum(F.when(~system, F.col("_tokens")).otherwise(0)).over(whole.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_later", later).withColumn("_system", F.sum(F.when(system, F.col("_tokens")).otherwise(0)).over(whole))
    kept = rows.filter(system | (F.col("_system") + F.col("_later") <= budget))
    return kept.withColumn("position", F.row_number().over(whole.orderBy((~system).cast("int"), order)) - 1).drop("_tokens", "_later", "_system")


def over_budget(messages: DataFrame, budget: int, conversation: str = "conv_id", text: str = "text") -> DataFrame:
    """(conversation, tokens) of those over the budget."""
    return messages.groupBy(conversation).agg(F.sum(estimate_tokens(F.coalesce(F.col(text), F.lit("")))).alias("tokens")).filter(F.col("tokens") > budget)


def compact_split(messages: DataFrame, budget: int, share: float = SHARE, keep: int = KEPT, conversation: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """messages with part: "old" for those before the last `keep` in conversations over share of the budget, which are
    to be summarised, else "recent"."""
    whole = Window.partitionBy(conversation)
    tokens = F.sum(estimate_tokens(F.coalesce(F.col(text), F.lit("")))).over(whole)
    back = F.row_number().over(whole.orderBy(F.desc(order)))
    return messages.withColumn("part", F.when((tokens > share * budget) & (back > keep), "old").otherwise("recent"))


def compact(messages: DataFrame, summarise, budget: int, **options) -> DataFrame:
    """(conv_id, turn, role, text) with the old part of each long conversation as one system summary before the rest."""
    parts = compact_split(messages, budget, **options)
    old = parts.filter("part = 'old'").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"]), "\n").alias("all"))
    summary = old.select("conv_id", "turn", F.lit("system").alias("role"), summarise(F.col("all")).alias("text"))
    return summary.unionByName(parts.filter("part = 'recent'").select("conv_id", "turn", "role", "text"))


def delete_message(conversations: DataFrame, messages: DataFrame, message_id: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) without the message, its conversation's count one lower but not below 0."""
    hit = messages.filter(F.col("id") == message_id).select("conv_id", F.lit(1).alias("_gone"))
    left = conversations.join(F.broadcast(hit), "conv_id", "left").withColumn("message_count", F.greatest(F.lit(0), F.col("message_count") - F.coalesce("_gone", F.lit(0)))).drop("_gone")
    return left, messages.filter(F.col("id") != message_id)


def sessions(table: DataFrame, book_id=None, active: bool = False) -> DataFrame:
    """Sessions, the last updated first."""
    rows = table if book_id is None else table.filter(F.col("book_id") == book_id)
    return (rows.filter("status = 'active'") if active else rows).orderBy(F.desc("updated_at"), "session_id")


def after_turn(table: DataFrame, session_id: str, now: float) -> DataFrame:
    at = F.col("session_id") == session_id
    return table.withColumn("turn_count", F.when(at, F.col("turn_count") + 1).otherwise(F.col("turn_count"))).withColumn(
        "updated_at", F.when(at, F.lit(now)).otherwise(F.col("updated_at")))


def rename(table: DataFrame, session_id: str, name: str, now: float) -> DataFrame:
    at = F.col("session_id") == session_id
    return table.withColumn("name", F.when(at, F.lit(name)).otherwise(F.col("name"))).withColumn("updated_at", F.when(at, F.lit(now)).otherwise(F.col("updated_at")))


def archive(table: DataFrame, session_id: str) -> DataFrame:
    return table.withColumn("status", F.when(F.col("session_id") == session_id, "archived").otherwise(F.col("status")))


def latest_session(table: DataFrame) -> DataFrame:
    """The last updated session of each (conversation_id, book_id)."""
    from folioframe.operators.tables import latest

    return latest(table, ["conversation_id", "book_id"], [F.desc("updated_at"), F.desc("session_id")])


def after_turns(table: DataFrame, turns: DataFrame) -> DataFrame:
    """Reading sessions(session_id, turn_count, updated_at, last_user_input, last_agent_response, extra, ...) after
    turns(session_id, turn, at, user_input, response_text, extra): the count goes up by the turns, the inputs and times
    are those of the last one, and each key of extra has its last value. Turns of unknown sessions change nothing."""
    last = turns.groupBy("session_id").agg(F.count("*").alias("_turns"), F.max_by(F.struct("at", "user_input", "response_text"), "turn").alias("_last"))
    extras = turns.select("session_id", "turn", F.explode("extra")).groupBy("session_id", "key").agg(F.max_by("value", "turn").alias("value")).groupBy("session_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_extra"))
    met = F.col("_turns").isNotNull()
    new = {"turn_count": F.col("turn_count") + F.coalesce("_turns", F.lit(0)), "extra": F.when(F.col("_extra").isNull(), F.col("extra")).otherwise(merge_maps(F.col("extra"), F.col("_extra")))}
    new |= {name: F.when(met, F.col(f"_last.{of}")).otherwise(F.col(name)) for name, of in (("updated_at", "at"), ("last_user_input", "user_input"), ("last_agent_response", "response_text"))}
    return table.join(last, "session_id", "left").join(extras, "session_id", "left").withColumns(new).select(*table.columns)


def run_rows(runs: DataFrame, now: float) -> DataFrame:
    """Rows of the run log, to be appended: runs(session_id, turn, tool_calls, usage, extra, ...) with an id of their
    own and the last three as JSON, empty where they are null."""
    empty = {"tool_calls": "[]", "usage": "{}", "extra": "{}"}
    return runs.select(gen_id(F.col("session_id"), F.col("turn"), prefix="run_").alias("run_id"), *[c for c in runs.columns if c not in empty],
                       *[F.coalesce(F.to_json(c), F.lit(e)).alias(f"{c}_json") for c, e in empty.items()], F.lit(now).alias("created_at"))


def save_checkpoints(table: DataFrame, states: DataFrame, now: float) -> DataFrame:
    """table(checkpoint_id, mode_name, state_data, phase, active_agent, created_at) with a checkpoint of each different
    row of states(mode_name, state), a struct with phase and active_agent; one of the same mode, state and time is replaced."""
    data = F.to_json("state")
    rows = states.select(gen_id(F.col("mode_name"), data, F.lit(now), prefix="ckpt_").alias("checkpoint_id"), "mode_name", data.alias("state_data"), "state.phase", "state.active_agent", F.lit(now).alias("created_at"))
    return upsert(table, rows.dropDuplicates(["checkpoint_id"]).select(*table.columns), ["checkpoint_id"])


def load_checkpoint(table: DataFrame, checkpoint_id: str, schema: str) -> DataFrame:
    """The state of a checkpoint, one row of the schema; an unknown one is an error."""
    found = table.filter(F.col("checkpoint_id") == checkpoint_id)
    if found.isEmpty():
        raise KeyError(checkpoint_id)
    return found.select(F.from_json("state_data", schema).alias("state")).select("state.*")


def checkpoints(table: DataFrame) -> DataFrame:
    """Checkpoints without their states, the newest first."""
    return table.select("checkpoint_id", "mode_name", "created_at", "phase", "active_agent").orderBy(F.desc("created_at"), "checkpoint_id")


def files(table: DataFrame, category: str | None = None, mime: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Uploaded files of a category or with a MIME prefix, the newest first."""
    if category:
        table = table.filter(F.col("category") == category)
    if mime:
        table = table.filter(F.col("mime_type").startswith(mime))
    return table.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def file_rows(uploads: DataFrame) -> DataFrame:
    """uploads with their category and size."""
    return uploads.withColumn("category", F.when(F.col("mime_type").startswith("image/"), "image").otherwise("document")).withColumn("size", F.octet_length("content"))
