"""Queries over stored rows: point lookups, listings, and the tables after a write."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import cas, convo, fts, graph, lookups, progress, tables, tree, usage
from folioframe.plans import data_queries, model, tree_queries


def book_by_id(spark, d):
    return lookups.book(model.docs(spark, d).select(F.col("doc_id").alias("id"), "lang", "n_chars"), 5)


def node_by_id(spark, d):
    return tree.node_by_id(tree_queries.build_tree(spark, d), "3/1").select("id", "parent_id", "title", "content_offset")


def tree_children(spark, d):
    return tree.children(tree_queries.build_tree(spark, d), "3/0").select("id", "order_index", "title")


def tree_descendants(spark, d):
    return tree.descendants(tree.build_tree(model.books(spark, d)), "3/1").select("id", "path")


def index_rows(spark, d):
    return lookups.indexes(data_queries._manifest(spark, d), 4)


def built_types(spark, d):
    return lookups.built_types(data_queries._manifest(spark, d), 5)


def set_status(spark, d):
    return tables.set_status(data_queries._manifest(spark, d), 4, "graph", "built", 5.0)


def backfill(spark, d):
    books = model.docs(spark, d).select(F.col("doc_id").alias("id"))
    existing = books.select(F.col("id").alias("book_id"), F.get(F.array(F.lit("graph"), F.lit("summary")), (F.col("id") % 2).cast("int")).alias("index_type"))
    return tables.backfill(data_queries._manifest(spark, d), books, ["chunk", "graph", "summary"], existing, 3.0)


def entities_by_ids(spark, d):
    return graph.by_ids(model.entities(spark, d), ["p7", "nobody", "s1", "p3"]).select("id", "name")


def entities_named(spark, d):
    return lookups.entities_named(model.entities(spark, d), 1, "Supplier#000000003").select("id", "name")


def find_relations(spark, d):
    return graph.find_relations(model.edges(spark, d), "R", 20).select("id", "relation_type")


def upload_parts(spark, d):
    """Each conversation as a file that is uploaded turn by turn."""
    parts = model.messages(spark, d).select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("part"), F.col("text").cast("binary").alias("content"))
    return cas.hashed(cas.joined_parts(parts)).select("key", "content_hash", "size")


def _after(change, spark, d):
    index, blobs = change(model.files(spark, d), model.blobs(spark, d))
    return index.select("key").withColumn("kind", F.lit("key")).unionByName(blobs.select(F.col("content_hash").alias("key")).withColumn("kind", F.lit("blob")))


def delete_keys(spark, d):
    keys = [r[0] for r in model.files(spark, d).filter("key like '%/1.txt' or key like '%/2.txt'").select("key").collect()]  # two names
    return _after(lambda i, b: cas.delete(i, b, keys), spark, d)


def clear_prefix(spark, d):
    return _after(lambda i, b: cas.clear(i, b, "src1"), spark, d)


def copy_key(spark, d):
    files = model.files(spark, d)
    return cas.copy(files, files.filter("key like '%/1.txt'").first()["key"], "/copies/one").select("key", "content_hash")


def by_checksum(spark, d):
    files = model.files(spark, d)
    return cas.by_checksum(files, files.filter("key like '%/1.txt'").first()["content_hash"]).select("key")


def download(spark, d):
    return cas.download(model.files(spark, d), model.blobs(spark, d), verify=True).select("key", F.sha2("content", 256).alias("content_hash"))


def download_parts(spark, d):
    rows = cas.content_chunks(cas.download(model.files(spark, d), model.blobs(spark, d)), 1000)
    return rows.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.octet_length("content")).alias("most"), F.sum(F.octet_length("content")).alias("bytes"))


def search_keys(spark, d):
    return fts.search_keys(model.files(spark, d).select("key"), "src1 NOT en")


def search_keys_plain(spark, d):
    return fts.search_keys(model.files(spark, d).select("key"), "SRC1/", indexed=False)


def messages_of(spark, d):
    return convo.messages_of(model.messages(spark, d), 3).select("turn", "role", "text")


def _numbered_messages(spark, d):
    return model.messages(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def delete_message(spark, d):
    messages = _numbered_messages(spark, d)
    return convo.delete_message(convo.counts(messages), messages, 3001)[0]


def _sessions(spark, d):
    return model.docs(spark, d).select(F.concat(F.lit("s"), "doc_id").alias("session_id"), (F.col("doc_id") % 5).alias("book_id"), (F.col("doc_id") * 37 % 101).cast("double").alias("updated_at"),
                                       F.when(F.col("doc_id") % 3 == 0, "archived").otherwise("active").alias("status"), F.col("n_chars").alias("turn_count"), F.col("source").alias("name"))


def active_sessions(spark, d):
    return convo.sessions(_sessions(spark, d), 2, active=True).select("session_id", "updated_at")


def session_turn(spark, d):
    rows = convo.archive(convo.rename(convo.after_turn(_sessions(spark, d), "s7", 500.0), "s8", "new", 600.0), "s10")
    return rows.select("session_id", "updated_at", "status", "turn_count", "name")


def _turns(spark, d):
    """Each user message with the message after it."""
    rows = model.messages(spark, d)
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"), F.col("role").alias("by"))
    return rows.filter("role = 'user'").join(after, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), "turn", (F.col("turn") + 1).cast("double").alias("at"), F.col("text").alias("user_input"), F.coalesce("response", F.lit("")).alias("response_text"),
        F.create_map(F.lit("role"), F.coalesce("by", F.lit("none")), F.concat(F.lit("p"), F.col("turn") % 3), F.col("turn").cast("string")).alias("extra"))


def reading_turns(spark, d):
    kept = F.create_map(F.lit("role"), F.lit("?"), F.lit("kept"), F.col("conv_id").cast("string"))
    rows = model.messages(spark, d).select("conv_id").distinct().select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), (F.col("conv_id") % 4).alias("turn_count"), F.lit(0.0).alias("updated_at"), F.lit("").alias("last_user_input"), F.lit("").alias("last_agent_response"), kept.alias("extra"))
    return convo.after_turns(rows, _turns(spark, d)).withColumn("extra", F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


def run_log(spark, d):
    calls = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("find").alias("name"), F.col("turn").alias("turn"))))
    runs = _turns(spark, d).select("session_id", "turn", F.lit("reader").alias("agent_name"), "user_input", "response_text", calls.alias("tool_calls"),
                                   F.create_map(F.lit("chars"), F.length("user_input")).alias("usage"), F.create_map().cast("map<string,string>").alias("extra"))
    return convo.run_rows(runs, 5.0)


def _checkpoints(spark, d):
    states = model.docs(spark, d).select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("mode_name"), F.struct(
        F.col("lang").alias("phase"), F.col("source").alias("active_agent"), F.col("doc_id").alias("step")).alias("state"))
    none = spark.createDataFrame([], "checkpoint_id string, mode_name string, state_data string, phase string, active_agent string, created_at double")
    return convo.save_checkpoints(convo.save_checkpoints(none, states.filter("state.step % 2 = 0"), 1.0), states, 2.0)


def checkpoint_list(spark, d):
    return convo.checkpoints(_checkpoints(spark, d)).groupBy("mode_name", "created_at", "phase", "active_agent").agg(F.count_distinct("checkpoint_id").alias("n"))


def checkpoint_state(spark, d):
    rows = _checkpoints(spark, d)
    first = rows.filter("created_at = 1 and mode_name = 'm1' and get_json_object(state_data, '$.step') = '4'").first()
    return convo.load_checkpoint(rows, first.checkpoint_id, "phase string, active_agent string, step long")


def file_metadata(spark, d):
    meta = F.when(F.col("size") > 0, F.create_map(F.lit("bytes"), F.col("size").cast("string")))
    files = model.files(spark, d).withColumn("meta", meta)
    key = model.docs(spark, d).filter("doc_id = 5").select(F.concat_ws("/", "source", "lang", F.lit("5.txt"))).first()[0]
    return lookups.metadata(files, key).select("key", F.col("meta")["bytes"].alias("bytes"))


def uploaded_images(spark, d):
    mime = F.get(F.array(F.lit("image/png"), F.lit("text/plain"), F.lit("image/gif")), (F.col("doc_id") % 3).cast("int"))
    rows = model.docs(spark, d).select(F.col("doc_id").alias("id"), mime.alias("mime_type"), F.col("text").cast("binary").alias("content"), (F.col("doc_id") % 17).cast("double").alias("created_at"))
    return convo.files(convo.file_rows(rows), "image", "image/p", 10, 3).select("id", "category", "size")


def delete_books(spark, d):
    left = tables.cascade({"nodes": tree_queries.build_tree(spark, d).select("book_id"), "manifest": data_queries._manifest(spark, d).select("book_id")}, [1, 2])
    return left["nodes"].withColumn("kind", F.lit("node")).unionByName(left["manifest"].withColumn("kind", F.lit("manifest"))).groupBy("kind", "book_id").agg(F.count("*").alias("n"))


def replace_nodes(spark, d):
    nodes = tree_queries.build_tree(spark, d).select("id", "book_id", "title")
    new = model.docs(spark, d).filter("lang = 'en'").select(F.concat_ws("/", "doc_id", F.lit("new")).alias("id"), F.col("doc_id").alias("book_id"), F.lit("again").alias("title"))
    return tables.replace_group(nodes, new).select("id", "title")


def enumerated(spark, d):
    return progress.enumerated(model.messages(spark, d), "turn", "conv_id", 5).select("conv_id", "turn", "index")


def all_batches(spark, d):
    return progress.batched(model.docs(spark, d).select("doc_id"), "doc_id", 7)


def merge_extras(spark, d):
    left = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.col("lang"))
    right = F.create_map(F.lit("b"), F.lit("x"), F.lit("c"), F.col("lang"))
    return model.docs(spark, d).select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(tables.merge_maps(left, right))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("extras"))


def rolling_requests_30d(spark, d):
    return usage.rolling(model.usage(spark, d), "30d", ["mode"]).select("id", "requests")


def request_violations(spark, d):
    return usage.violations(model.usage(spark, d), "7d", ["mode"], "requests", 20).select("id", "requests")


def all_edges_in_graph(spark, d):
    """Edges under each of their ends."""
    return graph.incident(model.edges(spark, d)).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("other_id").alias("others"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_MANIFEST, _NODES = data_queries._MANIFEST, tree_queries._LINES
_SESSIONS = """s as (select 's' || doc_id session_id, doc_id % 5 book_id, (doc_id * 37 % 101)::double updated_at, case when doc_id % 3 = 0 then 'archived' else 'active' end status, n_chars turn_count, source as name from documents)"""
_TURNS = """turns as (select u.conv_id, u.turn, u.text user_input, coalesce(a.text, '') response_text, coalesce(a.role, 'none') answered
  from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user')"""
_KEPT = """select key, 'key' kind from files where {0} union all select content_hash, 'blob' from blobs where content_hash in (select content_hash from files where {0})"""

ORACLES = {
    "book_by_id": "select doc_id id, lang, n_chars from documents where doc_id = 5",
    "node_by_id": f"with {_NODES} select id, parent_id, title, content_offset::bigint content_offset from nodes where id = '3/1'",
    "tree_children": f"with {_NODES} select id, order_index, title from nodes where parent_id = '3/0'",
    "tree_descendants": f"with {_NODES} select p.id, p.path from paths p, paths t where t.id = '3/1' and p.book_id = t.book_id and starts_with(p.path, t.path || '.')",
    "index_rows": f"with {_MANIFEST} select * from m where book_id = 4",
    "built_types": f"with {_MANIFEST} select index_type from m where book_id = 5 and status = 'built'",
    "set_status": f"""with {_MANIFEST} select book_id, index_type, case when book_id = 4 and index_type = 'graph' then 'built' else status end status, "count", "error",
      case when book_id = 4 and index_type = 'graph' then 5.0::double else built_at end built_at, created_at from m""",
    "backfill": f"""with {_MANIFEST}, e as (select doc_id book_id, ['graph', 'summary'][doc_id % 2 + 1] index_type from documents)
      select * from m union all select book_id, index_type, 'built', 0, '', 3.0::double, 3.0::double from e anti join m using (book_id, index_type)""",
    "entities_by_ids": f"with {model.ENTITIES} select id, name from entities where id in ('p7', 's1', 'p3')",
    "entities_named": f"with {model.ENTITIES} select id, name from entities where name = 'Supplier#000000003'",
    "find_relations": f"with {model.EDGES} select id, relation_type from edges where contains(lower(summary), 'r') or contains(lower(relation_type), 'r') order by id limit 20",
    "upload_parts": "select conv_id::varchar as key, sha256(string_agg(text, '' order by turn)) content_hash, sum(octet_length(encode(text)))::bigint size from conversations group by 1",
    "delete_keys": f"with {model.FILES}, {model.BLOBS} " + _KEPT.format("key not like '%/1.txt' and key not like '%/2.txt'"),
    "clear_prefix": f"with {model.FILES}, {model.BLOBS} " + _KEPT.format("not starts_with(key, 'src1')"),
    "copy_key": f"with {model.FILES} select key, content_hash from files union all select 'copies/one', content_hash from files where key like '%/1.txt'",
    "by_checksum": f"with {model.FILES} select key from files where content_hash in (select content_hash from files where key like '%/1.txt')",
    "download": f"with {model.FILES}, {model.BLOBS} select key, content_hash from files join blobs using (content_hash) where sha256(content) = content_hash",
    "download_parts": f"""with {model.FILES}, {model.BLOBS}, x as (select key, octet_length(encode(content)) n from files join blobs using (content_hash))
      select key, greatest(1, ceil(n / 1000))::bigint parts, least(n, 1000)::integer most, n::bigint bytes from x""",
    "search_keys": f"with {model.FILES} select key from files where starts_with(key, 'src1/') and not contains(key, '/en/')",
    "search_keys_plain": f"with {model.FILES} select key from files where contains(key, 'src1/')",
    "messages_of": "select turn, role, text from conversations where conv_id = 3",
    "delete_message": "select conv_id, greatest(0, count(*) - count(*) filter (conv_id = 3 and turn = 1)) message_count from conversations group by 1",
    "active_sessions": f"with {_SESSIONS} select session_id, updated_at from s where book_id = 2 and status = 'active'",
    "session_turn": f"""with {_SESSIONS} select session_id, case session_id when 's7' then 500.0::double when 's8' then 600.0::double else updated_at end updated_at, case when session_id = 's10' then 'archived' else status end status,
      turn_count + case when session_id = 's7' then 1 else 0 end turn_count, case when session_id = 's8' then 'new' else name end as name from s""",
    "reading_turns": f"""with base as (select distinct conv_id from conversations), {_TURNS},
      last as (select conv_id, count(*) n, max(turn) t, arg_max(user_input, turn) i, arg_max(response_text, turn) o from turns group by 1),
      kv as (select conv_id, 'kept' k, conv_id::varchar v, -1 turn from base union all select conv_id, 'role', '?', -1 from base
        union all select conv_id, 'role', answered, turn from turns union all select conv_id, 'p' || turn % 3, turn::varchar, turn from turns),
      x as (select conv_id, string_agg(k || '=' || v, ',' order by k) extra from (select conv_id, k, arg_max(v, turn) v from kv group by 1, 2) group by 1)
      select 's' || conv_id session_id, conv_id % 4 + coalesce(n, 0) turn_count, coalesce(t + 1, 0)::double updated_at, coalesce(i, '') last_user_input, coalesce(o, '') last_agent_response, extra
      from base left join last using (conv_id) join x using (conv_id)""",
    "run_log": f"""with {_TURNS} select 'run_' || substr(sha256('s' || conv_id || chr(31) || turn), 1, 32) run_id, 's' || conv_id session_id, turn, 'reader' agent_name, user_input, response_text,
      case when turn % 2 = 0 then '[{{"name":"find","turn":' || turn || '}}]' else '[]' end tool_calls_json, '{{"chars":' || length(user_input) || '}}' usage_json, '{{}}' extra_json, 5.0::double created_at from turns""",
    "checkpoint_list": """select 'm' || doc_id % 3 mode_name, t::double created_at, lang phase, source active_agent, count(*) n
      from documents, (values (1), (2)) v(t) where t = 2 or doc_id % 2 = 0 group by all""",
    "checkpoint_state": "select lang phase, source active_agent, doc_id step from documents where doc_id = 4",
    "file_metadata": f"with {model.FILES} select key, size::varchar bytes from files where key like '%/5.txt'",
    "uploaded_images": "select doc_id id, 'image' category, octet_length(encode(text))::integer size from documents where doc_id % 3 = 0 order by doc_id % 17 desc, doc_id limit 10 offset 3",
    "delete_books": f"with {_NODES}, {_MANIFEST} select 'node' kind, book_id, count(*) n from nodes where book_id not in (1, 2) group by 2 union all select 'manifest', book_id, count(*) from m where book_id not in (1, 2) group by 2",
    "replace_nodes": f"with {_NODES} select id, title from nodes where book_id not in (select doc_id from documents where lang = 'en') union all select doc_id || '/new', 'again' from documents where lang = 'en'",
    "enumerated": "select conv_id, turn, (row_number() over (partition by conv_id order by turn) + 4)::integer as index from conversations",
    "all_batches": "select doc_id, ((row_number() over (order by doc_id) - 1) // 7)::integer batch from documents",
    "merge_extras": "select doc_id, 'a=' || source || ',b=x,c=' || lang extras from documents",
    "rolling_requests_30d": f"with {model.USAGE} select id, count(*) {data_queries._ROLL.format(s=2592000)} requests from usage",
    "request_violations": f"with {model.USAGE}, r as (select id, count(*) {data_queries._ROLL.format(s=604800)} requests from usage) select id, requests from r where requests > 20",
    "all_edges_in_graph": f"with {model.EDGES} select a entity_id, count(*) n, count(distinct b) others from ends group by a",
}
