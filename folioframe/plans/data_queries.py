"""Queries over vectors, graphs, stored files, usage logs, conversations and keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe import models
from folioframe.operators import cas, convo, graph, lookups, progress, retrieval, tables, text, usage, vector, vectorindex
from folioframe.plans import model
from folioframe.sources.files import shared_dir, table

NOW = 1706400000.0


def vector_topk(spark, d):
    v = model.vectors(spark, d)
    query = v.filter("id = 0").first()["vector"]
    return vector.search(v, query, 20).select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, d):
    v = model.vectors(spark, d)
    return vector.search(v, v.filter("id = 0").first()["vector"], 10, label=3).select("id", F.round("distance", 6).alias("distance"))


def cosine_pairs(spark, d):
    return vector.similar_pairs(model.vectors(spark, d), 0.3, "label").select("label", "a", "b", F.round("cosine", 6).alias("cosine"))


def greedy_merge(spark, d):
    return vector.greedy_merge(model.vectors(spark, d), 0.3, "label").select("label", "id", "representative")


def vector_knn(spark, d):
    """The ten nearest of every fiftieth vector, by a stored index."""
    v = model.vectors(spark, d)
    index = vectorindex.VectorIndex(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    index.build(v)
    return index.nearest(v.filter("id % 50 = 0").select(F.col("id").alias("query"), "vector"), 10).select("query", "rank", "id", F.round("distance", 6).alias("distance"))


def vector_kept_up(spark, d):
    """The nearest of one label after a tenth of the vectors was turned round and a seventh deleted."""
    v = model.vectors(spark, d)
    index = vectorindex.VectorIndex(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    index.build(v)
    index.upsert(v.filter("id % 10 = 0").withColumn("vector", F.reverse("vector")))
    index.delete(v.filter("id % 7 = 3").select("id"))
    return index.nearest(v.filter("id % 50 = 0").select(F.col("id").alias("query"), "vector"), 5, label=3).select("query", "rank", "id", F.round("distance", 6).alias("distance"))


def _raw_entities(spark, d):
    n = F.col("doc_id")
    return model.docs(spark, d).select(
        F.col("lang").alias("book_id"), n.alias("seq"), F.when(n % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit("  "), "source", F.lit("\t"))).alias("name"),
        F.concat(F.lit("T"), n % 4).alias("entity_type"), F.array(F.concat("lang", n % 3), F.lit("all")).alias("tags"), F.col("text").alias("summary"),
        F.concat(F.lit("c"), n).alias("source_chunk_id"), F.concat(F.lit("n"), n).alias("source_node_id"))


def merge_by_name(spark, d):
    return graph.merge_by_name(_raw_entities(spark, d)).select("book_id", "name_key", "name", "entity_type", F.array_join("tags", ",").alias("tags"), "summary", "source_chunk_id")


def _raw_relations(spark, d):
    n = F.col("doc_id")
    return model.docs(spark, d).select(F.col("lang").alias("book_id"), n.alias("doc_id"), F.upper("source").alias("source_name"), F.concat(F.lit("src"), n % 25).alias("target_name"))


def resolve_edges(spark, d):
    e = graph.merge_by_name(_raw_entities(spark, d))
    r = graph.resolve_edges(_raw_relations(spark, d), e).join(e.select(F.col("id").alias("target_entity_id"), F.col("name_key").alias("target_key")), "target_entity_id")
    return r.select("book_id", "doc_id", "target_key")


def unresolved_edges(spark, d):
    return graph.unresolved_edges(_raw_relations(spark, d), graph.merge_by_name(_raw_entities(spark, d))).select("doc_id", "target_name")


def entity_first(spark, d):
    seeds = spark.createDataFrame([("s1", 0.9), ("p7", 0.8)], "entity_id string, score double")
    return graph.entity_first(model.edges(spark, d), seeds, 2).select("entity_id", "hop", "score", F.size("relationships").alias("n_edges"))


def relationship_first(spark, d):
    e = model.edges(spark, d)
    seeds = e.orderBy("id").limit(10).select(F.row_number().over(graph.Window.orderBy("id")).alias("rank"), "id", F.lit(0.5).alias("score"))
    return graph.relationship_first(e, seeds)


def _part_queries(spark, d):
    """A query for each of the first thousand parts, and one more seed for some."""
    p = table(spark, d, "part").filter("p_partkey <= 1000").select(F.col("p_partkey").alias("query"), F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.lit(0.5).alias("score"))
    return p.unionByName(p.filter("query % 9 = 0").withColumn("entity_id", F.concat(F.lit("p"), F.col("query") + 1)))


def entity_first_many(spark, d):
    e = model.edges(spark, d)
    found = retrieval.degrees(retrieval.entity_first(e, _part_queries(spark, d), 2), e)
    number = F.substring("entity_id", 2, 20).cast("long")
    return found.groupBy("query", "hop").agg(F.count("*").alias("entities"), F.sum("n_edges").alias("edges"), F.sum("score").alias("score"), F.min("entity_id").alias("first"), F.max("entity_id").alias("last"),
                                             F.sum(number).alias("numbers"), F.sum(number * number).alias("squares"))


def relationship_first_many(spark, d):
    """For each supplier its first five deliveries and what is around them."""
    e = model.edges(spark, d)
    first = graph.Window.partitionBy("query").orderBy("id")
    seeds = e.select(F.col("source_entity_id").alias("query"), "id").withColumn("rank", F.row_number().over(first)).filter("rank <= 5").withColumn("score", F.lit(0.5))
    return retrieval.relationship_first(e, seeds)


def text_first_many(spark, d):
    """A text search for each nation: suppliers by the digits of their names."""
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), F.concat(F.lit("SUPPLIER#0000000"), F.col("n_nationkey") % 10).alias("text"))
    e = model.edges(spark, d)
    return retrieval.degrees(retrieval.text_first(model.entities(spark, d), e, q, 7), e)


def fts_entity(spark, d):
    return graph.fts_first(model.entities(spark, d), model.edges(spark, d), "supplier#00000000", 10).select("entity_id", "hop", "score", F.coalesce(F.size("relationships"), F.lit(0)).alias("n_edges"))


def entity_search(spark, d):
    return graph.find_entities(model.entities(spark, d), "PPLIER#00000001", 25).select("id", "name")


def edges_of(spark, d):
    return graph.edges_of(model.edges(spark, d), "s1").select("id", "target_entity_id")


def build_graph(spark, d):
    chunks = text.graph_chunks(model.docs(spark, d)).select(F.col("doc_id").alias("book_id"), F.concat_ws("/", "doc_id", "chunk_index").alias("chunk_id"), F.lit("").alias("node_id"), "chunk_text")
    entities, relations = graph.build_graph(chunks, models.extract, models.embed, 0.95)
    return entities.groupBy("book_id").agg(F.count("*").alias("entities")).join(relations.groupBy("book_id").agg(F.count("*").alias("relations")), "book_id", "left")


def find_duplicates(spark, d):
    return cas.duplicates(model.files(spark, d)).select("content_hash", F.array_join("keys", ",").alias("keys"), "n")


def reference_counts(spark, d):
    return cas.reference_counts(model.files(spark, d))


def orphan_blobs(spark, d):
    return cas.orphans(model.files(spark, d).filter("size > 500"), model.blobs(spark, d))


def dangling_keys(spark, d):
    return cas.dangling(model.files(spark, d), model.blobs(spark, d))


def verify_blobs(spark, d):
    return cas.verify(model.files(spark, d), model.blobs(spark, d))


def reconcile(spark, d):
    kept, bad = cas.reconcile(model.files(spark, d), model.blobs(spark, d))
    return kept.select("key").withColumn("kept", F.lit(True)).unionByName(bad.select(F.col("content_hash").alias("key")).withColumn("kept", F.lit(False)))


def list_dir(spark, d):
    return cas.list_dir(model.files(spark, d), "src3")


def list_root(spark, d):
    return cas.list_dir(model.files(spark, d))


def key_pages(spark, d):
    return cas.list_keys(model.files(spark, d), "src1", 7)


def upload_files(spark, d):
    base = model.files(spark, d).filter("size % 2 = 0").withColumns({"created_at": F.lit(1.0), "modified_at": F.lit(1.0)}).select("key", "content_hash", "size", "created_at", "modified_at")
    new = model.docs(spark, d).select(F.concat(F.lit("/"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("key"),
                                      F.concat("text", F.lit("+")).cast("binary").alias("content"), F.lit(2.0).alias("created_at"), F.lit(2.0).alias("modified_at"))
    index, _ = cas.upload(base, model.blobs(spark, d), new)
    return index


def usage_by_window(spark, d):
    return usage.usage_by_window(model.usage(spark, d), NOW)


def rolling_requests_5h(spark, d):
    return usage.rolling(model.usage(spark, d), "5h", ["mode"]).select("id", "requests", "tokens")


def rolling_tokens_7d(spark, d):
    return usage.rolling(model.usage(spark, d), "7d", ["mode"]).select("id", "tokens")


def limit_violations(spark, d):
    return usage.violations(model.usage(spark, d), "5h", ["mode"], "tokens", 200).select("id", "tokens")


def record_actual(spark, d):
    log = model.usage(spark, d)
    return usage.record_actual(log, log.filter("id % 7 = 0").select("id", F.lit(5).cast("long").alias("actual_in"), F.lit(6).cast("long").alias("actual_out"))).select("id", "actual_in", "actual_out")


def message_counts(spark, d):
    return convo.counts(model.messages(spark, d))


def prune_messages(spark, d):
    return convo.prune(model.messages(spark, d), 4).select("conv_id", "turn", "role")


def truncate_budget(spark, d):
    return convo.truncate(model.messages(spark, d), 150).select("conv_id", "turn", "position")


def compact_split(spark, d):
    return convo.compact_split(model.messages(spark, d), 200, keep=2).select("conv_id", "turn", "part")


def compact_messages(spark, d):
    return convo.compact(model.messages(spark, d), models.summarise, 200, keep=2).groupBy("conv_id").agg(F.count("*").alias("n"))


def over_budget(spark, d):
    return convo.over_budget(model.messages(spark, d), 300).withColumn("tokens", F.col("tokens").cast("long"))


def _conversations(spark, d):
    return model.messages(spark, d).groupBy("conv_id").agg((F.sum(F.length("text")) % 97).cast("double").alias("updated_at"))


def newest_conversations(spark, d):
    return convo.newest(_conversations(spark, d), 20, 5)


def excess_conversations(spark, d):
    return convo.excess(_conversations(spark, d), 30)


def latest_session(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("book_id"), model.seconds("ts").alias("updated_at"), F.col("event_id").alias("session_id"))
    return convo.latest_session(rows).select("conversation_id", "book_id", "session_id")


def upsert_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return tables.upsert(c, c.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("new")).unionByName(c.limit(1).select((F.col("c_custkey") * 0 - 1).alias("c_custkey"), F.lit("added").alias("c_name"))), ["c_custkey"])


def upsert_repeats(spark, d):
    """A batch with every order as a change of its customer, null keys among them: the last order counts."""
    key = lambda c: F.when(F.col(c) % 20 != 0, F.col(c)).alias("c_custkey")
    c = table(spark, d, "customer").select(key("c_custkey"), "c_name")
    o = table(spark, d, "orders").select(key("o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_orderkey").alias("seq"))
    return tables.upsert(c, o, ["c_custkey"], ["seq"])


def merge_metadata(spark, d):
    parts = model.docs(spark, d).select(F.col("source").alias("book"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("language"),
                                       F.when(F.col("doc_id") % 7 == 0, F.col("text")).alias("title"))
    return tables.merge_metadata(parts, "book", "seq", ["language", "title"])


def _manifest(spark, d):
    n = F.col("doc_id")
    return model.docs(spark, d).select(n.alias("book_id"), F.get(F.array(F.lit("chunk"), F.lit("graph"), F.lit("summary")), (n % 3).cast("int")).alias("index_type"),
                                      F.when(n % 4 == 0, "failed").otherwise("built").alias("status"), n.alias("count"), F.lit("").alias("error"), F.lit(1.0).alias("built_at"), F.lit(1.0).alias("created_at"))


def manifest_upsert(spark, d):
    changes = model.docs(spark, d).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), F.lit("chunk").alias("index_type"), F.when(F.col("doc_id") % 8 == 0, "failed").otherwise("built").alias("status"),
                                                                 F.lit(7).cast("long").alias("count"), F.lit("e").alias("error"))
    return tables.upsert_manifest(_manifest(spark, d), changes, 9.0)


def books_with_indexes(spark, d):
    books = model.docs(spark, d).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 13).cast("double").alias("created_at"))
    return tables.books_with_indexes(books, _manifest(spark, d)).select("id", F.array_join("indexes", ",").alias("indexes"))


def merge_tools(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey") % 30).alias("name"), F.col("s_suppkey").cast("long").alias("n")).dropDuplicates(["name"]).select("name", F.lit(1).alias("n"))
    p = table(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey") % 40).alias("name")).distinct().select("name", F.lit(2).alias("n"))
    return tables.merge_tools([s, p], "keep_first")


def batches(spark, d):
    return progress.batched(model.messages(spark, d), "turn", 3, "conv_id").select("conv_id", "turn", "batch")


def take_while(spark, d):
    return progress.take_while(model.messages(spark, d), "turn", F.length("text") < 400, "conv_id").select("conv_id", "turn")


def delta_concat(spark, d):
    e = model.messages(spark, d).select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return progress.joined_deltas(e).select("call_id", F.sha2("text", 256).alias("text_hash"), "n")


def tool_result_stats(spark, d):
    item = F.struct(F.col("role").alias("type"), F.col("turn").cast("int").alias("hop"), F.transform(F.sequence(F.lit(0), F.col("turn") % 3), lambda i: i.cast("string")).alias("relationships"))
    r = model.messages(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return progress.result_stats(r).select("id", "items", "edges", "max_hop", F.coalesce(F.element_at("by_type", F.lit("user")), F.lit(0)).alias("users"))


def log_binding(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get(F.array(F.lit("DEBUG"), F.lit("INFO"), F.lit("ERROR")), (F.col("event_id") % 3).cast("int")).alias("level"),
                                          F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("app"), F.lit("own")).alias("fields"))
    return progress.bound_logs(rows, "INFO", app="base", host="h").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


def extract_metadata(spark, d):
    body = F.concat(F.lit("Title: T"), "doc_id", F.lit("\nAuthor:  "), "source", F.lit(" \n"), "text")
    return models.extract_metadata(model.docs(spark, d).select(F.col("doc_id").alias("book_id"), body.alias("text"))).select("book_id", "title", "author")


def _told(spark, d):
    """Books that tell about themselves, some at the start and some at the end of their texts."""
    n = F.col("doc_id")
    start = F.concat(F.when(n % 2 == 0, F.concat(F.lit("Title: T"), n, F.lit("\n"))).otherwise(""), F.when(n % 3 == 0, F.concat(F.lit("Series:  S"), n % 5, F.lit(" \n"))).otherwise(""))
    end = F.concat(F.lit("\nTitle: U"), n, F.lit("\nauthor : A"), n % 7, F.lit("\nLanguage: "), "lang", F.lit("\nPublisher: "), "source", F.when(n % 4 > 0, "\nDescription: some").otherwise(""))
    return model.docs(spark, d).select(n.alias("book_id"), F.concat(start, "text", end).alias("text"))


def metadata_rounds(spark, d):
    """Rounds of questions about each book, with some answers that are cut off."""
    ask = lambda c: F.when(F.length(c) % 7 == 0, '```json\n{"title": "cut').otherwise(models.answer_metadata(c))
    found = models.metadata_rounds(_told(spark, d), ask)
    return found.select("book_id", *models.FIELDS, F.coalesce(F.element_at("extras", F.lit("series")), F.lit("")).alias("series"), "rounds", "failures", "stopped")


def _answered(spark, d):
    """Documents as chunks and, in their text, the answers of a model: in fences, bare, with blank names, or broken."""
    n = F.col("doc_id")
    entity = F.struct(F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "source")).alias("name"), F.when(n % 6 > 0, F.col("lang")).alias("entity_type"), F.array(F.col("lang"), F.lit(" ")).alias("tags"), F.col("text").alias("summary"))
    relation = F.struct(F.col("source").alias("source_name"), F.when(n % 3 > 0, F.concat(F.lit("src"), n % 9)).alias("target_name"), F.lit("near").alias("relation_type"))
    answer = F.to_json(F.struct(F.array(entity, F.struct(F.lit("Zoë").alias("name"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("summary"))).alias("entities"),
                                F.array(relation).alias("relationships")))
    told = F.when(n % 5 == 0, F.concat(answer, F.lit("}"))).when(n % 5 == 1, F.concat(F.lit("So:\n```json\n"), answer, F.lit("\n```"))).when(n % 5 == 2, F.lit('{"entities": 7}')).otherwise(answer)
    return model.docs(spark, d).select(F.col("lang").alias("book_id"), n.cast("string").alias("chunk_id"), F.lit("").alias("node_id"), told.alias("chunk_text"))


def answered_entities(spark, d):
    return models.answered_graph(_answered(spark, d), lambda c: c)[0].select("book_id", "source_chunk_id", "name", "entity_type", F.array_join("tags", ",").alias("tags"), F.length("summary").alias("n"))


def answered_relations(spark, d):
    return models.answered_graph(_answered(spark, d), lambda c: c)[1].select("book_id", "source_chunk_id", "source_name", "target_name", "relation_type")


def answer_failures(spark, d):
    return models.answered_graph(_answered(spark, d), lambda c: c)[2]


def edges_of_any(spark, d):
    ids = table(spark, d, "supplier").filter("s_suppkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"))
    return lookups.edges_of_any(model.edges(spark, d), ids.unionByName(spark.createDataFrame([("p7",)], "entity_id string"))).select("id", "target_entity_id")


def book_ids(spark, d):
    return lookups.book_ids(model.docs(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("created_at")))


def books_with_chunk_index(spark, d):
    return lookups.with_built_index(model.docs(spark, d).select(F.col("doc_id").alias("book_id")), _manifest(spark, d), "chunk")


def nodes_of_book(spark, d):
    return lookups.of_book(_raw_entities(spark, d), "en", ["n1", "n2", "n28"]).select("book_id", "seq")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_RAW = """raw as (select lang book_id, doc_id seq, case when doc_id % 2 = 0 then upper(source) else '  ' || source || chr(9) end as name, source name_key, 'T' || (doc_id % 4) entity_type,
  lang || (doc_id % 3) tag, text as summary, 'c' || doc_id source_chunk_id from documents),
firsts as (select book_id, name_key, tag, min(seq) f from raw group by all)"""
_MANIFEST = """m as (select doc_id book_id, ['chunk', 'graph', 'summary'][doc_id % 3 + 1] index_type, case when doc_id % 4 = 0 then 'failed' else 'built' end status, doc_id as "count", '' as "error",
  1.0::double built_at, 1.0::double created_at from documents)"""
_ROLL = "over (partition by mode order by ts range between {s} preceding and current row)"
_USED = "case when actual_in is null then estimated else actual_in + actual_out end"
_TOK = "greatest(1, length(text) // 4)"

ORACLES = {
    "extract_metadata": "select doc_id book_id, 'T' || doc_id title, source author from documents",
    "metadata_rounds": """with b as (select doc_id book_id, case when doc_id % 2 = 0 then 'Title: T' || doc_id || chr(10) else '' end || case when doc_id % 3 = 0 then 'Series:  S' || (doc_id % 5) || ' ' || chr(10) else '' end || text
        || chr(10) || 'Title: U' || doc_id || chr(10) || 'author : A' || (doc_id % 7) || chr(10) || 'Language: ' || lang || chr(10) || 'Publisher: ' || source || case when doc_id % 4 > 0 then chr(10) || 'Description: some' else '' end as t from documents),
      f as (select book_id, i, least(3, greatest(1, ceil(length(t) / 2000.0)))::integer parts, substr(t, i * 2000 + 1, 2000) x from b, (select unnest(generate_series(0, 2)) i) where i = 0 or i * 2000 < length(t)),
      s as (select book_id, i, parts, length(x) % 7 = 0 cut, """ + ", ".join(f"nullif(trim(regexp_extract(x, '(?im)^\\s*{k}\\s*:\\s*(.+)$', 1)), '') {k}_" for k in (*models.FIELDS, "series")) + """ from f),
      a as (select book_id, i, parts, """ + ", ".join(f"case when not cut then {k}_ end {k}_" for k in (*models.FIELDS, "series")) + ", (cut or (" + " and ".join(f"{k}_ is null" for k in (*models.FIELDS, "series")) + """))::integer failed from s),
      c as (select book_id, i, parts, """ + ", ".join(f"coalesce(last_value({k}_ ignore nulls) over w, '') {k}" for k in (*models.FIELDS, "series")) + """, sum(failed) over w failures from a window w as (partition by book_id order by i)),
      e as (select *, case when """ + " and ".join(f"{k} <> ''" for k in models.FIELDS) + """ then 'complete' when i = 2 then 'rounds' when i + 1 = parts then 'text' end stopped from c)
      select book_id, title, author, "language", publisher, description, series, (i + 1)::integer rounds, failures::integer failures, stopped from e where stopped is not null qualify row_number() over (partition by book_id order by i) = 1""",
    "answered_entities": """select lang book_id, doc_id::varchar source_chunk_id, source as name, case when doc_id % 6 > 0 then lang else 'Unknown' end entity_type, lang tags, length(trim(text)) n from documents where doc_id % 5 in (1, 3, 4) and doc_id % 4 > 0
      union all select lang, doc_id::varchar, 'Zoë', 'Unknown', '', 0 from documents where doc_id % 5 in (1, 3, 4)""",
    "answered_relations": "select lang book_id, doc_id::varchar source_chunk_id, source source_name, 'src' || (doc_id % 9) target_name, 'near' relation_type from documents where doc_id % 5 in (1, 3, 4) and doc_id % 3 > 0",
    "answer_failures": "select lang book_id, count(*) chunks, count(*) filter (doc_id % 5 in (0, 2)) failed from documents group by 1",
    "edges_of_any": f"with {model.EDGES} select id, target_entity_id from edges where source_entity_id in ('s0', 's1', 's2', 's3', 's4') or target_entity_id = 'p7'",
    "book_ids": "select doc_id id from documents",
    "books_with_chunk_index": f"with {_MANIFEST} select book_id from m where index_type = 'chunk' and status = 'built'",
    "nodes_of_book": "select lang book_id, doc_id seq from documents where lang = 'en' and doc_id in (1, 2, 28)",
    "vector_topk": """with q as (select embedding::double[] q from embeddings where vec_id = 0), v as (select vec_id id, list_sum(list_transform(list_zip(embedding::double[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from embeddings, q)
      select id, round(x, 6) distance, round(1 - x, 6) score from v order by x, id limit 20""",
    "vector_topk_filtered": """with q as (select embedding::double[] q from embeddings where vec_id = 0), v as (select vec_id id, list_sum(list_transform(list_zip(embedding::double[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from embeddings, q where label = 3)
      select id, round(x, 6) distance from v order by x, id limit 10""",
    "cosine_pairs": """with v as (select vec_id, label, embedding::double[] e from embeddings)
      select x.label, x.vec_id a, y.vec_id b, round(list_cosine_similarity(x.e, y.e), 6) cosine from v x join v y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.3""",
    "greedy_merge": """with recursive v as (select vec_id, label, embedding::double[] e, row_number() over (order by vec_id) i from embeddings),
      near as (select y.vec_id b, list(x.vec_id) ns from v x join v y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.3 group by 1),
      w as (select i, vec_id, coalesce(ns, []) ns from v left join near on b = vec_id),
      r(i, reps) as (select 0::bigint, []::bigint[] union all
        select w.i, case when len(list_intersect(ns, reps)) = 0 then list_append(reps, vec_id) else reps end from r join w on w.i = r.i + 1),
      final as (select reps from r order by i desc limit 1)
      select label, v.vec_id id, coalesce(list_min(list_intersect(w.ns, reps)), v.vec_id) representative from v join w using (vec_id), final""",
    "vector_knn": """with v as (select vec_id, embedding::double[] e from embeddings),
      p as (select q.vec_id query, v.vec_id id, list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from v q, v where q.vec_id % 50 = 0),
      r as (select *, row_number() over (partition by query order by x, id) k from p) select query, k::integer rank, id, round(x, 6) distance from r where k <= 10""",
    "vector_kept_up": """with q as (select vec_id, embedding::double[] e from embeddings where vec_id % 50 = 0),
      v as (select vec_id, case when vec_id % 10 = 0 then list_reverse(embedding) else embedding end::double[] e from embeddings where label = 3 and vec_id % 7 <> 3),
      p as (select q.vec_id query, v.vec_id id, list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from q, v),
      r as (select *, row_number() over (partition by query order by x, id) k from p) select query, k::integer rank, id, round(x, 6) distance from r where k <= 5""",
    "merge_by_name": f"""with {_RAW}, t as (select book_id, name_key, string_agg(tag, ',' order by f) ts, min(f) f0 from firsts group by 1, 2)
      select book_id, name_key, arg_min(name, seq) as name, arg_min(entity_type, seq) entity_type, any_value(split_part(ts, ',', 1) || ',all' || case when contains(ts, ',') then substr(ts, strpos(ts, ',')) else '' end) tags,
        arg_max(summary, length(summary)::hugeint * 100000000 - seq) summary, arg_min(source_chunk_id, seq) source_chunk_id from raw join t using (book_id, name_key) group by 1, 2""",
    "resolve_edges": """with n as (select distinct lang book_id, source k from documents)
      select d.lang book_id, d.doc_id, 'src' || (d.doc_id % 25) target_key from documents d join n on n.book_id = d.lang and n.k = 'src' || (d.doc_id % 25)""",
    "unresolved_edges": """with n as (select distinct lang book_id, source k from documents)
      select d.doc_id, 'src' || (d.doc_id % 25) target_name from documents d where not exists (select 1 from n where n.book_id = d.lang and n.k = 'src' || (d.doc_id % 25))""",
    "entity_first": f"""with recursive {model.EDGES}, walk(e, hop) as (select * from (values ('s1', 0), ('p7', 0)) union select ends.b, hop + 1 from walk join ends on ends.a = walk.e where hop < 2),
      m as (select e, min(hop) hop from walk group by e)
      select e entity_id, hop::integer hop, case e when 's1' then 0.9::double when 'p7' then 0.8::double else 0.0::double end score, count(ends.id)::integer n_edges from m left join ends on ends.a = m.e group by all""",
    "entity_first_many": f"""with recursive {model.EDGES}, pairs as (select distinct a, b from ends),
      seeds as (select p_partkey query, 'p' || p_partkey e from part where p_partkey <= 1000 union select p_partkey, 'p' || (p_partkey + 1) from part where p_partkey <= 1000 and p_partkey % 9 = 0),
      walk(query, e, hop) as (select query, e, 0 from seeds union select query, b, hop + 1 from walk join pairs on a = e where hop < 2),
      m as (select query, e, min(hop) hop from walk group by all), n as (select a, count(*) n from ends group by a)
      select query, hop::integer hop, count(*) entities, sum(coalesce(n, 0))::bigint edges, sum(case when hop = 0 then 0.5::double else 0.0::double end) score, min(e) as first, max(e) as last,
        sum(substr(e, 2)::bigint)::bigint numbers, sum(substr(e, 2)::bigint * substr(e, 2)::bigint)::bigint squares from m left join n on a = e group by query, hop""",
    "relationship_first": f"""with {model.EDGES}, hit as (select *, row_number() over (order by id) rank from edges order by id limit 10),
      visited as (select via, min(rank * 2 + nth) spot from (select rank, 0 nth, source_entity_id via from hit union all select rank, 1, target_entity_id from hit) group by all),
      firsts as (select a, b, id, row_number() over (partition by a order by id) n from ends qualify n <= 3)
      select id, 0.5::double score, 0 hop, null::varchar via, null::varchar other_id from hit
      union all select id, 0.0::double, 1, v.via, b from visited v join firsts on a = v.via left join visited o on o.via = b where o.spot is null or o.spot > v.spot""",
    "relationship_first_many": f"""with {model.EDGES}, seeds as (select source_entity_id query, id, row_number() over (partition by source_entity_id order by id) rank from edges qualify rank <= 5),
      hit as (select query, rank, e.* from seeds join edges e using (id)),
      visited as (select query, via, min(rank * 2 + nth) spot from (select query, rank, 0 nth, source_entity_id via from hit union all select query, rank, 1, target_entity_id from hit) group by all),
      firsts as (select a, b, id, row_number() over (partition by a order by id) n from ends qualify n <= 3)
      select query, rank::integer rank, 0 place, id, 0.5::double score, 0 hop, null::varchar via, null::varchar other_id from hit
      union all select v.query, (v.spot // 2)::integer, ((v.spot % 2) * 3 + n)::integer, id, 0.0::double, 1, v.via, b from visited v join firsts on a = v.via left join visited o on o.query = v.query and o.via = b where o.spot is null or o.spot > v.spot""",
    "text_first_many": f"""with {model.EDGES}, {model.ENTITIES}, q as (select n_nationkey query, 'supplier#0000000' || (n_nationkey % 10) t from nation),
      hit as (select query, id, row_number() over (partition by query order by id) k from q join entities on contains(lower(name), t) or contains(lower(summary), t) qualify k <= 7),
      near as (select distinct query, b from hit join ends on a = hit.id), found as (select query, id e, 0 hop, 1.0::double score from hit union all select query, b, 1, 0.0::double from near where not exists (select 1 from hit where hit.query = near.query and hit.id = near.b)),
      n as (select a, count(*) n from ends group by a)
      select query, e entity_id, hop::integer hop, score, coalesce(n, 0) n_edges from found left join n on a = e""",
    "fts_entity": f"""with {model.EDGES}, {model.ENTITIES}, hit as (select id from entities where contains(lower(name), 'supplier#00000000') or contains(lower(summary), 'supplier#00000000') order by id limit 10),
      near as (select distinct b id from ends where a in (select id from hit) and b not in (select id from hit)), c as (select a, count(*) n from ends group by a)
      select id entity_id, 0 as hop, 1.0::double score, coalesce(n, 0)::integer n_edges from hit left join c on c.a = id
      union all select id, 1, 0.0::double, least(3, coalesce(n, 0))::integer from near left join c on c.a = id""",
    "entity_search": f"with {model.ENTITIES} select id, name from entities where contains(lower(name), 'pplier#00000001') or contains(lower(summary), 'pplier#00000001') order by id limit 25",
    "edges_of": f"with {model.EDGES} select id, target_entity_id from edges where source_entity_id = 's1' or target_entity_id = 's1'",
    "find_duplicates": f"with {model.FILES} select content_hash, string_agg(key, ',' order by key) keys, count(*) n from files group by 1 having count(*) > 1",
    "reference_counts": f"with {model.FILES} select content_hash, count(*) refs from files group by 1",
    "orphan_blobs": f"with {model.FILES}, {model.BLOBS} select content_hash from blobs where content_hash not in (select content_hash from files where size > 500)",
    "dangling_keys": f"with {model.FILES}, {model.BLOBS} select key, content_hash from files where content_hash not in (select content_hash from blobs)",
    "verify_blobs": f"""with {model.FILES}, {model.BLOBS} select key, f.content_hash expected, coalesce(sha256(b.content), '<missing>') actual from files f left join blobs b using (content_hash)
      where coalesce(sha256(b.content), '<missing>') <> f.content_hash""",
    "reconcile": f"""with {model.FILES}, {model.BLOBS} select key, true kept from files where content_hash in (select content_hash from blobs where sha256(content) = content_hash)
      union all select content_hash, false from blobs where sha256(content) <> content_hash""",
    "list_dir": f"""with {model.FILES} select split_part(substr(key, 6), '/', 1) as name, contains(substr(key, 6), '/') is_dir, min(case when contains(substr(key, 6), '/') then 'src3/' || split_part(substr(key, 6), '/', 1) else key end) as key
      from files where starts_with(key, 'src3/') group by 1, 2""",
    "list_root": f"with {model.FILES} select split_part(key, '/', 1) as name, true is_dir, split_part(key, '/', 1) as key from files group by 1",
    "key_pages": f"with {model.FILES} select key, ((row_number() over (order by key) - 1) // 7)::bigint page from files where starts_with(key, 'src1')",
    "upload_files": f"""with {model.FILES}, n as (select source || '/' || lang || '/' || doc_id || '.txt' as key, sha256(text || '+') content_hash, octet_length(encode(text || '+')) size from documents)
      select key, content_hash, size::bigint size, 1.0::double created_at, 1.0::double modified_at from files where size % 2 = 0 and key not in (select key from n)
      union all select n.key, n.content_hash, n.size::bigint, case when f.key is null then 2.0::double else 1.0::double end, 2.0::double from n left join files f on f.key = n.key and f.size % 2 = 0""",
    "usage_by_window": f"with {model.USAGE} select " + ", ".join(
        f"count(*) filter (ts >= {NOW} - {s}) requests_{w}, coalesce(sum({_USED}) filter (ts >= {NOW} - {s}), 0)::bigint tokens_{w}" for w, s in usage.WINDOWS.items()) + " from usage",
    "rolling_requests_5h": f"with {model.USAGE} select id, count(*) {_ROLL.format(s=18000)} requests, sum({_USED}) {_ROLL.format(s=18000)}::bigint tokens from usage".replace("sum(case", "(sum(case").replace("row)::bigint", "row))::bigint"),
    "rolling_tokens_7d": f"with {model.USAGE} select id, (sum({_USED}) {_ROLL.format(s=604800)})::bigint tokens from usage",
    "limit_violations": f"with {model.USAGE}, r as (select id, (sum({_USED}) {_ROLL.format(s=18000)})::bigint tokens from usage) select id, tokens from r where tokens > 200",
    "record_actual": f"with {model.USAGE} select id, case when id % 7 = 0 and id <> 0 then 5 else actual_in end::bigint actual_in, case when id % 7 = 0 and id <> 0 then 6 else actual_out end::bigint actual_out from usage",
    "message_counts": "select conv_id, count(*) message_count from conversations group by 1",
    "prune_messages": """with r as (select *, sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id order by turn) k, count(*) over (partition by conv_id) n,
        sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id) m from conversations) select conv_id, turn, role from r where role = 'system' or k > least(n - 4, m)""",
    "truncate_budget": f"""with r as (select *, sum(case when role = 'system' then 0 else {_TOK} end) over (partition by conv_id order by turn desc) later, sum(case when role = 'system' then {_TOK} else 0 end) over (partition by conv_id) sys from conversations),
      k as (select * from r where role = 'system' or later + sys <= 150) select conv_id, turn, (row_number() over (partition by conv_id order by case when role = 'system' then 0 else 1 end, turn) - 1)::integer as position from k""",
    "compact_split": f"""with r as (select *, sum({_TOK}) over (partition by conv_id) t, row_number() over (partition by conv_id order by turn desc) b from conversations)
      select conv_id, turn, case when t > 0.8 * 200 and b > 2 then 'old' else 'recent' end part from r""",
    "compact_messages": f"""with r as (select *, sum({_TOK}) over (partition by conv_id) t, row_number() over (partition by conv_id order by turn desc) b from conversations),
      p as (select conv_id, case when t > 0.8 * 200 and b > 2 then 1 else 0 end old from r) select conv_id, count(*) filter (old = 0) + max(old) n from p group by 1""",
    "over_budget": f"select conv_id, sum({_TOK})::bigint tokens from conversations group by 1 having sum({_TOK}) > 300",
    "newest_conversations": "select conv_id, (sum(length(text)) % 97)::double updated_at from conversations group by 1 order by 2 desc, 1 limit 20 offset 5",
    "excess_conversations": "with c as (select conv_id, (sum(length(text)) % 97)::double updated_at from conversations group by 1), r as (select *, row_number() over (order by updated_at desc, conv_id) k from c) select conv_id, updated_at from r where k > 30",
    "latest_session": """with r as (select user_id conversation_id, event_type book_id, event_id session_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k from events)
      select conversation_id, book_id, session_id from r where k = 1""",
    "upsert_rows": "select c_custkey, case when c_custkey % 10 = 0 then 'new' else c_name end c_name from customer union all select -1, 'added'",
    "upsert_repeats": """with c as (select case when c_custkey % 20 <> 0 then c_custkey end k, c_name n from customer), o as (select case when o_custkey % 20 <> 0 then o_custkey end k, o_orderkey q from orders)
      select k c_custkey, n c_name from c where not exists (select 1 from o where o.k is not distinct from c.k) union all select k, 'order ' || max(q) from o group by k""",
    "merge_metadata": """select source book, arg_max(lang, doc_id) filter (doc_id % 3 <> 0) as "language", coalesce(arg_max(text, doc_id) filter (doc_id % 7 = 0 and trim(text) <> ''), '') title from documents group by 1""",
    "manifest_upsert": f"""with {_MANIFEST}, c as (select doc_id book_id, 'chunk' index_type, case when doc_id % 8 = 0 then 'failed' else 'built' end status from documents where doc_id % 2 = 0)
      select book_id, index_type, status, "count", "error", built_at, created_at from m where not (index_type = 'chunk' and book_id % 2 = 0)
      union all select c.book_id, c.index_type, c.status, 7, 'e', case when c.status = 'built' then 9.0::double else m.built_at end, coalesce(m.created_at, 9.0::double) from c left join m on m.book_id = c.book_id and m.index_type = 'chunk'""",
    "books_with_indexes": f"with {_MANIFEST} select book_id id, case when status = 'built' then index_type else '' end indexes from m",
    "merge_tools": "with s as (select distinct 't' || (s_suppkey % 30) as name from supplier), p as (select distinct 't' || (p_partkey % 40) as name from part) select name, 1 n from s union all select name, 2 from p where name not in (select name from s)",
    "batches": "select conv_id, turn, ((row_number() over (partition by conv_id order by turn) - 1) // 3)::integer batch from conversations",
    "take_while": "with r as (select conv_id, turn, min(case when length(text) < 400 then 1 else 0 end) over (partition by conv_id order by turn) ok from conversations) select conv_id, turn from r where ok = 1",
    "delta_concat": "select conv_id call_id, sha256(string_agg(text, '' order by turn)) text_hash, count(*) n from conversations group by 1",
    "tool_result_stats": "select conv_id id, count(*) items, sum(turn % 3 + 1)::bigint edges, max(turn)::integer max_hop, count(*) filter (role = 'user') users from conversations group by 1",
    "log_binding": "select event_id, 'app=own,host=h,user=' || user_id fields from events where event_id % 3 <> 0",
}
