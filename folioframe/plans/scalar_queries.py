"""Queries over scalar functions, and the streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.functions import base64s, scalars, urls, versions
from folioframe.plans import model
from folioframe.sources.files import shared_dir, table
from folioframe.streaming import streams


def _urls(spark, d):
    n = F.col("page_id")
    messy = F.concat(F.when(n % 2 == 0, "HTTP://WWW.").otherwise("https://"), F.regexp_extract("url", r"^https?://([^/]+)", 1), F.when(n % 3 == 0, ":80").when(n % 3 == 1, ":443").otherwise(""),
                     F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("//A//b/"), n)), F.when(n % 4 == 0, F.lit("?q=1&x=a%20b&q=2")).otherwise(""))
    return table(spark, d, "pages").select("page_id", messy.alias("url"))


_URLS = """u as (select page_id, case when page_id % 2 = 0 then 'HTTP://WWW.' else 'https://' end || regexp_extract(url, '^https?://([^/]+)', 1) || case page_id % 3 when 0 then ':80' when 1 then ':443' else '' end ||
  case when page_id % 5 = 0 then '' else '//A//b/' || page_id end || case when page_id % 4 = 0 then '?q=1&x=a%20b&q=2' else '' end url,
  lower(regexp_extract(url, '^https?://([^/]+)', 1)) h from pages)"""


def url_normalize(spark, d):
    return _urls(spark, d).select("page_id", urls.normalize(F.col("url")).alias("url"))


def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.port(u).alias("port"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.is_secure(u).alias("secure"))


def url_params(spark, d):
    u = F.col("url")
    p = urls.params(u)
    return _urls(spark, d).select("page_id", F.array_join(F.element_at(p, F.lit("q")), ",").alias("q"), F.element_at(urls.first_params(u), F.lit("x")).alias("x"))


def url_edit(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("page_id", urls.as_websocket(urls.replace(u, query=F.lit(""))).alias("ws"), urls.merge_query(F.lit("http://h/p?a=1&b=2"), b="3", c="x y").alias("merged"),
                                  urls.segments(F.lit("http://h/p/"), F.lit("a b"), F.lit("c")).alias("deeper"))


def _versions(spark, d):
    k = F.col("p_partkey")
    pre = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("-rc."), k % 11)).otherwise(F.concat(F.lit("-alpha"), k % 5))
    return table(spark, d, "part").select(F.concat_ws(".", k % 4, k % 7, F.concat((k % 13).cast("string"), pre)).alias("version")).distinct()


def semver_sort(spark, d):
    v = F.col("version")
    return _versions(spark, d).select("version", F.dense_rank().over(Window.partitionBy(versions.part(v, "major")).orderBy(versions.sort_key(v))).alias("place"))


_VERSIONS = """v as (select distinct (p_partkey % 4) || '.' || (p_partkey % 7) || '.' || (p_partkey % 13) || case p_partkey % 3 when 0 then '' when 1 then '-rc.' || (p_partkey % 11) else '-alpha' || (p_partkey % 5) end as version from part),
k as (select *, split_part(split_part(version, '-', 1), '.', 1)::integer a, split_part(split_part(version, '-', 1), '.', 2)::integer b, split_part(split_part(version, '-', 1), '.', 3)::integer c, split_part(version, '-', 2) pre from v)"""


def semver_bump(spark, d):
    v = F.col("version")
    return _versions(spark, d).select("version", versions.bump(v, "minor").alias("minor"), versions.bump(v, "major").alias("major"), versions.is_prerelease(v).alias("pre"), versions.is_stable(v).alias("stable"))


def sha256_docs(spark, d):
    return model.docs(spark, d).select("doc_id", scalars.sha256(F.col("text")).alias("hash"), scalars.blob_path(scalars.sha256(F.col("text"))).alias("path"))


def fingerprint(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.fingerprint(F.col("c_name")).alias("fp"))


def entity_type_parse(spark, d):
    word = F.concat(F.lit(" "), F.get(F.array(*[F.lit(x) for x in ("PERSON", "place", "Gizmo", "Concept")]), (F.col("c_custkey") % 4).cast("int")), F.lit("\t"))
    return table(spark, d, "customer").select("c_custkey", scalars.entity_type(word).alias("kind"))


def key_functions(spark, d):
    key = F.concat(F.lit("app:"), "source", F.lit(":"), "lang", F.lit(":id="), F.col("doc_id"), F.lit(":n="), "n_chars")
    return model.docs(spark, d).select("doc_id", F.array_join(scalars.key_positional(key, "app"), "|").alias("parts"), F.element_at(scalars.key_named(key, "app"), F.lit("n")).alias("n"),
                                       scalars.key_valid(key, "app").alias("valid"), scalars.key_valid(F.concat(key, F.lit(":tail")), "app").alias("valid_tail"))


def base64_functions(spark, d):
    c = F.col("c_name")
    uri = base64s.data_uri(F.lit("text/plain"), c)
    return table(spark, d, "customer").select("c_custkey", base64s.encode(c).alias("plain"), base64s.encode_url(c).alias("url"), base64s.decode_url(base64s.encode_url(c)).cast("string").alias("back"),
                                              base64s.decoded_size(base64s.encode(c)).alias("size"), base64s.uri_mime(uri).alias("mime"), base64s.truncated(base64s.encode(c), 8).alias("short"))


def int_to_base64url(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.int_to_base64url(F.col("o_orderkey") * 65537 + 7).alias("coded"))


def durations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.duration(F.col("o_orderkey") * 997).alias("text"))


def snake_case(spark, d):
    name = F.concat(F.initcap("p_type"), F.lit("HTTPServer"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", scalars.snake_case(F.replace(name, F.lit(" "), F.lit(""))).alias("name"))


def salvage_json(spark, d):
    raw = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 3 == 0, "no object").otherwise(F.col("props")), F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", scalars.salvage_json(raw).alias("body"))


def flatten_json(spark, d):
    nested = F.concat(F.lit('{"a":'), "props", F.lit(',"b":{"c":{"d":'), "user_id", F.lit("}}}"))
    return table(spark, d, "events").select("event_id", F.element_at(scalars.flatten(nested), F.lit("b.c.d")).alias("d"), F.size(scalars.flatten(nested)).alias("n"))


def find_text(spark, d):
    return model.docs(spark, d).select("doc_id", scalars.find_text(F.col("text"), F.lit("of  the"), F.lit(5)).alias("place"))


def typed_getters(spark, d):
    m = F.create_map(F.lit("n"), F.col("user_id").cast("string"), F.lit("flag"), F.when(F.col("user_id") % 2 == 0, "true").otherwise("maybe"))
    return table(spark, d, "events").select("event_id", scalars.get_int(m, "n").alias("n"), scalars.get_bool(m, "flag", False).alias("flag"), scalars.get_str(m, "none", "-").alias("none"))


def retryable(spark, d):
    text = F.get(F.array(F.lit("HTTP 429 Too Many"), F.lit("bad request"), F.lit("Connection reset")), (F.col("event_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_id", scalars.is_retryable(text).alias("again"))


def log_lines(spark, d):
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", scalars.log_line(F.col("ts"), F.lit("INFO"), F.lit("app"), F.col("event_type"), m).alias("line"))


def evaluate_math(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.evaluate(F.concat(F.lit("("), F.col("o_orderkey"), F.lit(" + 3) * 2 // 5 - 1"))).alias("value"))


def mime_extensions(spark, d):
    mime = F.get(F.array(F.lit("application/pdf"), F.lit("IMAGE/PNG"), F.lit("x/y")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", scalars.ext_for_mime(mime).alias("ext"))


def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.gen_id(F.col("c_custkey"), F.col("c_name"), prefix="id_").alias("id"))


def stream_usage(spark, d):
    """Usage in windows of 5 hours that slide by 1, from events read as a stream."""
    name = f"usage_{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = streams.read(spark, f"{d}/events.parquet" if _is_dir(spark, f"{d}/events.parquet") else f"{d}/event[s].parquet", schema)
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"), F.floor("value").cast("long").alias("estimated"), F.lit(None).cast("long").alias("actual_in"), F.lit(None).cast("long").alias("actual_out"))
    base = f"{shared_dir(spark)}/{name}"
    out = streams.drain(streams.windowed_usage(log), f"{base}/rows", "complete", f"{base}/progress")
    return out.select("mode", "requests", "tokens")


def _is_dir(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_PORT = "case page_id % 3 when 0 then 80 when 1 then 443 end"
ORACLES = {
    "url_normalize": f"""with {_URLS} select page_id, case when page_id % 2 = 0 then 'http://www.' || h || case when page_id % 3 = 1 then ':443' else '' end else 'https://' || h || case when page_id % 3 = 0 then ':80' else '' end end ||
      case when page_id % 5 = 0 then '/' else '/A/b/' || page_id end || case when page_id % 4 = 0 then '?q=1&x=a%20b&q=2' else '' end url from u""",
    "url_parts": f"""with {_URLS} select page_id, case when page_id % 2 = 0 then 'http' else 'https' end as scheme, case when page_id % 2 = 0 then 'www.' else '' end || h host,
      coalesce({_PORT}, case when page_id % 2 = 0 then 80 else 443 end) port, case when page_id % 5 = 0 then '' else '//A//b/' || page_id end as path, case when page_id % 4 = 0 then 'q=1&x=a%20b&q=2' else '' end as query, page_id % 2 <> 0 secure from u""",
    "url_params": "select page_id, case when page_id % 4 = 0 then '1,2' end q, case when page_id % 4 = 0 then 'a b' end x from pages",
    "url_edit": f"""with {_URLS} select page_id, case when page_id % 2 = 0 then 'ws' else 'wss' end || '://' || regexp_extract(url, '//([^?]*)', 1) ws, 'http://h/p?a=1&b=3&c=x+y' merged, 'http://h/p/a%20b/c' deeper from u""",
    "semver_sort": f"""with {_VERSIONS} select version, dense_rank() over (partition by a order by b, c, case when pre = '' then 1 else 0 end, split_part(pre, '.', 1), case when contains(pre, '.') then split_part(pre, '.', 2)::integer else -1 end)::integer place from k""",
    "semver_bump": f"with {_VERSIONS} select version, a || '.' || (b + 1) || '.0' as minor, (a + 1) || '.0.0' as major, pre <> '' as pre, pre = '' and a > 0 as stable from k",
    "sha256_docs": "select doc_id, sha256(text) as hash, 'blobs/' || left(sha256(text), 2) || '/' || sha256(text) as path from documents",
    "fingerprint": "select c_custkey, 'len=' || length(c_name) || ' sha256=' || left(sha256(c_name), 12) || ' head=''' || left(c_name, 6) || ''' tail=''' || right(c_name, 4) || '''' fp from customer",
    "entity_type_parse": "select c_custkey, ['Person', 'Place', 'Unknown', 'Concept'][c_custkey % 4 + 1] kind from customer",
    "key_functions": "select doc_id, source || '|' || lang parts, n_chars::varchar n, true as valid, false as valid_tail from documents",
    "base64_functions": """select c_custkey, to_base64(encode(c_name)) plain, rtrim(translate(to_base64(encode(c_name)), '+/', '-_'), '=') url, c_name back, length(c_name)::bigint size, 'text/plain' mime,
      left(to_base64(encode(c_name)), 8) || '...(' || length(to_base64(encode(c_name))) || ' chars)' short from customer""",
    "int_to_base64url": """with h as (select o_orderkey, hex(o_orderkey * 65537 + 7) x from orders)
      select o_orderkey, rtrim(translate(to_base64(unhex(case when length(x) % 2 = 1 then '0' || x else x end)), '+/', '-_'), '=') coded from h""",
    "snake_case": """select p_partkey, lower(regexp_replace(regexp_replace(upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'HTTPServer' || p_size, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as name from part""",
    "durations": "select o_orderkey, case when o_orderkey * 997 >= 86400 then (o_orderkey * 997 // 86400) || 'd' else (o_orderkey * 997 // 3600) || 'h' end as text from orders",
    "salvage_json": "select event_id, case when event_id % 3 <> 0 then props end body from events",
    "flatten_json": "select event_id, user_id::varchar d, len(json_keys(props))::integer + 1 n from events",
    "find_text": "select doc_id, case when strpos(substr(text, 6), 'of  the') > 0 then strpos(substr(text, 6), 'of  the') + 4 when strpos(substr(text, 6), 'of the') > 0 then strpos(substr(text, 6), 'of the') + 4 else -1 end::integer place from documents",
    "typed_getters": "select event_id, user_id n, user_id % 2 = 0 flag, '-' as none from events",
    "retryable": "select event_id, event_id % 3 <> 1 again from events",
    "log_lines": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' INFO     app ' || event_type || ' user=' || user_id line from events",
    "evaluate_math": "select o_orderkey, ((o_orderkey + 3) * 2 // 5 - 1)::double as value from orders",
    "mime_extensions": "select c_custkey, ['.pdf', '.png', ''][c_custkey % 3 + 1] ext from customer",
    "stable_ids": "select c_custkey, 'id_' || left(sha256(c_custkey || chr(31) || c_name), 32) id from customer",
    "stream_usage": "select event_type as mode, count(*) requests, sum(floor(value))::bigint tokens from events, (select unnest(generate_series(0, 4)) k) group by event_type, time_bucket(interval '1 hour', ts) - k * interval '1 hour'",
}
