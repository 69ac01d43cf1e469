"""Queries over heading trees, source mappings and progress trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe import models
from folioframe.operators import lookup, progress, summary, tree
from folioframe.plans import model
from folioframe.sources.files import table


def heading_scan(spark, d):
    return tree.heading_scan(model.books(spark, d))


def _tree(spark, d):
    return tree.build_tree(model.books(spark, d))


def build_tree(spark, d):
    return _tree(spark, d).drop("path")


def preorder_tree(spark, d):
    return tree.preorder(_tree(spark, d)).select("id", "path", "position")


def own_text(spark, d):
    return tree.own_text(_tree(spark, d), model.books(spark, d)).select("id", F.sha2("body", 256).alias("body_hash"))


def subtree_text(spark, d):
    return tree.subtree_text(_tree(spark, d), model.books(spark, d)).select("id", F.length("text").alias("n"), F.sha2("text", 256).alias("text_hash"))


def parents(spark, d):
    return tree.parents(build_tree(spark, d))


def nodes_at_level(spark, d):
    return tree.at_level(_tree(spark, d), 1).select("id", "order_index", "path")


def tree_roots(spark, d):
    return tree.roots(_tree(spark, d)).select("id", "content_length")


def _broken(spark, d):
    """The trees with nodes whose parent, level or order is wrong, or that are their own parents."""
    n = F.col("book_id") * 31 + F.substring_index("id", "/", -1).cast("long")
    return build_tree(spark, d).withColumns({
        "parent_id": F.when((F.col("level") == 2) & (n % 11 == 0), "nowhere").when((F.col("level") == 1) & (n % 23 == 0), F.col("id")).otherwise(F.col("parent_id")),
        "level": F.when((F.col("level") == 1) & (n % 13 == 0), 0).otherwise(F.col("level")),
        "order_index": F.when((F.col("level") == 1) & (n % 17 == 0), 0).otherwise(F.col("order_index")),
        "content_length": F.when(n % 19 == 0, -1).otherwise(F.col("content_length"))})


def tree_violations(spark, d):
    return tree.violations(_broken(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))


def tree_valid(spark, d):
    return tree.violations(_tree(spark, d), model.books(spark, d))


def toc(spark, d):
    items = model.docs(spark, d).select("doc_id", F.col("text").alias("title"), (F.col("doc_id") % 4 - 1).cast("int").alias("level"))
    return tree.toc(items)


def tree_replay(spark, d):
    """The trees rebuilt from the log of operations that would make them."""
    n = build_tree(spark, d).filter("parent_id <> ''").select("book_id", F.lit(1).alias("chunk"), F.substring_index("id", "/", -1).cast("int").alias("seq"), F.lit("open").alias("op"), "level", "title",
                                                             F.col("content_offset").alias("start"), (F.col("content_offset") + F.col("content_length")).alias("stop"))
    root = model.books(spark, d).select("book_id", F.lit(0).alias("chunk"), F.lit(0).alias("seq"), F.lit("rollback").alias("op"), F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    return tree.replay(root.unionByName(n)).filter("parent_id <> ''").select("id", "parent_id", "level", "order_index", "title", "content_offset", "content_length")


def tree_summary(spark, d):
    few = build_tree(spark, d)
    return summary.summarise_tree(few, model.books(spark, d), models.summarise)


def _lines(spark, d):
    """The lines of each document as intervals, and each pair of lines as one more."""
    rows = tree.each_text(model.docs(spark, d), "doc_id", "text", _line_rows, [("content_offset", tree.T.LongType()), ("content_length", tree.T.LongType()), ("page_index", tree.T.IntegerType())])
    return rows.withColumnRenamed("doc_id", "book_id")


def _line_rows(text):
    at = 0
    for i, line in enumerate(text.split("\n")):
        yield at, len(line), i
        at += len(line) + 1


def offset_lookup(spark, d):
    points = model.docs(spark, d).select(F.col("doc_id").alias("book_id"), F.explode(F.expr("transform(sequence(0, 9), k -> k * length(text) div 10)")).alias("offset"))
    return lookup.lookup(points, _lines(spark, d)).select("book_id", "offset", "content_offset", "page_index")


def page_lookup(spark, d):
    return lookup.on_page(_lines(spark, d), 7, 1).select("book_id", "content_offset", "content_length")


def progress_rollup(spark, d):
    """Regions, nations and customers as tasks: a customer's total is its balance, the others sum up."""
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("seq"), F.lit(0.0).alias("total"), F.lit(True).alias("auto_total"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("seq"), F.lit(0.0).alias("total"), F.lit(True).alias("auto_total"))
    people = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 100 + 1.0).alias("total"), F.lit(False).alias("auto_total"))
    tasks = region.unionByName(nation).unionByName(people).withColumns({"completed": F.floor(F.col("total") / 2).cast("double"), "label": F.col("id"), "status": F.lit("running"), "started_at": F.lit(100.0)})
    return progress.rollup(tasks, 150.0).select("id", "depth", "total", "completed", F.round("eta_seconds", 6).alias("eta"))


QUERIES = {
    "heading_scan": heading_scan, "build_tree": build_tree, "preorder_tree": preorder_tree, "own_text": own_text, "subtree_text": subtree_text, "parents": parents,
    "nodes_at_level": nodes_at_level, "tree_roots": tree_roots, "tree_violations": tree_violations, "tree_valid": tree_valid, "toc_items": toc, "tree_replay": tree_replay,
    "tree_summary": tree_summary, "offset_lookup": offset_lookup, "page_lookup": page_lookup, "progress_rollup": progress_rollup,
}

_LINES = f"""{model.BOOKS},
l0 as (select book_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i, length(text) total from books),
l as (select *, sum(length(line) + 1) over (partition by book_id order by i) - length(line) - 1 off0 from l0),
h as (select book_id, off0::bigint off0, length(line) size, total, length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1)) raw, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2)) title
  from l where regexp_matches(line, '^(#{{1,6}})\\s+(.+)$')),
k as (select *, case raw when 1 then 1 else 2 end lv, row_number() over (partition by book_id order by off0) seq, coalesce(lead(off0) over (partition by book_id order by off0), total) nxt from h),
p as (select *, case when lv = 1 then 0 else coalesce(max(case when lv = 1 then seq end) over (partition by book_id order by seq rows between unbounded preceding and 1 preceding), 0) end up from k),
nodes as (select book_id || '/' || seq id, book_id, book_id || '/' || up parent_id, lv::integer level, (row_number() over (partition by book_id, up order by seq) - 1)::integer order_index, title,
    off0 title_offset, size title_length, least(off0 + size + 1, total) content_offset, greatest(0, nxt - least(off0 + size + 1, total)) content_length, seq, up from p
  union all select b.book_id || '/0', b.book_id, '', 0, 0, '', 0, 0, 0, coalesce((select min(off0) from h where h.book_id = b.book_id), length(b.text)), 0, null from books b),
paths as (select n.*, case when n.seq = 0 then '000000' when n.up = 0 then '000000.' || lpad(n.order_index::varchar, 6, '0')
    else '000000.' || lpad(u.order_index::varchar, 6, '0') || '.' || lpad(n.order_index::varchar, 6, '0') end path
  from nodes n left join nodes u on u.id = n.parent_id)"""
_DOC_LINES = """l0 as (select doc_id book_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
l as (select book_id, (sum(length(line) + 1) over (partition by book_id order by i) - length(line) - 1)::bigint content_offset, length(line)::bigint content_length, (i - 1)::integer page_index from l0)"""
_NODE = "id, book_id, parent_id, level, order_index, title, title_offset::bigint title_offset, title_length::bigint title_length, content_offset::bigint content_offset, content_length::bigint content_length"
#: The first two sentences of a text, and a node's own text with the lines of its children.
_FIRST = "trim(array_to_string(regexp_extract_all({}, '[^.。!?]*[.。!?]|[^.。!?]+$')[1:2], ''))"
_SUMMED = "concat_ws(chr(10) || chr(10), case when trim(body) <> '' then body end, below)"

ORACLES = {
    "heading_scan": f"with {_LINES} select book_id, off0 line_offset, raw::integer raw_level, title, lv::integer level from k",
    "build_tree": f"with {_LINES} select {_NODE} from nodes",
    "preorder_tree": f"with {_LINES} select id, path, (row_number() over (partition by book_id order by path) - 1)::integer as position from paths",
    "own_text": f"with {_LINES} select n.id, sha256(substr(b.text, n.content_offset::bigint + 1, n.content_length::bigint)) body_hash from nodes n join books b using (book_id)",
    "subtree_text": f"""with {_LINES}, o as (select n.book_id, n.path, substr(b.text, n.content_offset::bigint + 1, n.content_length::bigint) body from paths n join books b using (book_id)),
      s as (select a.id, string_agg(o.body, '' order by o.path) as t from paths a join o on o.book_id = a.book_id and (o.path = a.path or starts_with(o.path, a.path || '.')) group by a.id)
      select id, length(t)::integer n, sha256(t) text_hash from s""",
    "parents": f"with {_LINES} select n.id, nullif(n.parent_id, '') parent_id, u.title parent_title from nodes n left join nodes u on u.id = n.parent_id",
    "nodes_at_level": f"with {_LINES} select id, order_index, path from paths where level = 1",
    "tree_roots": f"with {_LINES} select id, content_length::bigint content_length from nodes where seq = 0",
    "tree_replay": f"with {_LINES} select id, parent_id, level, order_index, title, content_offset::bigint content_offset, content_length::bigint content_length from nodes where seq > 0",
    "tree_violations": f"""with {_LINES}, b as (select id, book_id, level old, case when level = 2 and (book_id * 31 + seq) % 11 = 0 then 'nowhere' when level = 1 and (book_id * 31 + seq) % 23 = 0 then id else parent_id end parent_id,
        case when level = 1 and (book_id * 31 + seq) % 13 = 0 then 0 else level end level, case when level = 1 and (book_id * 31 + seq) % 17 = 0 then 0 else order_index end order_index,
        case when (book_id * 31 + seq) % 19 = 0 then -1 else content_length end content_length from nodes),
      v as (select 'negative length' problem from b where content_length < 0 union all select 'missing parent' from b where parent_id = 'nowhere'
        union all select 'level order' from b join b u on u.id = b.parent_id where b.level <= u.level
        union all select 'sibling order' from (select count(*) over (partition by book_id, parent_id, order_index) n from b where parent_id <> '') where n > 1
        union all select 'cycle' from b left join b u on u.id = b.parent_id where b.parent_id = b.id or u.parent_id = u.id)
      select problem, count(*) n from v group by problem""",
    "tree_valid": "select doc_id book_id, '' id, '' problem from documents where false",
    "toc_items": """select doc_id, text as title, greatest(doc_id % 4 - 1, 1)::integer level from documents where trim(text) <> ''""",
    "tree_summary": f"""with {_LINES}, own as (select n.*, substr(b.text, n.content_offset::bigint + 1, n.content_length::bigint) body from nodes n join books b using (book_id)),
      s2 as (select *, {_FIRST.format("case when trim(body) <> '' then body else '' end")} s from own where level = 2),
      b1 as (select parent_id, string_agg('[' || title || '] ' || s, chr(10) order by order_index) below from s2 where s <> '' group by 1),
      s1 as (select o.*, {_FIRST.format(_SUMMED)} s from own o left join b1 b on b.parent_id = o.id where level = 1),
      b0 as (select parent_id, string_agg('[' || title || '] ' || s, chr(10) order by order_index) below from (select * from s2 union all select * from s1) where s <> '' group by 1),
      s0 as (select o.*, {_FIRST.format(_SUMMED)} s from own o left join b0 b on b.parent_id = o.id where level = 0)
      select book_id, id node_id, s summary from (select * from s2 union all select * from s1 union all select * from s0) where s <> ''""",
    "offset_lookup": f"""with {_DOC_LINES}, q as (select doc_id book_id, k * length(text) // 10 as "offset" from documents, (select unnest(generate_series(0, 9)) k))
      select q.book_id, q."offset"::bigint as "offset", l.content_offset, l.page_index from q join l on l.book_id = q.book_id and l.content_offset <= q."offset" and l.content_offset + l.content_length > q."offset" """,
    "page_lookup": f"with {_DOC_LINES} select book_id, content_offset, content_length from l where book_id = 7 and page_index = 1",
    "progress_rollup": """with c as (select 'c' || c_custkey id, 'n' || c_nationkey p, c_custkey % 100 + 1.0::double total, floor((c_custkey % 100 + 1) / 2.0)::double completed from customer),
      n as (select 'n' || n_nationkey id, 'r' || n_regionkey p, sum(total) total, sum(completed) completed from nation left join c on c.p = 'n' || n_nationkey group by all),
      r as (select 'r' || r_regionkey id, sum(total) total, sum(completed) completed from region left join n on n.p = 'r' || r_regionkey group by all),
      a as (select id, 2 depth, total, completed from c union all select id, 1, coalesce(total, 0), coalesce(completed, 0) from n union all select id, 0, coalesce(total, 0), coalesce(completed, 0) from r)
      select id, depth::integer depth, total::double total, completed::double completed, round(case when total > 0 and completed > 0 then greatest(0.0, (total - completed) / (completed / 50.0::double)) end, 6) eta from a""",
}
