"""Queries over texts: chunks, fragments, tags, full-text search, markup."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.operators import fts, text, textindex
from folioframe.plans import model
from folioframe.sources import markup, pdf
from folioframe.sources.files import shared_dir, table


def chunk_documents(spark, d):
    return text.chunks(model.docs(spark, d))


def graph_chunks(spark, d):
    return text.graph_chunks(model.docs(spark, d))


def _budget_sql(budget: int, step: str) -> str:
    rfind = lambda p: f"case when contains(w, {p}) then length(w) - strpos(reverse(w), reverse({p})) + 1 - length({p}) + low else -1 end"
    return f"""
with recursive r as (
  select doc_id, text as t, 0::bigint pos, -1 idx, 0::bigint cut, 0::bigint nxt, false done from documents where length(text) > 0
  union all
  select doc_id, t, pos, idx, cut, pos + {step}, tok <= {budget} from (
    select doc_id, t, pos, idx, tok, case when tok <= {budget} then n when pp > 0 then pp + 2 when sp > 0 then sp + 1 when np > 0 then np + 1 else est end cut from (
      select *, {rfind("chr(10) || chr(10)")} pp, case when contains(w, '。') then {rfind("'。'")} else {rfind("'.'")} end sp, {rfind("chr(10)")} np from (
        select *, substr(t, pos + low + 1, least(n, est + 200) - low) w from (
          select *, greatest(0, est - 200) low from (
            select *, greatest(100, least(trunc(n * {budget}.0::double / tok)::bigint, n)) est from (
              select doc_id, t, nxt pos, idx + 1 idx, length(t) - nxt n, greatest(1, (length(t) - nxt) // 4) tok from r
              where nxt < length(t) and not done))))))
)
select doc_id, idx::integer chunk_index, pos content_offset, cut content_length, substr(t, pos + 1, cut) chunk_text from r where idx >= 0"""


BUILDER_SQL = """
with recursive r as (
  select doc_id, text as t, -1 idx, 0::bigint pos, 0::bigint stop from documents where length(text) > 0
  union all
  select doc_id, t, idx, pos, case when e >= length(t) then e when contains(w, chr(10)) then low + length(w) - strpos(reverse(w), chr(10)) + 1 else e end from (
    select *, substr(t, low + 1, e - low) w from (select *, greatest(pos, e - 200) low from (
      select doc_id, t, idx + 1 idx, stop pos, least(stop + 3000, length(t)) e from r where stop < length(t))))
)
select doc_id, idx::integer chunk_index, pos content_offset, stop - pos content_length, substr(t, pos + 1, stop - pos) chunk_text from r where idx >= 0"""


def builder_chunks(spark, d):
    return text.builder_chunks(model.docs(spark, d))


def _paragraphed(spark, d):
    return model.docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


def summary_pack(spark, d):
    return text.summary_fragments(_paragraphed(spark, d), budget=100)


SUMMARY_SQL = """
with recursive p as (select doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)) ps from documents),
r as (select doc_id, ps, 1 i, 0 g, greatest(1, length(ps[1]) // 4) used from p
  union all select doc_id, ps, i + 1, case when used + c > 100 then g + 1 else g end, case when used + c > 100 then c else used + c end
  from (select *, greatest(1, length(ps[i + 1]) // 4) c from r where i < len(ps)))
select doc_id, g::integer fragment, length(string_agg(ps[i], chr(10) || chr(10) order by i)) length, string_agg(ps[i], chr(10) || chr(10) order by i) fragment_text
from r group by doc_id, g"""


def metadata_fragments(spark, d):
    return text.metadata_fragments(model.docs(spark, d))


METADATA_SQL = """
select doc_id, i::integer fragment, substr(text, i * 2000 + 1, 2000) fragment_text from documents, (select unnest(generate_series(0, 2)) i)
where i = 0 or i * 2000 < length(text)"""


def tagify(spark, d):
    return text.tagify(model.docs(spark, d))


TAG_SQL = """
with p as (select doc_id, text as t, regexp_extract_all(text, '[^。！？.!?;；:：\\n]*[。！？.!?;；:：\\n]') ps from documents),
o as (select doc_id, t, ps, list_transform(generate_series(1, len(ps)), lambda k: length(array_to_string(ps[1:k], ''))) ends from p)
select doc_id, array_to_string(list_transform(ps, lambda x, i: '<s' || (i - 1) || '/>' || x), '') || '<s' || len(ps) || '/>' ||
  substr(t, length(array_to_string(ps, '')) + 1) || '<s' || (len(ps) + 1) || '/>' tagged_text, (len(ps) + 2)::bigint n_tags,
  array_to_string(list_concat([0], list_concat(ends, [length(t)])), ',') tag_offsets from o"""


def token_estimate(spark, d):
    return model.docs(spark, d).groupBy("lang").agg(F.sum(text.estimate_tokens(F.col("text"))).cast("long").alias("tokens"), F.max(text.estimate_tokens(F.col("text"))).cast("long").alias("most"))


def neighbour_chars(spark, d):
    t, n = F.col("text"), F.length("text")
    mid = F.floor(n / 2).cast("int")
    return model.docs(spark, d).select("doc_id", text.neighbour(t, mid, mid, "prev").alias("before"), text.neighbour(t, mid, mid, "next").alias("after"))


_TOKENS = f"""t as (select doc_id, list_filter(regexp_split_to_array(translate(regexp_replace(lower(text), '{fts.MARKS}', '', 'g'), '{fts.MARKED}', '{fts.PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') ts from documents)"""


def _search(query, columns=()):
    return lambda spark, d: fts.search(fts.postings(model.docs(spark, d), "doc_id", "text"), "doc_id", query, columns)


def fts_index(spark, d):
    """The documents and places of each token."""
    per = fts.postings(model.docs(spark, d), "doc_id", "text").groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("documents"), F.sum("n").alias("places"))


def fts_stored(spark, d):
    """A search of an index that is written first."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    fts.write_index(fts.postings(model.docs(spark, d), "doc_id", "text"), path, "doc_id")
    return fts.search(spark.read.parquet(path), "doc_id", "with that from")


_TITLED = ["title", "text"]


def _titled(spark, d):
    """Each document with its first line as its title, ten to a book."""
    return model.docs(spark, d).select("doc_id", (F.floor(F.col("doc_id") / 10)).alias("book_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "text")


def fts_column(spark, d):
    """A search of two columns."""
    return fts.search(fts.postings(_titled(spark, d), "doc_id", _TITLED), "doc_id", "text : (with that) NOT title : with OR {title} : from*", tuple(_TITLED))


_KEPT_UP = "title : renamed OR text : (with that) NOT text : from"


def _kept_up(spark, d):
    """An index of all documents in which a third of the books was replaced by others and a seventh deleted."""
    docs = _titled(spark, d)
    index = textindex.TextIndex(spark, f"{shared_dir(spark)}/kept-up-{uuid.uuid4().hex}", _TITLED, "doc_id", "book_id", "long long")
    index.put(docs)
    index.put(docs.filter("book_id % 3 = 1 and doc_id % 2 = 0").select("doc_id", "book_id", F.lit("Renamed").alias("title"), F.concat(F.lit("without "), "text").alias("text")))
    index.delete(docs.filter("book_id % 7 = 2").select("book_id"))
    return index


def index_replace(spark, d):
    """A search of an index after writes."""
    return _kept_up(spark, d).search(_KEPT_UP)


def index_merged(spark, d):
    """A search of an index that was merged into one segment and then written again."""
    index = _kept_up(spark, d)
    index.merge()
    index.put(_titled(spark, d).filter("book_id % 11 = 5"))
    return index.search(_KEPT_UP)


def flagship(spark, d):
    """Chunk the documents, index the chunks, and find the first that hold two words."""
    chunks = text.chunks(model.docs(spark, d)).withColumn("chunk_id", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")))
    found = fts.search_chunks(fts.postings(chunks, "chunk_id", "chunk_text"), chunks, "with that", 100)
    return found.select("chunk_id", "doc_id", "chunk_index", "content_offset", "content_length")


def citations(spark, d):
    answer = F.concat(F.lit("see <chunk c"), F.col("doc_id"), F.lit("/> and <entity e"), F.col("doc_id") % 7, F.lit("/>"))
    return model.docs(spark, d).select("doc_id", F.array_join(text.citations(answer), ",").alias("cited"))


def html_to_markdown(spark, d):
    return markup.to_markdown(table(spark, d, "pages"))


def element_mappings(spark, d):
    return markup.element_mappings(table(spark, d, "pages"))


def page_batches(spark, d):
    return pdf.plan_batches(table(spark, d, "pages").select("page_id", (F.col("page_id") * 37 % 700).alias("pages"))).select("page_id", "batch", "first", "stop")


def _layouts(spark, d):
    """documents as layout JSON: a page for each line, the whole of it as one span."""
    span = lambda x, i: F.struct(i.alias("page_idx"), F.array(F.struct(F.array(F.lit(0.0), i.cast("double"), F.lit(10.0), F.lit(20.0)).alias("bbox"), x.alias("content"))).alias("spans"))
    pages = F.transform(F.split("text", "\n"), span)
    return model.docs(spark, d).select(F.col("doc_id").alias("book_id"), F.lit(0).alias("batch"), F.lit(0).alias("first"), F.col("text").alias("markdown"), F.to_json(F.struct(pages.alias("pdf_info"))).alias("layout"))


def layout_spans(spark, d):
    return pdf.layout_spans(_layouts(spark, d)).select("book_id", "page_index", "y0", "content")


def locate_spans(spark, d):
    return pdf.span_mappings(_layouts(spark, d)).groupBy("book_id").agg(F.count("*").alias("n"), F.min("content_offset").alias("low"), F.max("content_offset").alias("high"))


QUERIES = {
    "chunk_documents": chunk_documents, "graph_chunks": graph_chunks, "builder_chunks": builder_chunks, "summary_pack": summary_pack,
    "metadata_fragments": metadata_fragments, "tagify": tagify, "token_estimate": token_estimate, "neighbour_chars": neighbour_chars, "fts_chunks": flagship,
    "fts_and": _search("with that from"), "fts_or_not": _search("(idiot OR moron) NOT clown"), "fts_phrase": _search('"of the"'), "fts_prefix": _search("worth*"),
    "fts_near": _search("NEAR(with from, 3)"), "fts_first": _search("^the OR ^la OR ^der"), "fts_column": fts_column, "index_replace": index_replace, "index_merged": index_merged,
    "fts_index": fts_index, "fts_stored": fts_stored, "citations": citations, "html_to_markdown": html_to_markdown, "element_mappings": element_mappings, "page_batches": page_batches,
    "layout_spans": layout_spans, "locate_spans": locate_spans,
}

_HAS = "select doc_id from t where "
#: The blocks of the test pages with their Markdown: links of a list, a heading, and paragraphs, of which some hold bold text that
#: is closed by the next paragraph only.
_PAGE_BLOCKS = r"""article as (select page_id, html, split_part(split_part(html, '<article>', 2), '</article>', 1) a from pages),
found as (
  select page_id, 'li' tag, generate_subscripts(x, 1) n, '/nav[1]/ul[1]' above, '- [' || unnest(x) || '](' || unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) || ')' || chr(10) m
    from (select *, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) x from article)
  union all select page_id, 'h1', 1, '/article[1]', '# ' || trim(regexp_extract(a, '<h1>([^<]*)</h1>', 1)) || chr(10) || chr(10) from article
  union all select page_id, 'p', n, '/article[1]', case when t = '' then '' else t || chr(10) || chr(10) end from (
    select page_id, n, case when x like '<b>%' then '**' || regexp_extract(x, '^<b>(.*)<br>', 1) || chr(10) || '**' else trim(replace(x, '</p>', '')) end t from (
      select page_id, generate_subscripts(x, 1) n, unnest(x) x from (select page_id, string_split(a, '<p>')[2:] x from article)))),
plain as (select * replace (replace(replace(replace(replace(m, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as m), case tag when 'li' then 0 when 'h1' then 1 else 2 end place from found)"""
_LIST = f"""list_filter(regexp_split_to_array(translate(regexp_replace(lower({{}}), '{fts.MARKS}', '', 'g'), '{fts.MARKED}', '{fts.PLAIN}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{M}}}}]+'), lambda x: x <> '')"""


def _columns(source: str, title: str) -> str:
    return f"t as (select doc_id, {_LIST.format(title)} title, {_LIST.format('text')} ts from {source})"


_KEPT_SQL = f"""changed as (select doc_id, case when doc_id // 10 % 3 = 1 then 'renamed' else split_part(text, chr(10), 1) end title, case when doc_id // 10 % 3 = 1 then 'without ' else '' end || text as text from live),
  {_columns("changed", "title")} {_HAS} list_contains(title, 'renamed') or list_contains(ts, 'with') and list_contains(ts, 'that') and not list_contains(ts, 'from')"""
ORACLES = {
    "chunk_documents": _budget_sql(500, "greatest(1, cut - 200)"), "graph_chunks": _budget_sql(1000, "cut"), "builder_chunks": BUILDER_SQL, "summary_pack": SUMMARY_SQL,
    "metadata_fragments": METADATA_SQL, "tagify": TAG_SQL,
    "token_estimate": "select lang, sum(greatest(1, length(text) // 4))::bigint tokens, max(greatest(1, length(text) // 4))::bigint most from documents group by lang",
    "neighbour_chars": "select doc_id, substr(text, greatest(0, length(text) // 2 - 50) + 1, length(text) // 2 - greatest(0, length(text) // 2 - 50)) as before, substr(text, length(text) // 2 + 1, 50) as after from documents",
    "fts_chunks": f"""with c as ({_budget_sql(500, "greatest(1, cut - 200)")}),
      t as (select *, lpad(doc_id::varchar, 12, '0') || '/' || lpad(chunk_index::varchar, 6, '0') chunk_id,
        list_filter(regexp_split_to_array(translate(regexp_replace(lower(chunk_text), '{fts.MARKS}', '', 'g'), '{fts.MARKED}', '{fts.PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') ts from c)
      select chunk_id, doc_id, chunk_index, content_offset, content_length from t where list_contains(ts, 'with') and list_contains(ts, 'that') order by chunk_id limit 100""",
    "fts_and": f"with {_TOKENS} {_HAS} list_contains(ts, 'with') and list_contains(ts, 'that') and list_contains(ts, 'from')",
    "fts_or_not": f"with {_TOKENS} {_HAS} (list_contains(ts, 'idiot') or list_contains(ts, 'moron')) and not list_contains(ts, 'clown')",
    "fts_phrase": f"with {_TOKENS} {_HAS} contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ')",
    "fts_near": f"""with {_TOKENS}, p as (select doc_id, unnest(ts) w, generate_subscripts(ts, 1) i from t where list_contains(ts, 'with') and list_contains(ts, 'from'))
      select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.w = 'with' and b.w = 'from' and abs(a.i - b.i) <= 4""",
    "fts_first": f"with {_TOKENS} {_HAS} ts[1] in ('the', 'la', 'der')",
    "fts_column": f"""with {_columns("documents", "split_part(text, chr(10), 1)")} {_HAS} list_contains(ts, 'with') and list_contains(ts, 'that') and not list_contains(title, 'with')
      or len(list_filter(title, lambda x: starts_with(x, 'from'))) > 0""",
    "index_replace": f"""with live as (select * from documents where doc_id // 10 % 7 <> 2 and (doc_id // 10 % 3 <> 1 or doc_id % 2 = 0)), {_KEPT_SQL}""",
    "index_merged": f"""with live as (select * from documents where doc_id // 10 % 11 = 5 or doc_id // 10 % 7 <> 2 and (doc_id // 10 % 3 <> 1 or doc_id % 2 = 0)), {_KEPT_SQL.replace("% 3 = 1", "% 3 = 1 and doc_id // 10 % 11 <> 5")}""",
    "fts_stored": f"with {_TOKENS} {_HAS} list_contains(ts, 'with') and list_contains(ts, 'that') and list_contains(ts, 'from')",
    "fts_index": f"with {_TOKENS}, p as (select doc_id, unnest(ts) token from t) select token, count(distinct doc_id) documents, count(*) places from p group by token",
    "fts_prefix": f"with {_TOKENS} {_HAS} len(list_filter(ts, lambda x: starts_with(x, 'worth'))) > 0",
    "citations": "select doc_id, 'c' || doc_id || ',e' || (doc_id % 7) cited from documents",
    "page_batches": """select page_id, b::integer batch, (b * 190)::integer as first, least(b * 190 + 190, page_id * 37 % 700) stop
      from pages, (select unnest(generate_series(0, 10)) b) where b = 0 or b * 190 < page_id * 37 % 700""",
    "html_to_markdown": f"""with {_PAGE_BLOCKS} select page_id, string_agg(m, '' order by place, n) markdown, count(*) filter (m <> '') n_elements from plain group by 1""",
    "element_mappings": f"""with {_PAGE_BLOCKS}, placed as (select *, coalesce(sum(length(m)) over (partition by page_id order by place, n rows between unbounded preceding and 1 preceding), 0) lo,
      count(*) filter (m <> '') over (partition by page_id order by place, n) e from plain)
      select page_id, lo::bigint content_offset, length(m) content_length, tag element_tag, (e - 1)::integer element_index, '' element_id, above || '/' || tag || '[' || n || ']' element_path from placed where m <> ''""",
    "locate_spans": """with lines as (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
      placed as (select *, sum(length(l) + 1) over (partition by doc_id order by i) - 1 - length(regexp_replace(l, '^\\s+', '')) lo from lines)
      select doc_id book_id, count(*) n, min(lo)::bigint low, max(lo)::bigint high from placed where regexp_replace(l, '\\s+', '', 'g') <> '' group by 1""",
    "layout_spans": """select doc_id book_id, (i - 1)::integer page_index, (i - 1)::double y0, l as content
      from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents) where l <> ''""",
}
