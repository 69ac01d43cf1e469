"""Queries that read archives: EPUB books and layout archives that Spark makes of the documents, one each."""

from __future__ import annotations

import io
import json
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.plans import model
from folioframe.sources import epub, pdf
from folioframe.sources.files import FILES_TOLD

CHAPTERS = 3
#: What a chapter's lines become, in turn.
SHAPES = (
    '<h2 id="n{i}">{t}</h2>', '<p id="n{i}">see <strong>{t}</strong></p>', '<blockquote id="n{i}"><p>{t}</p><p>end</p></blockquote>', '<pre id="n{i}">{t}</pre>',
    '<ul><li id="n{i}">item {t}</li></ul>', '<p id="n{i}"><a href="next.xhtml?n=1&amp;k=2">{t}</a></p>', '<p id="n{i}">{t}<br/><em>again</em></p>', '<figure id="n{i}"><img src="i.png" alt="{t}"/></figure>')


def _zip(members: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in members:
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _book(doc_id: int, lang: str, source: str, text: str) -> bytes:
    """An EPUB whose chapter c has the lines c, c + 3, ...; its manifest has another order than its spine, the spine names
    an item that is not in the manifest, and the manifest a file that is not in the archive."""
    lines = text.split("\n")
    chapters = ["<html><body>" + "".join(SHAPES[i // CHAPTERS % len(SHAPES)].format(i=i, t=escape(lines[i])) for i in range(c, len(lines), CHAPTERS)) + "</body></html>" for c in range(CHAPTERS)]
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'
        f"<dc:title>{escape(lines[0])}</dc:title><dc:creator>{escape(source)}</dc:creator><dc:language>{escape(lang)}</dc:language><dc:identifier>urn:uuid:{doc_id}</dc:identifier>"
        + (f"<dc:identifier>urn:ISBN:{doc_id}</dc:identifier>" if doc_id % 2 == 0 else "")
        + '</metadata><manifest><item id="c2" href="text/c%202.xhtml"/><item id="lost" href="text/lost.xhtml"/><item id="c0" href="text/c%200.xhtml"/><item id="c1" href="text/c%201.xhtml"/></manifest>'
        '<spine><itemref idref="c0"/><itemref idref="ghost"/><itemref idref="c2"/><itemref idref="lost"/><itemref idref="c1"/></spine></package>')
    container = '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    data = _zip([("META-INF/container.xml", container), ("OEBPS/book.opf", package), *[(f"OEBPS/text/c {c}.xhtml", t) for c, t in enumerate(chapters)]])
    return data[:len(data) // 2] if doc_id % 10 == 9 else data


def _layouts(text: str) -> bytes:
    """A result archive: its Markdown, a layout that is cut short, one that a later layout replaces, and this one, which has a page
    for each line, in turn with spans of its own and with spans in lines of nested blocks."""
    pages = []
    for i, line in enumerate(text.split("\n")):
        span = {"bbox": [0, i, 10, 20], "content": line}
        pages.append({"page_idx": i, "spans": [span]} if i % 2 == 0 else {"page_no": i, "para_blocks": [{"blocks": [{"lines": [{"spans": [span]}]}]}]})
    whole = json.dumps({"pdf_info": pages})
    early = json.dumps([{"page_idx": 0, "spans": [{"bbox": [0, 0, 1, 1], "content": "early"}]}])
    return _zip([("out/full.md", text), ("out/early_layout.json", early), ("out/middle.json", whole), ("out/short_layout.json", whole[:len(whole) // 2]), ("out/notes.md", "notes")])


def _made(docs: DataFrame, make) -> DataFrame:
    """(path, content): an archive for each document."""
    def run(batches):
        for batch in (whole.iloc[at:at + FILES_TOLD] for whole in batches for at in range(0, len(whole), FILES_TOLD)):
            yield pd.DataFrame({"path": batch["path"], "content": [make(*r) for r in batch.drop(columns="path").fillna("").itertuples(index=False)]})
    return docs.withColumn("path", F.col("doc_id").cast("string")).mapInPandas(run, "path string, content binary")


def _books(spark, d) -> DataFrame:
    return epub.parse(_made(model.docs(spark, d).select("doc_id", "lang", "source", "text"), _book))


def _archives(spark, d) -> DataFrame:
    found = pdf.unpacked(_made(model.docs(spark, d).select("doc_id", "text"), lambda _, t: _layouts(t)))
    return found.select(F.col("path").cast("long").alias("book_id"), F.lit(0).alias("batch"), F.lit(0).alias("first"), "markdown", "layout", "error")


def epub_metadata(spark, d):
    return _books(spark, d).select("path", "title", "author", "language", "publisher", "isbn", "description", (F.col("error") != "").alias("unreadable"))


def epub_text(spark, d):
    return _books(spark, d).select("path", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def epub_mappings(spark, d):
    return _books(spark, d).select("path", F.explode("mappings").alias("m")).select("path", "m.*")


def archive_spans(spark, d):
    return pdf.layout_spans(_archives(spark, d)).select("book_id", "page_index", "y0", "content")


def archive_reports(spark, d):
    """Whether a member of an archive could not be read, and what was taken all the same."""
    return _archives(spark, d).select("book_id", F.sha2("markdown", 256).alias("markdown_hash"), F.col("error").startswith("out/short_layout.json: JSONDecodeError").alias("told"), (F.col("layout") != "").alias("laid_out"))


def located_spans(spark, d):
    return pdf.span_mappings(_archives(spark, d)).select("book_id", "content_offset", "content_length", "page_index", "y0")


QUERIES = {"epub_metadata": epub_metadata, "epub_text": epub_text, "epub_mappings": epub_mappings, "archive_spans": archive_spans, "archive_reports": archive_reports, "located_spans": located_spans}

_LINES = """lines as (select doc_id, i - 1 i, l, regexp_replace(l, '^\\s+|\\s+$', '', 'g') t from (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents))"""
#: Lines as blocks of chapters, in the order of the spine, with the Markdown of each.
_BLOCKS = f"""{_LINES}, shaped as (select *, i % 3 chapter, (i // 3) % 8 shape from lines where doc_id % 10 <> 9),
blocks as (select *, case chapter when 0 then 0 when 2 then 1 else 3 end spine_index,
  case shape when 0 then 'h2' when 2 then 'blockquote' when 3 then 'pre' when 4 then 'li' when 7 then 'figure' else 'p' end tag,
  case shape when 0 then case when t = '' then '' else '## ' || t || chr(10) || chr(10) end
    when 1 then 'see **' || l || '**' || chr(10) || chr(10)
    when 2 then case when t = '' then '' else '> ' || t || chr(10) end || '> end' || chr(10) || chr(10)
    when 3 then '```' || chr(10) || l || chr(10) || '```' || chr(10) || chr(10)
    when 4 then '- ' || regexp_replace('item ' || l, '\\s+$', '') || chr(10)
    when 5 then '[' || l || '](next.xhtml?n=1&k=2)' || chr(10) || chr(10)
    when 6 then regexp_replace(l || chr(10) || '*again*', '^\\s+', '') || chr(10) || chr(10)
    else '![' || l || '](i.png)' || chr(10) || chr(10) end m from shaped)"""
ORACLES = {
    "epub_metadata": f"""with {_LINES} select doc_id::varchar path, case when bad then '' else t end title, case when bad then '' else coalesce(source, '') end author,
      case when bad then '' else coalesce(lang, '') end as language, '' publisher, case when bad then '' when doc_id % 2 = 0 then 'urn:ISBN:' || doc_id else 'urn:uuid:' || doc_id end isbn,
      '' description, bad unreadable from (select *, doc_id % 10 = 9 bad from documents join lines using (doc_id) where i = 0)""",
    "epub_text": f"""with {_BLOCKS}, whole as (select doc_id, string_agg(m, '' order by spine_index, i) m from blocks group by 1)
      select doc_id::varchar path, length(coalesce(m, '')) n_chars, sha256(coalesce(m, '')) text_hash from documents left join whole using (doc_id)""",
    "epub_mappings": f"""with {_BLOCKS}, placed as (select *, coalesce(sum(length(m)) over (partition by doc_id order by spine_index, i rows between unbounded preceding and 1 preceding), 0) lo,
      row_number() over (partition by doc_id, chapter, tag order by i) n, count(*) filter (m <> '') over (partition by doc_id, chapter order by i) e from blocks)
      select doc_id::varchar path, lo::bigint content_offset, length(m) content_length, 'text/c%20' || chapter || '.xhtml' href, spine_index, tag element_tag, (e - 1)::integer element_index, 'n' || i element_id,
      case tag when 'li' then '/ul[' || n || ']' else '' end || '/' || tag || '[' || n || ']' element_path from placed where m <> ''""",
    "archive_spans": f"with {_LINES} select doc_id book_id, i::integer page_index, i::double y0, l as content from lines where l <> ''",
    "archive_reports": "select doc_id book_id, sha256(coalesce(text, '')) markdown_hash, true told, true laid_out from documents",
    "located_spans": f"""with {_LINES}, placed as (select *, sum(length(l) + 1) over (partition by doc_id order by i) - length(l) - 1 + length(l) - length(regexp_replace(l, '^\\s+', '')) lo from lines)
      select doc_id book_id, lo::bigint content_offset, length(t) content_length, i::integer page_index, i::double y0 from placed where t <> ''""",
}
