"""PDF books as a source: page batches, layout JSON, and locating its spans in the Markdown."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.sources.files import FILES_TOLD, short_batches

PAGES, SNIPPET = 190, 30
#: Keys under which layouts hold their pages, and pages their number, in order of preference; fixed values.
PAGE_LISTS, PAGE_NUMBERS = ("pdf_info", "data", "pages", "page_info"), ("page_idx", "page_id", "page_no")
SPAN = "page_index int, x0 double, y0 double, x1 double, y1 double, content string"
MAPPING = "content_offset long, content_length long, page_index int, x0 double, y0 double, x1 double, y1 double"


def plan_batches(books: DataFrame, pages: str = "pages", most: int = PAGES) -> DataFrame:
    """books with batch, first and stop of each batch of at most `most` pages; a book without pages has one, empty."""
    last = F.greatest(F.lit(0), F.ceil(F.col(pages) / most).cast("int") - 1)
    return books.withColumn("batch", F.explode(F.sequence(F.lit(0), last))).withColumn("first", F.col("batch") * most).withColumn(
        "stop", F.least(F.col("first") + most, F.col(pages)))


def unpack(data: bytes) -> tuple[str, str, str]:
    """(markdown, layout JSON, errors): of a result archive the first .md file, which may be empty, and the last layout or
    middle JSON that can be read; what cannot be read is told in errors, and an archive that is none has neither."""
    markdown, layout = None, ""
    errors = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                low = name.lower()
                try:
                    if low.endswith(".md") and markdown is None:
                        markdown = z.read(name).decode("utf-8", "replace")
                    elif low.endswith(".json") and ("layout" in low or "middle" in low):
                        found = z.read(name).decode("utf-8", "replace")
                        json.loads(found)
                        layout = found
                except MemoryError:  # says nothing about the member
                    raise
                except Exception as e:  # a member that is broken or encrypted
                    errors.append(f"{name}: {type(e).__name__}: {e}")
    except MemoryError:
        raise
    except Exception as e:
        errors.append(f"{type(e).__name__}: {e}")
    return markdown or "", layout, "; ".join(errors)


def unpacked(archives: DataFrame) -> DataFrame:
    """archives(content, ...) with markdown, layout and error, which is empty where all could be read."""
    short_batches(archives.sparkSession)

    @F.udf("struct<markdown:string,layout:string,error:string>")
    def run(data):
        return unpack(bytes(data or b""))
    return archives.withColumn("_u", run("content")).withColumns({k: F.col(f"_u.{k}") for k in ("markdown", "layout", "error")}).drop("_u", "content")


def read_layout(layout: str | None) -> tuple[list[tuple], str]:
    """(spans, error) of layout JSON; none and empty have neither."""
    try:
        return spans(json.loads(layout)) if layout else [], ""
    except Exception as e:  # no JSON, or values of other kinds than a layout has
        return [], f"{type(e).__name__}: {e}"


def _below(blocks) -> list:
    out: list = []
    for b in blocks if isinstance(blocks, list) else []:
        if isinstance(b, dict):
            out += b.get("spans") or []
            for line in b.get("lines") or []:
                out += (line.get("spans") or []) if isinstance(line, dict) else []
            out += _below(b.get("blocks"))
    return out


def spans(layout) -> list[tuple]:
    """(page, x0, y0, x1, y1, content) of a layout's spans, in order; spans without text or box are left out."""
    pages = layout if isinstance(layout, list) else next((layout[k] for k in PAGE_LISTS if isinstance(layout.get(k), list)), []) if isinstance(layout, dict) else []
    out = []
    for page in pages:
        if not isinstance(page, dict):
            continue
        number = int(next((page[k] for k in PAGE_NUMBERS if k in page), 0))
        for s in page.get("spans") or _below(page.get("para_blocks")):
            if not isinstance(s, dict):
                continue
            text, box = s.get("content", s.get("text", "")), s.get("bbox", s.get("box", [0.0] * 4))
            if text and isinstance(box, (list, tuple)) and len(box) >= 4:
                out.append((number, *map(float, box[:4]), str(text)))
    return out


def find_text(text: str, needle: str, start: int) -> int:
    """Where the needle, else the needle with single blanks, stands at or after start, or -1."""
    at = text.find(needle, start)
    return at if at >= 0 else text.find(" ".join(needle.split()), start)


def locate(found: list[tuple], text: str, base: int = 0, first_page: int = 0) -> list[tuple]:
    """(offset, length, page, box...) of the spans in a text, each looked for after the one before: whole, else its
    first SNIPPET characters; what is not found is left out."""
    out, at = [], 0
    for page, x0, y0, x1, y1, content in found:
        content = content.strip()
        for piece in (content, content[:SNIPPET].strip()):
            if piece and (place := find_text(text, piece, at)) >= 0:
                out.append((base + place, len(piece), page + first_page, x0, y0, x1, y1))
                at = place + len(piece)
                break
    return out


def _flat(df: DataFrame, keys: list[str], schema: str, rows) -> DataFrame:
    """The rows of each row of df, a few at a time."""
    short_batches(df.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in (whole.iloc[at:at + FILES_TOLD] for whole in batches for at in range(0, len(whole), FILES_TOLD)):
            out = [(*[r[k] for k in keys], *row) for r in batch.to_dict("records") for row in rows(r)]
            yield pd.DataFrame(out, columns=[*keys, *names]).astype(object) if out else pd.DataFrame(columns=[*keys, *names])

    return df.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema]))


def _by_mode(errors: str, found: list[tuple], error: str, width: int) -> list[tuple]:
    if error and errors == "fail":
        raise ValueError(error)
    return [(*([None] * width), error)] if error and errors == "keep" else [(*x, "") for x in found]


def _mode(errors: str) -> str:
    if errors not in ("drop", "keep", "fail"):
        raise ValueError("errors is drop, keep or fail")
    return errors


def layout_spans(books: DataFrame, key: str = "book_id", layout: str = "layout", errors: str = "drop") -> DataFrame:
    """(key, page_index, x0, y0, x1, y1, content, error) of books' layout JSON. A layout that cannot be read has no row
    (drop), one row with nothing but its error (keep), or ends the job (fail)."""
    _mode(errors)
    return _flat(books.select(key, layout), [key], SPAN + ", error string", lambda r: _by_mode(errors, *read_layout(r[layout]), 6))


def span_mappings(books: DataFrame, key: str = "book_id", errors: str = "drop") -> DataFrame:
    """Mappings, with error, of batches(key, batch, first, markdown, layout): offsets run over a book's batches in order,
    which are joined by nothing; pages over its pages. A layout that cannot be read is handled as in layout_spans; its
    text counts for the offsets of the batches after it."""
    _mode(errors)
    before = F.coalesce(F.expr(f"sum(length(markdown)) over (partition by {key} order by batch rows between unbounded preceding and 1 preceding)"), F.lit(0))
    rows = books.withColumn("base", before).select(key, "base", "first", "markdown", "layout")

    def located(r) -> list[tuple]:
        found, error = read_layout(r["layout"])
        return _by_mode(errors, locate(found, r["markdown"] or "", int(r["base"]), int(r["first"])), error, 7)
    return _flat(rows, [key], MAPPING + ", error string", located)
