"""EPUB books as a source: metadata, spine, text and mappings."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.sources.files import FILES_TOLD, short_batches
from folioframe.sources.markup import convert

BOOK = "title string, author string, language string, publisher string, isbn string, description string"
MAPPING = "content_offset:bigint,content_length:bigint,href:string,spine_index:int,element_tag:string,element_index:int,element_id:string,element_path:string"
SCHEMA = f"path string, book_id string, {BOOK}, text string, mappings array<struct<{MAPPING}>>, error string"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def isbn(identifiers: list[str]) -> str:
    """The first identifier that mentions ISBN, else the first."""
    return next((i for i in identifiers if "isbn" in i.lower()), identifiers[0] if identifiers else "")


def read_book(data: bytes) -> tuple[dict, str, list[tuple]]:
    """(metadata, markdown, mappings) of an EPUB file: the spine's documents in order, those that are missing left out;
    offsets run over the whole text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if _name(e.tag) == "rootfile")
        opf = ElementTree.fromstring(z.read(package))
        found: dict[str, list[str]] = {}
        items: dict[str, str] = {}
        spine: list[str] = []
        for e in opf.iter():
            if "purl.org/dc" in e.tag and e.text and e.text.strip():
                found.setdefault(_name(e.tag), []).append(e.text.strip())
            elif _name(e.tag) == "item":
                items[e.attrib.get("id", "")] = e.attrib.get("href", "")
            elif _name(e.tag) == "itemref":
                spine.append(e.attrib.get("idref", ""))
        meta = {k: (found.get(v) or [""])[0] for k, v in (("title", "title"), ("author", "creator"), ("language", "language"), ("publisher", "publisher"), ("description", "description"))}
        meta["isbn"] = isbn(found.get("identifier", []))
        parts, mappings, at = [], [], 0
        for index, ref in enumerate(r for r in spine if r in items):
            href = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items[ref])))
            if href not in names:
                continue
            text, ranges = convert(z.read(href).decode("utf-8", "replace"))
            mappings += [(at + start, size, items[ref], index, tag, n, ident, path) for start, size, tag, n, ident, path in ranges]
            parts.append(text)
            at += len(text)
        return meta, "".join(parts), mappings


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each .epub file below a path; book_id is the sha256 of the file. A file that cannot be read has
    its error and no text; Spark's reader passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return parse(files.select("path", "content"))


def parse(files: DataFrame) -> DataFrame:
    """The books of files(path, content), a few at a time."""
    short_batches(files.sparkSession)

    def run(batches):
        for batch in (whole.iloc[at:at + FILES_TOLD] for whole in batches for at in range(0, len(whole), FILES_TOLD)):
            rows = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    meta, text, mappings = read_book(data)
                    rows.append((meta["title"], meta["author"], meta["language"], meta["publisher"], meta["isbn"], meta["description"], text, mappings, ""))
                except Exception as e:  # whatever a broken or encrypted file does, it is that file's error
                    rows.append(("", "", "", "", "", "", "", [], f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["title", "author", "language", "publisher", "isbn", "description", "text", "mappings", "error"], dtype=object)
            names = [m.split(":")[0] for m in MAPPING.split(",")]
            out["mappings"] = [[dict(zip(names, m)) for m in ms] for ms in out["mappings"]]
            out.insert(0, "path", batch["path"].to_numpy())
            out.insert(1, "book_id", batch["book_id"].to_numpy())
            yield out

    return files.withColumn("book_id", F.sha2("content", 256)).mapInPandas(run, SCHEMA)


def mappings(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("mappings").alias("m")).select("book_id", "m.*")
