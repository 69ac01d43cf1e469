"""Books and layout archives as data sources: spark.read.format("epub").load(folder), and as streams of a folder.

    spark.dataSource.register(EpubSource)
    spark.read.format("epub").option("badFiles", "keep").load("/books")

Options: badFiles is `fail` (the default: a file that cannot be read ends the job), `drop` (it has no row) or `keep` (a row with its
path, id and error); bytesPerTask is about how many bytes of files a task reads. The folder may be at any address
that pyarrow's file systems know; it is listed by the driver, and read by the tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from folioframe.sources import epub, pdf


@dataclass
class Files(InputPartition):
    paths: list[str]


def _files(address: str, ending: str, after: int = -1, until: int | None = None) -> tuple[list[tuple[str, int, int]], int]:
    """(path, bytes, change in nanoseconds) of the files below an address with the ending that were changed in the span."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")
    found = [(x.path, x.size, x.mtime_ns or 0) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(ending)]
    newest = max((m for _, _, m in found), default=-1)
    return sorted(x for x in found if after < x[2] and (until is None or x[2] <= until)), newest


def _content(address: str, path: str) -> bytes:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")
    with system.open_input_stream(path) as f:
        return f.read()


def _tasks(found: list[tuple[str, int, int]], size: int) -> list[Files]:
    out, held = [], 0
    for path, n, _ in found:
        if not out or held + n > size:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += n
    return out or [Files([])]


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options, rows, ending: str, width: int):
        self.address, self.rows, self.ending, self.width = options["path"], rows, ending, width
        self.mode, self.size = options.get("badFiles", "fail"), int(options.get("bytesPerTask", 64 << 20))
        if self.mode not in ("fail", "drop", "keep"):
            raise ValueError("badFiles is fail, drop or keep")

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            data = b""
            try:
                data = _content(self.address, path)
                found = self.rows(path, data)
            except Exception as e:  # whatever a file does, it is that file's error
                if self.mode == "fail":
                    raise ValueError(f"{path}: {type(e).__name__}: {e}") from e
                found = [] if self.mode == "drop" else [(path, hashlib.sha256(data).hexdigest(), *[None] * (self.width - 3), f"{type(e).__name__}: {e}")]
            yield from found


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _tasks(_files(self.address, self.ending)[0], self.size)


class _Stream(_Reading, DataSourceStreamReader):
    """Files by the time of their last change: a file that is changed again is read again. Files must appear whole, as by
    renaming, and not with a time before that of files already read."""

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": _files(self.address, self.ending)[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _tasks(_files(self.address, self.ending, start["until"], end["until"])[0], self.size)

    def commit(self, end: dict) -> None:
        pass


def _book(path: str, data: bytes) -> list[tuple]:
    meta, text, mappings = epub.read_book(data)
    names = [m.split(":")[0] for m in epub.MAPPING.split(",")]
    return [(path, hashlib.sha256(data).hexdigest(), *(meta[k] for k in ("title", "author", "language", "publisher", "isbn", "description")), text, [dict(zip(names, m)) for m in mappings], "")]


class EpubSource(DataSource):
    """A row for each .epub file, as epub.read has it."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return epub.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options, _book, ".epub", 11)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options, _book, ".epub", 11)


def _archive(path: str, data: bytes) -> list[tuple]:
    markdown, layout, errors = pdf.unpack(data)
    if not markdown and not layout and errors:
        raise ValueError(errors)
    return [(path, hashlib.sha256(data).hexdigest(), markdown, layout, len(pdf.spans(json.loads(layout))) if layout else 0, errors)]


class LayoutSource(DataSource):
    """A row for each .zip archive of a converted PDF: its text, its layout and the number of spans in it. error tells of
    members that could not be read."""

    @classmethod
    def name(cls) -> str:
        return "layout_archive"

    def schema(self) -> str:
        return "path string, book_id string, markdown string, layout string, spans long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options, _archive, ".zip", 6)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options, _archive, ".zip", 6)


def register(spark) -> None:
    """Make the sources known to the session."""
    for source in (EpubSource, LayoutSource):
        spark.dataSource.register(source)
