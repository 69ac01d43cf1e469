"""Table functions in SQL, and books as data sources."""

import io
import json
import os
import zipfile

import pytest

from folioframe.sources import datasource, epub
from folioframe.functions import tabled
from test_upkeep import book


@pytest.fixture(scope="module")
def known(spark):
    from folioframe import registry

    registry.register_functions(spark)
    return spark


def test_table_functions(known):
    rows = known.createDataFrame([("a", 1, "word " * 900), ("b", 2, ""), ("c", 3, None), (None, 4, "x\n\ny")], "k string, other int, text string")
    rows.createOrReplaceTempView("texts")
    found = known.sql("select * from chunk_text(table(texts), 200, 10)").collect()
    assert {r.k for r in found} == {"a", None} and sum(r.k == "a" for r in found) > 4 and found[0].asDict().keys() == {"k", "chunk_index", "content_offset", "content_length", "chunk_text"}
    assert known.sql("select count(*) from graph_chunks(table(texts))").first()[0] == 3  # 4,500 characters are more than 1,000 tokens
    assert known.sql("select count(*) from chunk_text(table(select * from texts where false))").first()[0] == 0
    for bad in ("chunk_text(table(texts), 0, 5)", "chunk_text(table(select other from texts), 5, 5)", "chunk_text(table(select text from texts), 5, 5)", "heading_levels(table(texts))"):
        with pytest.raises(Exception, match="must be"):
            known.sql(f"select * from {bad}").collect()
    lines = known.createDataFrame([(b, i, r) for b in (1, 2) for i, r in enumerate([3, 1, 6, 3, 2, 6])], "b int, i int, raw_level int").repartition(3)
    lines.createOrReplaceTempView("lines")
    got = known.sql("select * from heading_levels(table(lines) partition by b order by i)").collect()
    from folioframe.operators.tree import levels
    assert all([r.level for r in sorted(got, key=lambda r: r.i) if r.b == b] == levels([3, 1, 6, 3, 2, 6]) for b in (1, 2))


def write(folder, name, data):
    """A file that appears whole."""
    (folder / f".{name}").write_bytes(data)
    os.rename(folder / f".{name}", folder / name)


def test_books_as_a_source(known, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(5):
        write(tmp_path / "in" / "deep", f"b{i}.epub", book(f"T{i}"))
    write(tmp_path / "in", "other.txt", b"x")
    load = lambda **o: known.read.format("epub").options(**o).load(f"file://{tmp_path}/in")
    rows = load(bytesPerTask=1).collect()
    plain = epub.read(known, f"{tmp_path}/in").collect()
    assert sorted((r.book_id, r.title, r.text, r.error) for r in rows) == sorted((r.book_id, r.title, r.text, r.error) for r in plain)
    assert load(bytesPerTask=1).rdd.getNumPartitions() == 5 and load().rdd.getNumPartitions() == 1 and load().select("title").filter("title > 'T2'").count() == 2
    write(tmp_path / "in", "locked.epub", book("x", True))
    write(tmp_path / "in", "empty.epub", b"")
    assert load(badFiles="drop").count() == 5
    kept = load(badFiles="keep").filter("error <> ''").collect()
    assert sorted(os.path.basename(r.path) for r in kept) == ["empty.epub", "locked.epub"] and all(r.title is None and r.book_id for r in kept)
    with pytest.raises(Exception, match="locked.epub|empty.epub"):
        load().collect()
    with pytest.raises(Exception, match="badFiles"):
        load(badFiles="ignore").collect()
    os.mkdir(tmp_path / "none")
    assert known.read.format("epub").load(f"file://{tmp_path}/none").count() == 0


def test_books_as_a_stream(known, tmp_path):
    (tmp_path / "in").mkdir()
    stream = known.readStream.format("epub").option("badFiles", "keep").load(f"{tmp_path}/in")

    def titles():
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.title or r.error[:4] for r in known.read.schema(epub.SCHEMA).parquet(f"{tmp_path}/out").collect())

    write(tmp_path / "in", "a.epub", book("A"))
    write(tmp_path / "in", "b.epub", b"no zip")
    assert titles() == ["A", "BadZ"]
    write(tmp_path / "in", "c.epub", book("C"))
    assert titles() == ["A", "BadZ", "C"] and titles() == ["A", "BadZ", "C"]


def test_archives_as_a_source(known, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/full.md", "# x")
        z.writestr("x/a_layout.json", json.dumps({"pages": [{"spans": [{"content": "c", "bbox": [0, 0, 1, 1]}]}]}))
        z.writestr("x/b_layout.json", "{broken")
    write(tmp_path, "a.zip", data.getvalue())
    write(tmp_path, "b.zip", b"none")
    rows = {os.path.basename(r.path): r for r in known.read.format("layout_archive").option("badFiles", "keep").load(f"{tmp_path}").collect()}
    assert (rows["a.zip"].markdown, rows["a.zip"].spans) == ("# x", 1) and "b_layout.json" in rows["a.zip"].error and rows["b.zip"].markdown is None and "BadZipFile" in rows["b.zip"].error


def test_names():
    assert {c.name() for c in (datasource.EpubSource, datasource.LayoutSource)} == {"epub", "layout_archive"} and set(tabled.FUNCTIONS) >= {"chunk_text", "heading_levels"}
