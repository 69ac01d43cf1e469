"""Readers and writers of plain files: tables, whole texts, directories, JSON logs."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts string, level string, name string, msg string, fields map<string,string>, exc struct<type:string,msg:string,tb:string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, for tables that all executors see; a folder of our own only where it is unset
    and all executors are in this process. On a cluster an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file wherever Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Rounds:
    """Tables of one call in the shared folder, by name: written and read again, so that no lineage grows."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        remove(self.spark, self.root)


#: Whole files that Python gets at a time, and that it answers at a time.
FILES_SENT, FILES_TOLD = 512, 128


def short_batches(spark: SparkSession, most: int = FILES_SENT) -> None:
    """Send Python at most `most` rows at a time, as rows with whole files are long, unless the session asks for fewer. A
    session setting, since results are computed after the caller has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def loose_files(spark: SparkSession, path: str, reserved: tuple[str, ...] = ("blobs", "quarantine")) -> DataFrame:
    """(key, content) of all files below a path but for reserved folders at its top."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.ltrim(F.regexp_replace("path", "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", ""), F.lit("/"))
    return files.select(key.alias("key"), "content").filter(~F.substring_index("key", "/", 1).isin(*reserved))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; other fields than the known ones are not kept."""
    return spark.read.schema(LOG).json(path)


def write_logs(records: DataFrame, path: str, most: int = 100_000) -> None:
    """JSON lines in files of at most `most` records."""
    records.write.mode("append").option("maxRecordsPerFile", most).json(path)


@dataclass
class Config:
    """Settings of an engine: where its data lie and what is on."""

    data_dir: str = "data"
    index_types: list[str] = field(default_factory=lambda: ["chunk", "graph", "summary"])
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_text(cls, text: str) -> Config:
        """From JSON, or from lines `name: value` with comma-separated lists."""
        try:
            values = json.loads(text)
        except ValueError:
            lines = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
            values = {k.strip(): v.strip().strip("\"'") for k, v in lines}
        kinds = values.pop("index_types", None)
        kinds = [k.strip() for k in kinds.strip("[]").split(",") if k.strip()] if isinstance(kinds, str) else kinds
        known = {"data_dir": values.pop("data_dir", "data"), "options": {k: str(v) for k, v in values.items()}}
        return cls(**known, **({"index_types": kinds} if kinds is not None else {}))


class Skills:
    """Texts of a folder by name, read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._known = spark, path, {}

    def get(self, name: str) -> str | None:
        if name not in self._known:
            rows = contents(self.spark, self.path).filter(F.col("path").rlike(rf"(?:^|/){name}(?:/SKILL)?\.md$")).select("text").head(1)
            self._known[name] = rows[0][0] if rows else None
        return self._known[name]


def book_path(root: str, book_id: str, *names: str) -> str:
    """The folder of a book, or a file in it."""
    return "/".join([root.rstrip("/"), f"book_id={book_id}", *names])
