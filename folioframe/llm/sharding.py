"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash. A bucket whose rows exceed the byte limit splits on
one more bit; all others keep their depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, fresh, table

#: Bytes of text that a shard may hold.
SHARD_BYTES = 64 << 20
#: Those of the query's shards: small, so that tables of any size split.
QUERY_BYTES = 256 << 10
BITS = 60


def _hash() -> Column:
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("body"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, bits: int = BITS) -> DataFrame:
    """(depth, prefix, bytes) of the buckets for sizes(h, bytes, copies); buckets that are still too large at the
    full depth are left out.

    The bytes below every prefix are one aggregation of at most 2^L cells, where L follows from the total; sums fall
    with depth, so a cell's bucket is its shallowest prefix that fits. Cells too large at L go on with more bits."""
    total = sizes.select(F.sum(F.col("bytes") * F.col("copies"))).first()[0] or 0
    low, high = 0, min(bits, max(1, math.ceil(math.log2(max(1, total / limit))) + 4))
    rest, out = sizes, None
    while True:
        cells = rest.groupBy(F.shiftright("h", bits - high).alias("cell")).agg(
            F.sum(F.col("bytes") * F.col("copies")).alias("bytes"))
        sums = cells.select("bytes", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
            "prefix", F.expr(f"cell div cast(pow(2, {high} - depth) as bigint)")).groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"))
        fits = sums.filter(F.col("bytes") <= limit)
        over = sums.filter(F.col("bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        #: A prefix that fits is a bucket if the prefix above it does not fit; the first level has none above it.
        found = fits.join(over, ["depth", "prefix"], "left_semi").unionByName(fits.filter(F.col("depth") == low))
        out = found if out is None else out.unionByName(found)
        full = sums.filter((F.col("depth") == high) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
        if high == bits or full.isEmpty():
            return out
        rest = rest.join(full, F.shiftright("h", bits - high) == F.col("cell"), "left_semi")
        low, high = high + 1, min(bits, high + 8)


def _places(docs: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, h, copies, shard, depth, paged) of the different rows; the shard of those that fill pages is
    the beginning of its name."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).select(
        "doc_id", F.octet_length("body").cast("long").alias("bytes"), _hash().alias("h")
    ).groupBy("doc_id", "bytes", "h").agg(F.count("*").alias("copies"))
    rows = scratch.save(rows, "rows")
    large = F.col("bytes") > limit
    small = rows.filter(~large)
    buckets = scratch.save(directory(small, limit), "buckets")
    depths = [r[0] for r in buckets.select("depth").distinct().sort("depth").collect()]  # at most 61 values
    prefix = F.expr(f"h div cast(pow(2, {BITS} - depth) as bigint)")
    near = small.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else \
        small.withColumn("depth", F.lit(0)).limit(0)
    placed = near.withColumn("prefix", prefix).join(buckets.select("depth", "prefix"), ["depth", "prefix"]).select(
        "doc_id", "bytes", "copies", "h", "depth",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(
            F.expr("right(concat(repeat('0', 64), bin(prefix)), depth)")).alias("shard"))
    #: Equal rows that are too many for one shard at the full depth.
    whole = small.groupBy("h").agg(F.sum(F.col("bytes") * F.col("copies")).alias("sum")).filter(F.col("sum") > limit)
    pages = small.join(whole.select("h"), "h", "left_semi")
    name = F.right(F.concat(F.repeat(F.lit("0"), 15), F.lower(F.hex("h"))), F.lit(15))
    some = lambda df, shard, depth, paged: df.select("doc_id", F.col("bytes").alias("n_bytes"), "h", "copies", shard.alias("shard"), depth.alias("depth"), F.lit(paged).alias("paged"))
    return some(placed, F.col("shard"), F.col("depth"), False).unionByName(some(pages, name, F.lit(BITS), True)).unionByName(some(rows.filter(large), name, F.lit(-1), True))


def _page(number: str, limit: int) -> Column:
    """The page of the copy with this number, from 0."""
    return F.expr(f"{number} div greatest(1, {limit} div greatest(1, n_bytes))")


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth): a shard for every row; the texts of a shard have at most `limit` bytes.

    Defined cases: null text is empty; a text larger than the limit is a shard of its own, named by its hash with
    depth -1; rows that are equal in doc_id and text share a hash that no bit can split, so where they exceed the
    limit together they fill numbered overflow pages; an empty table gives no rows; other columns are ignored."""
    out = _places(docs, limit, Scratch(docs.sparkSession, "shards")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select("doc_id", "n_bytes", F.when(F.col("paged"), F.concat_ws(".", "shard", _page("i", limit))).otherwise(F.col("shard")).alias("shard"), "depth")


def with_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs with their shard as one more column, `shard`, with an underscore for each column that is named
    so already. A row's hash leads to its shard; equal rows that fill pages are numbered, those of each partition by
    themselves, so that no task sees all of them. Other cases are those of shard_documents."""
    scratch = Scratch(docs.sparkSession, "sharded")
    places = scratch.save(_places(docs, limit, scratch), "places")
    shard, body, h, number, part = (fresh(docs, n) for n in ("shard", "_body", "_h", "_number", "_part"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.withColumn(h, F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    own = places.filter("not paged").select(F.col("h").alias(body), F.col("shard").alias(number)).distinct()
    own = rows.join(own, F.col(h) == F.col(body)).withColumn(shard, F.col(number))
    paged = places.filter("paged").select(F.col("h").alias(body), F.struct("n_bytes", "shard").alias(number)).distinct()
    paged = scratch.save(rows.join(paged, F.col(h) == F.col(body)).withColumn(part, F.monotonically_increasing_id()), "paged")
    counts = paged.groupBy(h, F.shiftright(part, 33).alias("p")).agg(F.count("*").alias("n")).select(
        F.col(h).alias("of"), "p", (F.sum("n").over(Window.partitionBy(h).orderBy("p")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(h, F.shiftright(part, 33)).orderBy(part)) - 1
    packed = paged.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"{number}.n_bytes").alias("n_bytes"), F.col(f"{number}.shard").alias("shard"),
                          F.col(h).alias("h"), F.shiftright(part, 33).alias("part"), nth.alias("nth"))
    packed = packed.join(counts, (F.col("h") == F.col("of")) & (F.col("part") == F.col("p"))).withColumn("i", F.col("before") + F.col("nth"))
    packed = packed.select("row.*", F.concat_ws(".", "shard", _page("i", limit)).alias(shard))
    columns = [F.col(f"`{c}`") for c in [*docs.columns, shard]]
    return own.select(*columns).unionByName(packed.select(*columns))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write the rows of docs in one folder for each shard, named as with_shards names the column: shard=<bits>."""
    rows = with_shards(docs, limit)
    shard = rows.columns[-1]
    rows.repartition(shard).write.partitionBy(shard).parquet(path)


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), QUERY_BYTES)


def oracle(limit: int = QUERY_BYTES) -> str:
    return f"""
with r as (select doc_id, octet_length(encode(coalesce(text, ''))) n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint h from documents),
e as (select r.*, d.depth, h // (1::bigint << (60 - d.depth)) prefix from r, (select unnest(generate_series(0, 40)) depth) d),
s as (select depth, prefix, sum(n_bytes) b from e group by depth, prefix),
p as (select e.doc_id, e.n_bytes, e.h, min(e.depth) depth from e join s using (depth, prefix) where s.b <= {limit} group by all)
select doc_id, n_bytes::bigint n_bytes, case when depth = 0 then '' else
  right(repeat('0', 64) || bin(h // (1::bigint << (60 - depth))), depth) end shard, depth::integer depth from p
"""
