"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

An element's ranks in the slots of a signature come from one random permutation and differ in their whole part, so the
slots of a text are not independent and the share of equal slots varies less than with MinHash. Slots are filled step by
step; a text stops as soon as no later step can lower a slot. Texts that agree in a band are candidates. In each bucket
the rows are first verified against one of them; the components of these links then leave only pairs of rows from
different components of a bucket, which are all verified, block by block, inside tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.bytewords import byte_words, kinds
from folioframe.llm.common import Scratch, long_rows, mix64, parts, table
from folioframe.llm.lshforest import components, met_by, set_key

SHINGLE, PERCENT = 3, 85
#: Bands and slots of a band: two sets with a similarity of 0.85 share no band with a probability of 4 in 10 million.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Rows of a block, elements whose signatures are made at once.
BLOCK, ELEMENTS = 256, 1 << 18

_WORDS = kinds(b" \t\n\x0b\x0c\r")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * _STEP
_UNIT = 48  # bits of a rank's fraction


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Ascending 64-bit hashes of the different shingles of each text: three words in a row, or all words of a shorter one."""
    out: list[np.ndarray] = []
    for _, count, words in byte_words(texts, _WORDS):
        cut = np.searchsorted(words.whose, np.arange(count + 1))
        h = words.hash
        every = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            every[:len(h) - k] += h[k:] * _SHINGLE[k]
        every = mix64(every)
        for a, b in zip(cut[:-1], cut[1:]):
            if 0 < b - a < SHINGLE:
                out.append(mix64(np.add.reduce(h[a:b] * _SHINGLE[:b - a], keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.unique(every[a:max(a, b - SHINGLE + 1)]))
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of each set that is not empty: slot values are step + fraction in fixed point. At most
    SLOTS slots."""
    elements = np.concatenate(sets)
    whose = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    low = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for step in range(slots):
        draw = mix64(elements + _STEPS[step])
        pick = step + (((draw & np.uint64(0xFFFF)) * np.uint64(slots - step)) >> np.uint64(16)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = order[row, pick]
            order[row, pick] = order[row, step]
            order[row, step] = slot
        np.minimum.at(low, whose * slots + slot, (np.uint64(step) << np.uint64(_UNIT)) | (draw >> np.uint64(64 - _UNIT)))
        open_ = low.reshape(-1, slots).max(1) >> np.uint64(_UNIT) > step  # a later step can still lower a slot
        stay = open_[whose]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.min_scalar_type(slots)), (int(stay.sum()), 1))
            row = np.arange(len(order))
            order[row, pick[stay]] = 0
            order[row, 0] = pick[stay]
        elif not stay.all():
            order = order[stay]
        elements, whose = elements[stay], whose[stay]
    return low.reshape(-1, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = mix64(key ^ signature[:, k::ROWS][:, :BANDS])
    return key.view(np.int64)


def _sketch(batches):
    for batch in batches:
        for at, n in parts((len(x.as_py() or "") for x in batch.column(1)), rows=1024, total=1 << 20):
            ids, texts = (batch.column(k).slice(at, n) for k in range(2))
            sets = shingle_sets(texts.to_pylist())
            keys: list = [None] * n
            full = [i for i in range(n) if len(sets[i])]
            for a, k in parts((len(sets[i]) for i in full), rows=n, total=ELEMENTS):
                some = full[a:a + k]
                for i, key in zip(some, band_keys(signatures([sets[i] for i in some]))):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([ids, pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["doc_id", "c", "n", "keys"])


def _sets(batches):
    for batch in batches:
        for at, n in parts((len(x.as_py() or "") for x in batch.column(0)), rows=1024, total=1 << 20):
            sets = shingle_sets(batch.column(0).slice(at, n).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "packed"])


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each of the ascending sets on the left shares with each of those on the right."""
    if len(left) > len(right):
        return shared(right, left).T
    every, ends = np.concatenate(right), np.cumsum([len(s) for s in right])
    if len(left) <= 4:
        out = []
        for s in left:
            hit = np.concatenate([[0], np.cumsum(s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every)])
            out.append(hit[ends] - hit[ends - [len(x) for x in right]])
        return np.stack(out)
    ours = np.concatenate(left)
    common = np.intersect1d(ours, every)
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets: list[np.ndarray], all_: np.ndarray):
        at = np.searchsorted(common, all_)
        hit = np.flatnonzero((at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == all_)) if len(common) else np.zeros(0, np.int64)
        column, row = at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    a, b = placed(left, ours), placed(right, every)
    for low in range(0, len(common), 2048):
        dense = []
        for (row, column), sets in ((a, left), (b, right)):
            x, y = np.searchsorted(column, [low, low + 2048])
            part = np.zeros((len(sets), 2048), np.float32)
            part[row[x:y], column[x:y] - low] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def links_between(rows: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join the same components as all links between rows of side 0 and of side 1 (a row of side 2 is on both)
    whose `part` differs: enough of them to connect what they connect."""
    side, part = rows["side"].to_numpy(), rows["part"].tolist()
    sets, keys = [np.frombuffer(x, np.uint64) for x in rows["packed"]], rows["c"].tolist()
    number = {p: k for k, p in enumerate(dict.fromkeys(part))}
    part, size = np.array([number[p] for p in part]), np.array([len(s) for s in sets])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    maybe = (part[left][:, None] != part[right][None]) & (100 * np.minimum(size[left][:, None], size[right][None]) >= percent * np.maximum(size[left][:, None], size[right][None]))
    a, b = maybe.any(1), maybe.any(0)
    left, right, maybe = left[a], right[b], maybe[a][:, b]
    if not len(left):
        return []
    both = shared([sets[i] for i in left], [sets[i] for i in right])
    maybe &= 100 * both >= percent * (size[left][:, None] + size[right][None] - both)
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in np.argwhere(maybe):
        i, j = int(left[i]), int(right[j])
        if (p := find(i)) != (q := find(j)):
            root[p] = q
            out.append((keys[i], keys[j]))
    return out


def compared(groups: DataFrame, sets: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(u, v): links found in each group of (c, part, side)."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = links_between(rows, percent)
        return pd.DataFrame({"u": pd.Series([f[0] for f in found], dtype=object), "v": pd.Series([f[1] for f in found], dtype=object)})

    return groups.join(sets, "c").groupBy(*by).applyInPandas(compare, "u binary, v binary")


def star_groups(met: DataFrame, percent: int, block: int) -> DataFrame:
    """(center, salt, c, part, side): each row of a bucket with the bucket's least one, some rows to a salt, where their
    sizes allow a link."""
    pairs = met.filter("c <> center.c").filter(100 * F.least("n", F.col("center.n")) >= percent * F.greatest("n", F.col("center.n"))).select(F.col("center.c").alias("center"), "c").distinct()
    number = pairs.groupBy("center").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    rows = met_by(pairs, number, "center").select("center", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), "c", F.col("c").alias("part"), F.lit(1).alias("side"))
    centers = number.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("c"), F.col("center").alias("part"), F.lit(0).alias("side"))
    return rows.unionByName(centers)


def cross_groups(met: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(key, low, high, c, part, side): the rows of buckets that hold several components, dealt to pairs of blocks so that
    each two rows of different components meet once. A component with more than `block` rows has blocks of its own,
    which are not paired with each other; the others share blocks."""
    rows = met.filter("size > 2").join(roots, "c", "left").select("key", "c", F.coalesce("root", "c").alias("part"))
    bucket = rows.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("xor"))
    bucket = bucket.filter("least <> most").groupBy("sum", "xor").agg(F.min("key").alias("key")).select("key")  # equal buckets of other bands once
    rows = met_by(rows, bucket, "key")
    share = rows.groupBy("key", "part").agg(F.count("*").alias("m"))
    large = share.filter(F.col("m") > block).select("key", "part", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    small = share.filter(F.col("m") <= block).groupBy("key").agg(F.ceil(F.sum("m") / block).cast("int").alias("blocks"))
    #: Blocks are numbered through in each bucket: first the shared ones, then those of each large component.
    owned = large.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "blocks"))).alias("owned"))  # at most rows / block entries
    plan = small.join(owned, "key", "full").select("key", F.coalesce("blocks", F.lit(0)).alias("common"), F.coalesce("owned", F.expr("cast(array() as array<struct<part:binary,blocks:int>>)")).alias("owned"))
    #: (number, blocks, whether the first of its own) of all blocks: own[k] is the first block of the k-th large component.
    firsts = F.transform("owned", lambda x, k: F.struct(x["part"].alias("part"), x["blocks"].alias("blocks"), (F.col("common") + F.aggregate(F.slice("owned", 1, k), F.lit(0), lambda s, y: s + y["blocks"])).cast("int").alias("first")))
    plan = plan.select("key", "common", firsts.alias("owned"), (F.col("common") + F.aggregate("owned", F.lit(0), lambda s, y: s + y["blocks"])).alias("all"))
    rows = met_by(rows, plan, "key").withColumn("mine", F.get(F.filter("owned", lambda x: x["part"] == F.col("part")), F.lit(0)))
    rows = rows.withColumn("own", F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("part"), F.col("common"))).otherwise(F.col("mine.first") + F.pmod(F.xxhash64("c"), F.col("mine.blocks"))).cast("int"))
    #: A block meets every other block but those of its own large component; a shared one also itself.
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: F.col("mine").isNull() | (b < F.col("mine.first")) | (b >= F.col("mine.first") + F.col("mine.blocks")))
    rows = rows.select("key", "c", "part", "own", F.explode(others).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "c", "part", side.cast("int").alias("side"))


def with_roots(stars: DataFrame) -> DataFrame:
    return stars.unionByName(stars.select(F.col("root").alias("c"), "root").distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row. Texts are linked if 100 * shared >= percent * all of their
    different shingles of three words; component_id is the smallest doc_id that a row reaches by links, and a row is
    kept if that is its own.

    Equal sets are one node, however many rows have them, so copies never meet. Links are confirmed on the whole sets.

    Defined cases: null text is empty; a text without words has no shingles, is linked with nothing and keeps its own
    doc_id; rows that share a doc_id and a component are all kept; a component whose doc_ids are all null has
    component_id null and its rows are kept, and so has a text without words whose doc_id is null; rows with a null
    doc_id in other components are not kept; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "superminhash")
    long_rows(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.save(texts.mapInArrow(_sketch, "doc_id long, c binary, n long, keys array<long>"), "sketch")
    nodes = scratch.save(sketch.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    bands = nodes.select("c", "n", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("c", "n")).alias("center")).filter("size > 1")
    met = scratch.save(met_by(bands, buckets, "key"), "met")

    members = met.select("c").distinct().join(nodes, "c").select(F.col("rep").alias("doc_id"), F.col("c").alias("member"))
    ids = scratch.save(members, "members")
    #: One text of each set that meets another: the row of the set's smallest doc_id.
    one = texts.join(ids.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi").unionByName(texts.filter("doc_id is null"))
    sets = scratch.save(one.select("text").mapInArrow(_sets, "c binary, packed binary").dropDuplicates(["c"]), "sets")

    star = scratch.save(compared(star_groups(met, percent, block), sets, ["center", "salt"], percent), "star")
    rounds = Scratch(spark, "superminhash-rounds")
    roots = scratch.save(with_roots(components(star, rounds)), "roots")
    rounds.close()
    cross = scratch.save(compared(cross_groups(met, roots, block), sets, ["key", "low", "high"], percent), "cross")
    scratch.drop("met", "sets", "star", "members")
    final = roots
    if not cross.isEmpty():
        rounds = Scratch(spark, "superminhash-rounds")
        final = with_roots(components(cross.unionByName(roots.filter("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v"))), rounds))
    least = final.join(nodes.select("c", "rep"), "c").groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = nodes.select("c", "rep").join(met_by(final, least, "root").select("c", "component_id"), "c", "left").select("c", F.coalesce("component_id", "rep").alias("component_id"))
    classes = scratch.save(classes, "classes")
    rounds.close()
    scratch.drop("nodes", *[name for name in scratch.saved if name not in ("sketch", "classes")])
    found = met_by(sketch.filter("n > 0").select("doc_id", "c", "n"), classes, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    found = found.unionByName(sketch.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Pairs are found by their shared shingles; the components by walking the links.
ORACLE = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end s from words),
shingles as (select doc_id, len(s) n, unnest(s) x from sets),
pairs as (select a.doc_id u, b.doc_id v from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways as (select u, v from pairs union all select v, u from pairs),
walk as (select u root, u node from ways union select w.root, e.v from walk w join ways e on w.node = e.u),
least_of as (select node, min(root) m from walk group by node)
select s.doc_id, len(s.s) n_shingles, coalesce(m, s.doc_id) component_id, s.doc_id = coalesce(m, s.doc_id) kept
from sets s left join least_of on node = s.doc_id"""
