"""Near duplicates by an n-gram Jaccard join over an LSH forest of MinHash signatures.

Each text's set of five-word shingles has a label of LONGEST hashes in each tree. A tree is a trie of sorted labels: rows
that share a prefix are a run, and the runs of the shortest prefix in use are its nodes. In each node a row is matched
on a prefix of its own, shortened from the longest until texts as alike as any that it can be linked to meet in some tree
with the target probability. Matched rows are verified exactly on their whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, fresh, grouped_words, long_rows, mix64, parts, table, text_key

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, hashes of a label, and the probability with which two texts that are linked must meet.
TREES, LONGEST, RECALL = 16, 8, 0.9995
#: Nodes up to this size give pairs; the rows of larger ones meet in blocks inside tasks, of BLOCK rows, up to eight times
#: as many where there are many blocks, and of about SHINGLES shingles at most.
PAIRED, BLOCK, SHINGLES = 24, 256, 1 << 22
#: Candidate ids that may be broadcast.
BROADCAST_IDS = 1 << 20
#: Sets of fewer shingles have a prefix of their own.
FEW = 64

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.array([pow(_BASE, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The prefix for texts of this similarity: the longest one is shortened, hash by hash, until they share it in some
    tree with the wanted probability, or one hash is left."""
    k = longest
    while k > 1 and 1 - (1 - similarity ** k) ** trees < recall:
        k -= 1
    return k


def least_similarity(n: int, threshold: float = THRESHOLD) -> float:
    """The least similarity of at least the threshold that a set of n shingles can have to a different set: sets are
    small whole numbers, so that of few shingles is above the threshold, and 1 where only equal sets are left."""
    best = 1.0
    for m in range(math.ceil(n * threshold - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if both <= min(n, m) and both < max(n, m):
            best = min(best, both / (n + m - both))
    return best


def prefix_lengths(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """The prefix of sets of 0, 1, ... shingles; the last one holds for all larger sets."""
    return [prefix_length(least_similarity(n, threshold), recall=recall) for n in range(FEW)] + [prefix_length(threshold, recall=recall)]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The ascending 64-bit hashes of each text's different shingles: five words in a row, lower case, a word being a
    run of letters, marks and digits, or one letter of a script without blanks. A shorter text has one shingle of all
    its words, a text without words none."""
    found: list[list] = [[] for _ in texts]
    for text, words in grouped_words(texts):
        word = words.hash(words.start, words.end)
        cut = np.searchsorted(words.whose, np.arange(len(text) + 1))
        for k, i in enumerate(text.tolist()):
            found[i].append(word[cut[k]:cut[k + 1]])
    out = []
    for some in found:
        word = some[0] if len(some) == 1 else np.concatenate([np.zeros(0, np.uint64), *some])
        n = min(SHINGLE, len(word))
        every = sum((word[k:len(word) - n + 1 + k] * _STEP[k] for k in range(n)), np.zeros(1 if n else 0, np.uint64))
        out.append(np.unique(mix64(every + np.uint64(n % SHINGLE))))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([np.add.reduce(mix64(s)) + np.uint64(len(s)), np.add.reduce(mix64(s ^ np.uint64(_BASE)))], ">u8").tobytes()


def label(s: np.ndarray) -> bytes:
    """The labels of all trees: of each of LONGEST minimal hashes two bytes."""
    low = np.full(TREES * LONGEST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, at:at + 4096] * _A[:, None] + _B[:, None]).min(1))
    return mix64(low).astype(">u2").tobytes()


def _each(make, names: list[str], types: list):
    """Arrow batches of make(id, set, *more) over rows of id, text and more columns, a few texts at a time."""
    def run(batches):
        for batch in batches:
            for at, n in parts((len(x.as_py()) for x in batch.column(1)), total=1 << 20):
                ids, texts, *more = (column.slice(at, n).to_pylist() for column in batch.columns)
                rows = [make(i, s, *x) for i, s, *x in zip(ids, shingle_sets(texts), *more)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def _node_keys(labels: np.ndarray, length: int) -> np.ndarray:
    """A key for each row and tree: that of the prefix of this length."""
    part = labels.copy()
    part[:, :, 2 * length:] = 0
    part = part.view(np.uint64)
    key = part[:, :, 0]
    for k in range(1, part.shape[2]):
        key = mix64(key) ^ part[:, :, k]
    return key


def _together(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, tree: int, paired: int) -> np.ndarray:
    """Which of left and right are compared here: they match in this tree, in no earlier large node and in no small one,
    which gives them as a pair."""
    labels = np.frombuffer(b"".join(rows["label"]), np.uint8).reshape(len(rows), TREES, 2 * LONGEST)
    length, sizes = rows["length"].to_numpy(), np.stack([np.asarray(x) for x in rows["sizes"]])
    lengths = np.unique(length)
    shorter = np.minimum(length[left][:, None], length[right][None]) if len(lengths) > 1 else None
    keys = {k: _node_keys(labels, int(k)) for k in lengths}
    out = np.ones((len(left), len(right)), bool)
    for t in [tree, *(t for t in range(TREES) if t != tree)]:  # the tree itself first, as it leaves the fewest pairs
        if t == tree or t < tree or (sizes[left, t] <= paired).any():
            same = np.zeros_like(out)
            for k, key in keys.items():
                meet = key[left, t][:, None] == key[right, t][None]
                same |= meet if shorter is None else meet & (shorter == k)
            if t == tree:
                out &= same
            else:
                out &= ~(same & ((sizes[left, t] > 1) & ((sizes[left, t] <= paired) | (t < tree)))[:, None])
        if not out.any():
            break
    return out


def _blocks(rows: pd.DataFrame, tree: int, two: bool, threshold: float, paired: int):
    """Links between the rows of a node, or between its blocks 0 and 1 if two: (key, links, root) of every linked row,
    root being a row that it is connected to here."""
    side, sizes = rows["side"].to_numpy(), rows["n"].to_numpy()
    left = np.flatnonzero(side == 0) if two else np.arange(len(rows))
    right = np.flatnonzero(side == 1) if two else left
    if not len(left) or not len(right):
        return
    alike = _together(rows, left, right, tree, paired)
    alike &= np.minimum(sizes[left][:, None], sizes[right][None]) >= threshold * np.maximum(sizes[left][:, None], sizes[right][None]) - 1e-9
    if not two:
        np.fill_diagonal(alike, False)
    a, b = alike.any(1), alike.any(0)
    left, right, alike = left[a], right[b], alike[a][:, b]
    if not len(left):
        return
    used = np.union1d(left, right)
    rows, sizes = rows.iloc[used], sizes[used]
    left, right, n = np.searchsorted(used, left), np.searchsorted(used, right), len(used)
    values, inverse, count = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in rows["shingles"]]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    number = np.cumsum(count > 1) - 1  # only shingles of two rows or more matter
    keep = count[inverse] > 1
    row, column = row[keep], number[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros(alike.shape, np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part[left] @ part[right].T
    alike &= both >= threshold * (sizes[left][:, None] + sizes[right][None] - both) - 1e-6
    copies = rows["copies"].to_numpy(np.int64)
    links = np.zeros(n, np.int64)
    np.add.at(links, left, (alike * copies[right][None]).sum(1))
    if two:
        np.add.at(links, right, (alike * copies[left][:, None]).sum(0))
    root = np.full(n, -1)
    of_left, of_right = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
    for i in np.flatnonzero(links):
        if root[i] >= 0:
            continue
        root[i], front = i, [i]
        while front:
            v = front.pop()
            near = set()
            if v in of_left:
                near.update(right[alike[of_left[v]]].tolist())
            if v in of_right and two:
                near.update(left[alike[:, of_right[v]]].tolist())
            for w in near:
                if root[w] < 0:
                    root[w] = i
                    front.append(w)
    keys = rows["c"].tolist()
    for i in np.flatnonzero(links):
        yield keys[i], int(links[i]), keys[root[i]]


def met_by(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with the only row of one for each key, where many rows of `many` may have one key.

    `one` comes from an aggregation by the key and would be joined where it lies. A second key, which follows from the
    first, has both sides dealt anew for the join alone, so that adaptive skew joins can split a key with many rows."""
    also = fresh(many, "also")
    return many.withColumn(also, F.hash(key)).join(one.withColumn(also, F.hash(key)), [key, also], how).drop(also)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, root): the least node of the component of each node of edges(u, v), by alternating stars: neighbours are
    tied to the least one around until nothing changes. Each round is a written table."""
    now, seen, step = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"), None, 0
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m"))
        large = met_by(ways.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met_by(large, low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small, f"stars{step}")
        sign = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if step:
            scratch.drop(f"stars{step - 1}")
        if sign == seen or not sign[0]:
            return new.select(F.col("u").alias("c"), F.col("v").alias("root"))
        now, seen, step = new, sign, step + 1


def matched_pairs(met: DataFrame, threshold: float, paired: int) -> DataFrame:
    """(a, b) of the rows of small nodes that match: each node is its rows in the order of their labels, and two of
    them match if they share the shorter of their prefixes and their lengths are near enough."""
    node = met.filter(F.col("size") <= paired).groupBy("key", "t").agg(F.sort_array(F.collect_list(F.struct("label", "length", "n", "c"))).alias("rows"))

    def match(x: Column, y: Column) -> Column:
        shared = F.least(x["length"], y["length"]) * 2
        return (F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])) & (
            F.substring(x["label"], F.lit(1), shared) == F.substring(y["label"], F.lit(1), shared))

    pairs = F.flatten(F.transform("rows", lambda x, i: F.transform(
        F.filter(F.slice("rows", i + 2, F.lit(paired)), lambda y: match(x, y)),
        lambda y: F.struct(F.least(x["c"], y["c"]).alias("a"), F.greatest(x["c"], y["c"]).alias("b")))))
    return node.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def blocked(met: DataFrame, threshold: float, paired: int, block: int) -> DataFrame:
    """(c, key, t, low, i, high, j, side): the rows of large nodes dealt to pairs of blocks, each two rows that can be
    alike to one. Blocks hold sets of about one length, so that only those of the same and the next length meet."""
    step = math.log(1 / threshold) + 1e-6 if threshold < 1 else 1e-6
    rows = met.filter(F.col("size") > paired).select("key", "t", "c", F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("band"))
    wide = F.greatest(F.lit(8), F.floor(F.lit(float(SHINGLES)) / F.exp((F.max("band") + 1) * step)))
    most = F.least(F.greatest(F.lit(block), F.floor(F.count("*") / 16)), F.lit(8 * block), wide)  # a 16th of a node, within bounds
    bands = rows.groupBy("key", "t", "band").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    node = bands.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("t", "band"), "n"))).alias("blocks"))  # a few for each length
    rows = met_by(rows, node, "key")
    of = lambda d: F.coalesce(F.try_element_at("blocks", F.struct("t", (F.col("band") + d).alias("band"))), F.lit(0))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), of(0)).cast("int"))
    every = lambda d, make: F.transform(F.sequence(F.lit(1), of(d), F.lit(1)) if d == 0 else F.slice(F.sequence(F.lit(1), of(d) + 1), F.lit(1), of(d)), lambda x: make(x - 1))
    pair = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))
    band, own = F.col("band"), F.col("own")
    to = F.concat(every(0, lambda j: pair(band, F.least(own, j), band, F.greatest(own, j), own > j)),
                  every(1, lambda j: pair(band, own, band + 1, j, F.lit(0))), every(-1, lambda j: pair(band - 1, j, band, own, F.lit(1))))
    return rows.select("key", "t", "c", F.explode(to).alias("to")).select("key", "t", "c", "to.*")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, paired: int = PAIRED,
                    block: int = BLOCK, scratch: Scratch | None = None, keyed: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: rows that are connected by links, pairs of Jaccard similarity of at
    least the threshold, have the same class_id, the smallest doc_id among them; n_links counts the other rows that a
    row is linked to. If keyed also text_key, a hash of the text, and stays, which holds for one (doc_id, text_key) of
    each class: that of the smallest doc_id, null the last, and there of the smallest text_key.

    Texts with equal sets are one node with a number of copies, so copies never meet. Trie nodes of up to `paired` rows
    give pairs, which are verified by a join with their sets. In larger nodes all rows are compared, block by block,
    inside tasks that return only each row's number of links and one row that it is connected to: no node's pairs
    become rows, and no link is left out.

    Defined cases: null text is empty; all texts without words are copies of each other; rows with equal doc_id and
    text are copies; a class whose doc_ids are all null has class_id null; an empty table gives no rows; other columns
    are ignored."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "forest")
    long_rows(spark)
    lengths = prefix_lengths(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    more = ["text_key"] if keyed else []
    sketch = scratch.save(texts.select("doc_id", "text", *[text_key("text").alias(k) for k in more]).mapInArrow(
        _each(lambda i, s, *x: (i, set_key(s), len(s), label(s) if len(s) else None, *x), ["doc_id", "c", "n", "label", *more],
              [pa.int64(), pa.binary(), pa.int32(), pa.binary(), *[pa.int64() for _ in more]]), ", ".join(["doc_id long, c binary, n int, label binary", *[f"{k} long" for k in more]])), "sketch")
    best = ["best"] if keyed else []
    nodes = scratch.save(sketch.groupBy("c").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("label").alias("label"),
        *[F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias(b) for b in best]), "nodes")

    #: In each tree the runs of the shortest prefix.
    length = F.get(F.array(*[F.lit(k) for k in lengths]), F.least("n", F.lit(FEW)))
    rows = nodes.filter("n > 0").select("c", "n", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("t"), F.substring("label", t * (2 * LONGEST) + 1, F.lit(2 * LONGEST)).alias("label")))).alias("x")).select("c", "n", "length", "x.t", "x.label")
    rows = rows.withColumn("key", F.xxhash64("t", F.substring("label", 1, 2 * min(lengths))))
    size = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = scratch.save(met_by(rows, size, "key"), "met")
    members = met.groupBy("c").agg(F.max("size").alias("largest"), F.map_from_entries(F.collect_list(F.struct("t", "size"))).alias("sizes"))
    members = scratch.save(members.join(nodes, "c").select("c", "rep", "copies", "largest", "n", length.alias("length"), "label", F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("sizes", t), F.lit(0))).alias("sizes")), "members")
    ids = members.select(F.col("rep").alias("doc_id")).filter("doc_id is not null")
    ids = F.broadcast(ids) if members.count() <= BROADCAST_IDS else ids
    named = texts.join(ids, "doc_id", "left_semi").unionByName(texts.filter("doc_id is null"))
    sets = named.mapInArrow(_each(lambda i, s: (set_key(s), s.tobytes()), ["c", "packed"], [pa.binary(), pa.binary()]), "c binary, packed binary")
    sets = scratch.save(sets.dropDuplicates(["c"]), "sets")

    pairs = matched_pairs(met, threshold, paired)
    about = members.select("c", "copies")
    pairs = pairs.join(sets.select(F.col("c").alias("a"), F.col("packed").alias("x")), "a").join(
        sets.select(F.col("c").alias("b"), F.col("packed").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            for at, n in parts((len(x.as_buffer() or b"") for x in batch.column(2)), total=1 << 23):
                a, b, x, y = (batch.column(k).slice(at, n).to_pylist() for k in range(4))
                keep = []
                for k, (p, q) in enumerate(zip(x, y)):
                    p, q = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
                    n = len(np.intersect1d(p, q, assume_unique=True))
                    if n >= threshold * (len(p) + len(q) - n) - 1e-9:
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in keep], pa.binary()) for v in (a, b)], names=["a", "b"])

    links = scratch.save(pairs.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"), "links")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ways.join(about.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("copies").alias("links"))

    large = blocked(met, threshold, paired, block).join(members.filter(F.col("largest") > paired).select("c", "copies", "n", "length", "label", "sizes"), "c").join(
        sets.select("c", F.col("packed").alias("shingles")), "c")

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, tree, low, i, high, j = key
        found = list(_blocks(rows, int(tree), (low, i) != (high, j), threshold, paired))
        return pd.DataFrame({name: pd.Series([f[k] for f in found], dtype=object) for k, name in enumerate(("c", "links", "root"))})

    inside = scratch.save(large.groupBy("key", "t", "low", "i", "high", "j").applyInPandas(compare, "c binary, links long, root binary"), "inside")
    counts = counts.unionByName(inside.select("c", "links")).groupBy("c").agg(F.sum("links").alias("links"))
    stars = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(inside.select(F.col("c").alias("u"), F.col("root").alias("v"))), scratch)
    scratch.drop("met", "sets")
    #: Every linked node with its root; the root's own row has no edge.
    linked = stars.unionByName(stars.select(F.col("root").alias("c"), "root").distinct())
    grouped = linked.join(nodes.select("c", "rep", *best), "c")
    least = grouped.groupBy("root").agg(F.min("rep").alias("class_id"), *[F.min(b).alias(f"class_{b}") for b in best])
    classes = nodes.select("c", "rep", "copies", *best).join(met_by(linked, least, "root").select("c", "class_id", *[f"class_{b}" for b in best]), "c", "left").join(counts, "c", "left").select(
        "c", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), *[F.coalesce(f"class_{b}", b).alias(b) for b in best])
    classes = scratch.save(classes, "classes")
    scratch.drop("nodes", "members", "links", "inside", "edges", *[name for name in scratch.saved if name.startswith("stars")])
    stays = [(F.col("doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col("text_key") == F.col(f"{b}.text_key"))).alias("stays") for b in best]
    return met_by(sketch.select("doc_id", "c", *more), classes, "c").select("doc_id", "class_id", "n_links", *more, *stays)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs from each class: that of the smallest doc_id, null the last; of rows that are equal in doc_id and
    text one stays. A row is told by its doc_id and text, so a doc_id may have several texts, or be null."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.save(near_duplicates(docs, threshold, scratch=scratch, keyed=True), "found")
    scratch.drop("sketch", "classes")
    key, gone_id, gone_key = fresh(docs, "text_key"), fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = found.filter("not stays").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    number = gone.count()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    kept = docs.withColumn(key, text_key("text")).join(F.broadcast(gone) if number <= BROADCAST_IDS else gone, same, "left_anti")
    repeated = found.filter("stays").groupBy("doc_id", "text_key").count().filter("count > 1")
    if not repeated.isEmpty():  # of rows that differ in other columns only, the first by a hash of all
        row, every = F.struct(*[F.col(f"`{c}`") for c in kept.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns])
        kept = kept.groupBy("doc_id", key).agg(F.min_by(row, every).alias("row")).select("row.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
