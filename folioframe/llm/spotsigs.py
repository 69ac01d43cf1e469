"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common word, the anchor, and the chain of content words that follows it. The fingerprint is the set
of a text's signatures; sets are partitioned by length and compared by Jaccard similarity, pruned by length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, let, range_bounds, range_piece, table, width

#: Common words of English, French, German and Spanish. Each occurrence starts a chain, and chains skip them; fixed values.
ANCHORS = ["the", "of", "to", "is", "that", "was", "with", "a", "an", "and", "in", "for", "it", "as", "on", "are", "this",
           "by", "be", "at", "from", "or", "have", "has", "had", "not", "but", "they", "he", "she", "his", "her", "you", "we",
           "le", "la", "les", "de", "des", "du", "et", "que", "pour", "un", "une", "est", "dans", "qui", "par", "sur", "au",
           "avec", "ce", "il", "ne", "pas", "plus", "se", "son",
           "der", "die", "das", "und", "von", "den", "zu", "ist", "dem", "ein", "eine", "mit", "auf", "für", "nicht", "sich",
           "im", "als", "auch", "es", "er", "sie",
           "el", "los", "las", "y", "en", "del", "una", "con", "para", "no", "su", "al", "lo", "por", "como", "más"]
#: Content words without an anchor from which on every content word starts a chain.
GAP = 32


def signatures(text: Column) -> Column:
    """A text's signatures as ascending 32-bit hashes, a repeated one told apart by its number: for the j-th common
    word, at position p, the next two content words are number p - j and p - j + 1 of all content words, so every pass
    is linear in the words.

    For lists and for texts in other languages there is one more rule: before the first anchor, and from GAP content
    words after an anchor on, every content word starts a chain, up to the next anchor. A text without words has one
    signature for the whole text, the empty text has none."""
    skipped = ["", *ANCHORS]  # a text that begins or ends with no word has an empty one there

    def chains(w: Column) -> Column:
        content = F.filter(w, lambda x: ~x.isin(skipped))
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(skipped), i).otherwise(-1)), lambda i: i >= 0)
        anchors = let(F.struct(w.alias("w"), spots.alias("s")), lambda v: F.array_compact(F.transform(
            v["s"], lambda p, j: F.when(F.get(v["w"], p).isin(ANCHORS), F.struct(F.get(v["w"], p).alias("a"), (p - j).alias("k"))))))

        def starts(v: Column) -> Column:
            edges = F.concat(F.array(F.lit(-GAP)), F.transform(v["a"], lambda x: x["k"]), F.array(F.size(v["c"])))
            return let(edges, lambda e: F.flatten(F.transform(e, lambda k, i: F.when(
                F.get(e, i + 1) - k > GAP, F.sequence(k + GAP, F.get(e, i + 1) - 1)).otherwise(F.array().cast("array<int>")))))

        return let(F.struct(content.alias("c"), anchors.alias("a")), lambda v: F.concat(
            F.transform(v["a"], lambda x: F.hash(x["a"], F.get(v["c"], x["k"]), F.get(v["c"], x["k"] + 1))),
            F.transform(starts(v), lambda i: F.hash(F.lit(""), F.get(v["c"], i), F.get(v["c"], i + 1)))))

    def numbered(s: Column) -> Column:
        """The r-th repeat of x becomes hash(x, r); its first place is found by binary search in the sorted array."""
        def first(x: Column, i: Column) -> Column:
            low = F.aggregate(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), F.lit(-1), lambda at, b: let(
                at + F.pow(F.lit(2), b).cast("int"), lambda to: F.when((to < i) & (F.get(s, to) < x), to).otherwise(at)))
            return low + 1
        return F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), F.hash(x, i - first(x, i))).otherwise(x))

    found = let(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), chains)
    whole = let(found, lambda s: F.when((F.size(s) == 0) & (text != ""), F.array(F.hash(text))).otherwise(s))
    return F.sort_array(F.array_distinct(let(F.sort_array(whole), numbered)))


def fingerprint(sigs: Column) -> Column:
    """The set as a string: its length, then eight hexadecimal digits for each signature."""
    digits = F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.array_join(digits, ""))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike (1). Sets whose lengths alone keep them below
    `at_least` give 0 without being compared."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(long == 0, 1.0).when((short == 0) | (short < at_least * long), 0.0).otherwise(both)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and their signatures, with next_text and next_sigs of the next row by (doc_id, text), the first
    after the last.

    The order is dealt in ranges of doc_id. The first rows of a range are also copied to the end of the range before
    it, so every row finds its successor in its own range and no task sorts all of them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = width(docs.sparkSession)
    bounds = range_bounds(docs.select(F.col("doc_id").cast("long")), "doc_id", 8 * n)
    rows = rows.withColumn("piece", range_piece("k", bounds))
    lowest = {r[0]: r[1] for r in docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k")).withColumn(
        "piece", range_piece("k", bounds)).groupBy("piece").agg(F.min("k")).collect()}  # 8 rows a partition at most
    used = sorted(lowest)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    last = used[-1] if used else 0

    def by_piece(values: dict, kind: str) -> Column:
        return F.get(F.array(*[F.lit(values.get(p)).cast(kind) for p in range(last + 1)]), F.col("piece"))

    own = F.struct(F.col("piece"), F.lit(0).alias("extra"))
    extra = F.struct(by_piece(before, "int").alias("piece"), F.lit(1).alias("extra"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("k") == by_piece(lowest, "long"), F.array(own, extra)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "k", F.col("at.piece").alias("piece"), F.col("at.extra").alias("extra"))
    rows = rows.repartition(n, "piece").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("piece").orderBy("extra", "k", "text")
    return rows.select(
        "doc_id", "text", "sigs", "extra", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs")
    ).filter("extra = 0").drop("extra")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and how alike they and the next row's are.

    The edited text has the last quarter of the characters, rounded down, replaced by the first as many of the next
    row's text. Defined cases: null text is empty; rows with equal doc_id are ordered by text, null doc_id first; a
    single row is its own successor; an empty table gives no rows; other columns are ignored."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of different sets with likeness >= at_least, each named by its smallest doc_id, null if it has
    none; a <= b, null the last.

    Equal sets are one set first, told from others by its fingerprint, so doc_ids may be null or repeated. Sets are
    partitioned by length so that a set can only match its own and the next partition, and meet there on their rarest
    signatures: two sets this alike share one among the rarest n - ceil(at_least * n) + 1 of each."""
    scratch = Scratch(docs.sparkSession, "spotsigs")
    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).groupBy("sigs").agg(
        F.min("doc_id").alias("doc_id")).filter(F.size("sigs") > 0)
    sets = scratch.save(sets.withColumn("c", F.sha2(fingerprint(F.col("sigs")), 256)), "sets")
    sized = sets.select("c", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = sized.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    rank = Window.partitionBy("c").orderBy("df", "sig")
    sized = sized.join(seen, "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("i", F.row_number().over(rank))
    step = math.log(1 / at_least)
    keys = sized.filter((F.col("i") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1) & (F.col("df") > 1)).select(
        "c", "n", "sig", F.floor(F.log(F.col("n").cast("double")) / step).alias("part"))
    left = keys.select(F.col("c").alias("ca"), F.col("n").alias("na"), "sig", "part")
    right = keys.select(F.col("c").alias("cb"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    met = left.join(right, ["sig", "part"]).filter(
        (F.col("ca") < F.col("cb")) & (F.least("na", "nb") >= at_least * F.greatest("na", "nb"))).select("ca", "cb").distinct()
    met = met.join(sets.select(F.col("c").alias("ca"), F.col("doc_id").alias("ia"), F.col("sigs").alias("sa")), "ca").join(
        sets.select(F.col("c").alias("cb"), F.col("doc_id").alias("ib"), F.col("sigs").alias("sb")), "cb")
    a = F.least("ia", "ib")  # of a null and an id the id
    b = F.when(F.col("ia").isNotNull() & F.col("ib").isNotNull(), F.greatest("ia", "ib"))
    return met.select(a.alias("a"), b.alias("b"), likeness(F.col("sa"), F.col("sb"), at_least).alias("similarity")).filter(F.col("similarity") >= at_least)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
