"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier learns from confirmed toxic texts and unlabelled text. The risk of calling unlabelled text
clean is corrected by the class prior for the toxic texts in it, and held at zero from below.
"""

from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import Scratch, grouped_words, long_rows, mix64, table

#: Rows that the classifier is fitted on at most: confirmed toxic ones, and unlabelled ones. Every row is scored.
POSITIVES, UNLABELLED = 2500, 7500
#: Features of all rows of a sample that the driver gets at most, and the part of them that one row may have.
SAMPLED, SHARE = 1 << 24, 16
#: Features of the classifier at most, and the chance (a Poisson tail) that one is as frequent in toxic texts as it is
#: in all, below which it counts.
FEATURES, CHANCE = 2048, 1e-6
STEPS, RATE, DECAY = 300, 0.05, 1e-4
#: Beginnings of words that are features besides the words, in characters.
STEMS = (4, 5, 6)
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is in the fold whose labels are never learned from; false for null doc_ids, which have no labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 64-bit feature) for the words of each text and their beginnings, with repeats."""
    whose, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for text, words in grouped_words(texts):
        text = text[words.whose]
        whose.append(text)
        found.append(words.hash(words.start, words.end, 7))
        for n in STEMS:
            long = words.end - words.start > n
            whose.append(text[long])
            found.append(words.hash(words.start[long], words.start[long] + n, 100 + n))
    return np.concatenate(whose), np.concatenate(found)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the features that a text has)))."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.keys) and texts:
            seen = np.zeros(1 << 22, bool)
            seen[self.keys >> np.uint64(42)] = True
            whose, found = features(texts)
            keep = seen[found >> np.uint64(42)]
            whose, found = whose[keep], found[keep]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            keep = self.keys[at] == found
            pairs = np.unique(np.stack([whose[keep], at[keep]], 1), axis=0)
            np.add.at(total, pairs[:, 0], self.weights[pairs[:, 1]])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def nnpu(x: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic losses.

    x and u are the rows of the positive and the unlabelled texts. Where the corrected risk of the clean class is
    below zero, the step goes up on that part alone, as it is then over-fitted."""
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        zp, zu = (rows @ w.astype(np.float32) + b for rows in (x, u))  # float32 on both sides: no copy of the rows
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(x), su / len(u)
        if clean >= 0:
            gp = gp - prior * sp / len(x)
        else:
            gp, gu = prior * sp / len(x), -gu
        grad = np.append(gp.astype(np.float32) @ x + gu.astype(np.float32) @ u + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def apart(texts: list[np.ndarray], sketch: int = 8, alike: int = 5) -> list[np.ndarray]:
    """The texts without near copies of earlier ones, which would make chance words look frequent: those of which
    `alike` of `sketch` minimum hashes agree."""
    mins = np.array([[mix64(t ^ mix64(np.full(1, k + 1, np.uint64))).min() if len(t) else k for k in range(sketch)] for t in texts], np.uint64).reshape(-1, sketch)
    return [t for i, t in enumerate(texts) if not ((mins[:i] == mins[i]).sum(1) >= alike).any()]


def _places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where in the ascending keys those of `found` stand that are there."""
    if not len(keys):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return at[keys[at] == found]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """positive and unlabelled hold the different features of each text; of the latter only those that two positive
    ones have matter."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0 if not positive else 0.0)
    positive = apart(positive)
    np_, nu = len(positive), len(unlabelled)
    keys, cp = np.unique(np.concatenate(positive), return_counts=True)
    both = np.zeros(len(keys), np.int64)
    for f in unlabelled:
        both[_places(keys, f)] += 1
    expected = np_ * (both + 1) / (nu + 1)
    tail = cp * np.log(expected) - expected - np.array([lgamma(c + 1) for c in range(np_ + 1)])[cp]
    good = np.flatnonzero((cp > expected) & (tail < log(CHANCE)))
    keys = np.sort(keys[good[np.argsort(tail[good], kind="stable")][:FEATURES]])

    def rows(texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(keys)), np.float32)
        for i, f in enumerate(texts):
            out[i, _places(keys, f)] = 1
        return out

    return Model(keys, *nnpu(rows(positive), rows(unlabelled), prior))


def _first() -> Column:
    return F.xxhash64("doc_id", F.lit("sample"))


def _sampled(docs: DataFrame, ids: DataFrame, most: int, among: np.ndarray | None = None) -> list[np.ndarray]:
    """The different features of the whole texts of at most `most` rows with one of the ids, or those of them that are in
    `among`: rows are taken in order of a hash of doc_id, each whole, until the next would make them more than SAMPLED
    features together; a row with more than a SHARE of that is passed over. All this bounds what the driver gets."""

    def distinct(batches):
        for batch in batches:
            for doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                found = np.unique(features([text])[1])
                found = found if among is None else among[_places(among, found)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["doc_id", "n", "f"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.select("doc_id", "text").mapInArrow(distinct, "doc_id long, n long, f binary").orderBy(_first(), "doc_id", "f").limit(most)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    size = np.array([r.n for r in rows.select("n").orderBy("row").collect()], np.int64)  # `most` numbers at most
    fits = size <= SAMPLED // SHARE
    last = int(np.searchsorted(np.cumsum(np.where(fits, size, 0)), SAMPLED, "right"))
    found = [np.frombuffer(r[0], np.uint64) for r in rows.filter((F.col("row") < last) & (F.col("n") <= SAMPLED // SHARE)).orderBy("row").select("f").collect()]
    scratch.close()
    return found


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most POSITIVES toxic and UNLABELLED other rows, those first by a hash of doc_id, none of the held-out
    fold. The prior is the share of toxic rows among all labelled rows outside that fold.

    Defined cases: rows of either table with null doc_id and labels that are null teach nothing; a doc_id with several
    labels counts for each; of repeated rows as many count as the bounds leave; without a toxic row all scores are
    about 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(_first(), "doc_id").limit(POSITIVES)
    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    other = texts.select("doc_id").distinct().orderBy(_first(), "doc_id").limit(UNLABELLED)
    positive = _sampled(texts, toxic, POSITIVES)
    keys, count = np.unique(np.concatenate(positive), return_counts=True) if positive else (np.zeros(0, np.uint64), np.zeros(0))
    return fit(positive, _sampled(texts, other, UNLABELLED, keys[count > 1]), prior)


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with a score from 0 to 1 as column `name`, from the whole text alone.

    Defined cases: null text is empty and has the score of a text without features; rows with equal texts have equal
    scores; an empty table gives no rows. Other columns pass through."""

    long_rows(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        parts, at = [], 0
        while at < len(texts):  # about half a million characters at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 19):
                size += len(texts[end])
                end += 1
            parts.append(model.score(texts[at:end]))
            at = end
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, scored(F.col("text")))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
