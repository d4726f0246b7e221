"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and a sample of unlabelled text train a linear
classifier over word features.  The risk of calling the positives negative,
times the class prior, is taken out of the unlabelled text's risk of being
called positive, and what is left is not let below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, parts, release, rows_of, slices, text_rows
from .hashing import LOWER, Running, U, mix, runs

BITS = 20
PREFIXES = (4, 5, 6)  # bytes; stems of words whose endings vary
STEP = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the word features of a buffer.

    Words are runs of letters, in lower case (ASCII and Latin-1).  A feature is
    a whole word or its first 4, 5 or 6 bytes.
    """
    a = LOWER[np.frombuffer(data, np.uint8)]
    fold = np.flatnonzero(a[:-1] == 0xC3) + 1
    fold = fold[(a[fold] >= 0x80) & (a[fold] <= 0x9E) & (a[fold] != 0x97)]
    a[fold] += 0x20
    starts, ends = runs(LETTER[a])
    hashed = Running(a)
    at, found = [starts], [hashed.of(starts, ends)]
    for n in PREFIXES:
        long_ = starts[ends - starts > n]
        at.append(long_)
        found.append(mix(hashed.of(long_, long_ + n) + U(n)))
    return np.concatenate(at), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def text_features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with ``wanted``, a table of places by bucket, only of those, as places."""
    pairs = []

    def look(i: int, j: int, parts: list[bytes]):
        places, buckets = features(b" ".join(parts))
        if wanted is not None:
            buckets = wanted[buckets]
            hit = np.flatnonzero(buckets >= 0)
            places, buckets = places[hit], buckets[hit]
        owner = i + np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), places, "right") if j - i > 1 else np.full(len(places), i)
        pairs.append(np.unique(owner << BITS | buckets))

    for i, j in slices([len(t) for t in texts], STEP):
        if j - i > 1 or len(texts[i]) <= STEP:
            look(i, j, texts[i:j])
            continue
        text, at = texts[i], 0
        while at < len(text):  # a very long text in parts, cut after a word
            end = min(len(text), at + STEP)
            while end < len(text) and LETTER[text[end]]:
                end += 1
            look(i, j, [text[at:end]])
            at = end
    joined = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return joined >> BITS, joined & ((1 << BITS) - 1)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        wanted = np.full(1 << BITS, -1, np.int64)
        wanted[self.buckets] = np.arange(len(self.buckets))
        rows, columns = text_features(texts, wanted)
        margin = np.bincount(rows, self.weights[columns], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def without_copies(rows: list[np.ndarray], size: int = 32, share: float = 0.5) -> list[np.ndarray]:
    """Rows whose bottom-``size`` sketch does not mostly equal an earlier one's.

    Copies of one document would make its chance words look like evidence.
    """
    kept, by_value = [], {}
    for row in rows:
        sketch = np.sort(mix(row.astype(np.uint64) + U(1)))[:size].tolist()
        seen = [k for v in sketch for k in by_value.get(v, ())]
        if seen and np.bincount(seen).max() >= share * len(sketch):
            continue
        for v in sketch:
            by_value.setdefault(v, []).append(len(kept))
        kept.append(row)
    return kept


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = 8192, sure: float = 5.0) -> np.ndarray:
    """Buckets that mark a text as positive, the surest first, ``most`` of them.

    Of the texts with such a feature at least half are positive, as the prior
    and the two shares have it, and the chance that so many positives have it
    by accident is below e^-``sure``.
    """
    p = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    u = np.bincount(np.concatenate(unlabelled), minlength=1 << BITS)
    expected = (u + 0.5) * len(positive) / (len(unlabelled) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(p * prior >= 0.5 * expected, p * np.log(p / expected) - p + expected, 0)
    good = np.flatnonzero(evidence >= sure)
    return good[np.argsort(-evidence[good], kind="stable")][:most]


def gradient(theta: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[np.ndarray, float]:
    """The step's direction for weights and, as the last, the bias; and the negative part of the risk.

    Either sample is given as (rows, columns, number of rows).  Where the
    negative part, the unlabelled text's less the positives' share, has fallen
    below zero, only its way back up counts.
    """
    k, (pr, pc, n_p), (ur, uc, n_u) = len(theta) - 1, positive, unlabelled

    def pulled(row, column, weight):
        """Gradient of the sum of weight times margin."""
        return np.append(np.bincount(column, weight[row], k), weight.sum())

    mp = np.bincount(pr, theta[pc], n_p) + theta[k]
    mu = np.bincount(ur, theta[uc], n_u) + theta[k]
    up, uu = 1 / (1 + np.exp(-np.clip(mp, -30, 30))), 1 / (1 + np.exp(-np.clip(mu, -30, 30)))
    negative = float(np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean())
    g_plus = pulled(pr, pc, -prior * (1 - up) / n_p)
    g_minus = pulled(ur, uc, uu / n_u) - pulled(pr, pc, prior * up / n_p)
    return (g_plus + g_minus if negative >= 0 else -g_minus), negative


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 1_000, rate: float = 0.1, decay: float = 2e-6) -> Model:
    """Adam on the non-negative risk with the logistic loss, over all rows each round."""
    prior = min(max(prior, 1e-4), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    buckets = choose(positive, unlabelled, prior)
    place = np.full(1 << BITS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))

    def matrix(rows):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = place[np.concatenate(rows)]
        return row[column >= 0], column[column >= 0]

    (pr, pc), (ur, uc) = matrix(positive), matrix(unlabelled)
    k, n_p, n_u = len(buckets), len(positive), len(unlabelled)
    theta = np.zeros(k + 1)
    theta[k] = bias
    first, second = np.zeros(k + 1), np.zeros(k + 1)

    for t in range(1, rounds + 1):
        g, _ = gradient(theta, (pr, pc, n_p), (ur, uc, n_u), prior)
        g[:k] += decay * theta[:k]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(buckets, theta[:k], float(theta[k]))


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def extract(rows: DataFrame, most: int) -> list[np.ndarray]:
    """Distinct buckets of each text of at most ``most`` different rows, those with the smallest hashes, in the order of ids."""

    def run(batches):
        only(None)
        for batch in batches:
            packed = []
            for _, _, texts in parts(batch, STEP):
                row, bucket = text_features(texts)
                cuts = np.searchsorted(row, np.arange(len(texts) + 1))
                packed += [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(packed, pa.binary())], ["doc_id", "key", "features"])

    found = rows.mapInArrow(run, "doc_id long, key long, features binary")
    once = found.groupBy("doc_id", "key").agg(F.first("features").alias("features"))  # repeated rows count once
    got = once.orderBy("key", "doc_id").limit(most).toArrow()
    order = sorted(zip(got["doc_id"].to_pylist(), got["features"].to_pylist(), strict=True))
    return [np.frombuffer(f, np.uint32).astype(np.int64) for _, f in order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 3_000, most_unlabelled: int = 6_000, prior: float | None = None) -> Model:
    """Fit on at most ``most_positive`` confirmed toxic documents and ``most_unlabelled`` of any.

    Both samples are rows with small hashes among those that are not held out
    and have an id and a text; rows that repeat both count once.  No labels but
    the positives' are used, except that without a ``prior`` the share of
    positives among the learnable labels stands for it.  Null labels and
    ids are left out; a document with both labels counts as toxic.  Without
    documents or labels the model knows no feature and its score is below the
    usual thresholds.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    known = rows_of(labels, doc_id=F.col(f"`{id_col}`").cast("long"), label=F.col(f"`{label_col}`").cast("int")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id")))
    if prior is None:
        share = known.agg(F.avg("label").alias("share")).first()["share"]
        prior = 0.1 if share is None else share
    ids = [r.doc_id for r in known.where("label = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive).collect()]
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    positive = extract(rows.join(F.broadcast(chosen), "doc_id", "left_semi"), most_positive)  # at most most_positive ids
    n = docs.count()
    # a third is held out; the limit takes the rest of the excess
    below = min((1 << 63) - 1, int((3.3 * most_unlabelled / max(1, n) - 1) * (1 << 63)))
    unlabelled = extract(rows.where(F.col("key") <= below), most_unlabelled)
    release(spark)  # the JVM's copies of the samples, before the fit takes its own memory
    model = fit(positive, unlabelled, prior)
    del positive, unlabelled
    release(spark)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    Only the text enters the score.  Null and empty texts get the score of no
    feature at all.  Null ids are never held out; repeated rows give a row
    each; extra columns are ignored; an empty table gives no rows.
    """
    buckets, weights, bias = model.buckets, model.weights, model.bias

    def run(batches):
        only(None)
        own = Model(buckets, weights, bias)
        for batch in batches:
            scores = [own.scores(texts) for _, _, texts in parts(batch, STEP)] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``.

    Null and empty texts have no feature and stay; repeated rows fare alike.
    """
    buckets, weights, bias = model.buckets, model.weights, model.bias

    def run(batches):
        only(None)
        own = Model(buckets, weights, bias)
        for batch in batches:
            scores = [own.scores(texts) for _, _, texts in parts(batch, STEP, text_col)] or [np.zeros(0)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    as_bytes = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("binary"))
    return as_bytes.mapInArrow(run, as_bytes.schema).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
