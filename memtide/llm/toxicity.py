"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled texts are a sample of all documents outside the held-out fold,
whether labelled or not. No other label is read, and the class prior is estimated from those two alone. With the prior p, the risk of a classifier is p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]) (Kiryo et al.
2017): what the positives would add to the unlabelled negatives' loss is taken out, and the rest may not fall below zero,
else the step goes the other way. Linear models over words and beginnings of words are trained in numpy on bags of the
unlabelled texts and averaged. Fitting sees a bounded sample; the scan scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize, release
from memtide.llm.workers import frugal

_words = re.compile(r"[^\W\d_]+").findall
PREFIXES = (5, 6, 7)
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; zero is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(f"{word[:k]}*".encode()) for k in PREFIXES if len(word) > k]


_TWICE = 0x9E3779B9  # marks the feature "twice or more" of a hash


def document_features(text: str | None) -> list[int]:
    """Hashes of all words and beginnings of a text, and again of those that occur twice or more."""
    seen: Counter[int] = Counter()
    for word, n in Counter(_words((text or "").lower())).items():
        for f in features_of(word):
            seen[f] += n
    return sorted({*seen, *(f ^ _TWICE for f, n in seen.items() if n > 1)})


@dataclass
class ToxicModel:
    """Weights by feature hash. Without a confirmed toxic text there are none and every score is 0."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -1e9
    prior: float = 0.0

    def scorer(self):  # noqa: ANN201
        known: dict[str, tuple[int, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            seen: Counter[int] = Counter()
            for word, n in Counter(_words((text or "").lower())).items():
                found = known.get(word)
                if found is None:
                    if len(known) > 100_000:
                        known.clear()
                    found = known[word] = tuple(f for f in features_of(word) if f in weights or f ^ _TWICE in weights)
                for f in found:
                    seen[f] += n
            z = bias + sum(weights.get(f, 0.0) + (weights.get(f ^ _TWICE, 0.0) if n > 1 else 0.0) for f, n in sorted(seen.items()))
            return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))

        return score


def nnpu_step(theta: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float) -> tuple[float, np.ndarray]:
    """What the negatives' loss comes to, and the direction to step against: the risk's gradient, or, where that loss is
    below zero, the gradient of its opposite. The ridge is on the weights, not on the bias, which comes last."""
    w = theta[:-1].astype(pos.dtype)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    zp, zu = pos @ w + theta[-1], unl @ w + theta[-1]
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    as_pos, as_neg, of_unl = -prior * sigmoid(-zp) / len(zp), -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    gp, gu = (as_pos + as_neg, of_unl) if rest >= 0 else (-as_neg, -of_unl)
    return float(rest), np.append(pos.T @ gp.astype(pos.dtype) + unl.T @ gu.astype(pos.dtype) + ridge * theta[:-1], gp.sum() + gu.sum())


def nnpu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Weights and, last, bias of a logistic model under the non-negative risk. Rows are texts, columns 0/1 features."""
    width = pos.shape[1]
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, grad = nnpu_step(theta, pos, unl, prior, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def feature_counts(sampled: DataFrame) -> DataFrame:
    """``(p, f)`` -> ``(f, a, b)``: confirmed and unlabelled texts that have a feature, for those of three confirmed or more."""
    counts = sampled.select("p", F.explode("f").alias("f")).groupBy("f").agg(F.sum(F.col("p").cast("int")).alias("a"), F.sum((~F.col("p")).cast("int")).alias("b"))
    return counts.where("a >= 3")


#: Shares of the confirmed texts that a feature must have to speak for the class prior; the first that any feature has counts.
SUPPORT = (0.1, 0.02, 0.0)


def class_prior(counts: DataFrame, n_pos: int, n_unl: int) -> float:
    """The share of toxic texts among the unlabelled ones, from confirmed and unlabelled texts alone.

    ``P(f) >= prior * P(f | toxic)`` for any feature, with equality where only toxic texts have it. So the prior is at most
    the least quotient, and close to it if any feature is that of toxic texts alone. Each rate is moved by its standard
    error to the side that makes the quotient larger. That doesn't do for tens of thousands of rare features, the least of
    whose quotients is one of chance: only features of a tenth of the confirmed texts are asked, if there are such
    (``SUPPORT``). Where no feature says anything, the prior is the share of confirmed texts, below a half. Between 0.001
    and 0.9.
    """
    p, u = F.col("a") / n_pos, F.col("b") / n_unl
    low = p - F.sqrt(p * (1 - p) / n_pos)
    high = u + F.sqrt(F.greatest(u, F.lit(1 / n_unl)) / n_unl)
    least = F.coalesce(*(F.min(F.when(F.col("a") >= share * n_pos, high / low)) for share in SUPPORT))
    found = counts.where((F.col("a") > 9) | (F.col("a") == n_pos)).agg(least).first()[0]
    return min(0.9, max(0.001, found if found is not None else min(0.45, n_pos / (n_pos + n_unl))))


def choose_features(counts: DataFrame, n_pos: int, n_unl: int, prior: float, most: int, least_z: float) -> np.ndarray:
    """Features most of whose holders must be toxic, ``prior * P(feature | toxic) / P(feature) >= 1/2``, by their deviance.

    The score is the signed root of the Poisson deviance of the confirmed holders against those that the unlabelled texts
    lead one to expect, one more being counted among these; it holds for small counts too, where a standard score does not.
    The sample has very many features, so a score below ``least_z`` is taken for chance. Ties are settled by hash. The
    counts stay in Spark; at most ``most`` features come back, those of the highest scores.
    """
    likely = counts.where(prior * F.col("a") / n_pos >= 0.5 * F.col("b") / n_unl)
    want = (F.col("b") + 1) * (n_pos / n_unl)
    z = F.sqrt(2 * (F.col("a") * F.ln(F.col("a") / want) - (F.col("a") - want)))
    rows = likely.where(F.col("a") > want).select("f", F.round(z, 9).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(most).collect()
    return np.array([r["f"] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000, max_features: int = 600, least_z: float = 4.0, bags: int = 3) -> ToxicModel:
    """Fit on confirmed toxic texts and unlabelled ones, both outside the held-out fold.

    ``max_positive`` confirmed texts and ``max_unlabelled`` documents, labelled or not, bound the sample; they are taken by
    a hash of their id, so it is the same each time, and the model is a fit of bounded size at any number of rows. No label
    but ``toxic = 1`` is read. At most ``max_features`` features are used; beyond that the weaker ones are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0) & (F.col("toxic") == 1)).select("doc_id").distinct()
    order = F.xxhash64("doc_id"), F.col("doc_id")
    pos = known.orderBy(*order).limit(max_positive).select("doc_id", F.lit(True).alias("p"))
    unl = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id").distinct().orderBy(*order).limit(max_unlabelled).select("doc_id", F.lit(False).alias("p"))
    sample = F.broadcast(pos.unionByName(unl).withColumnRenamed("doc_id", "_id"))  # at most max_positive + max_unlabelled rows

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([np.array(document_features(t.as_py()), np.int64) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "p", "f"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    sampled = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "p", "text").mapInArrow(run, "doc_id bigint, p boolean, f array<bigint>")
    sampled = materialize(sampled.distinct(), "sampled")
    sizes = {r["p"]: r["n"] for r in sampled.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        release(sampled)
        return ToxicModel()
    counts = materialize(feature_counts(sampled), "features")
    prior = class_prior(counts, sizes[True], sizes[False])
    chosen = choose_features(counts, sizes[True], sizes[False], prior, max_features, least_z)

    @frugal
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(np.isin(chosen, f.values.to_numpy())).tobytes() for f in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "p", "bits"])

    # A bit for each chosen feature: all that reaches the driver of a text, however long it is.
    rows = sampled.mapInArrow(marks, "doc_id bigint, p boolean, bits binary").toPandas().sort_values(["doc_id", "p", "bits"])

    def matrix(part: bool) -> np.ndarray:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(chosen)) for x in rows.loc[rows["p"] == part, "bits"]]
        return np.array(bits, np.float32).reshape(len(bits), len(chosen))

    release(sampled)
    release(counts)
    x_pos, x_unl = matrix(True), matrix(False)
    fits = [nnpu_fit(x_pos, x_unl[np.arange(len(x_unl)) % bags != b] if bags > 1 and len(x_unl) > 10 * bags else x_unl, prior) for b in range(bags)]
    theta = np.mean(fits, axis=0)
    return ToxicModel({int(f): float(w) for f, w in zip(chosen, theta[:-1], strict=True)}, float(theta[-1]), prior)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, text)`` -> per row ``(doc_id, held_out, score, predicted)``; the text alone decides.

    Null and empty texts have a score too, the model's for no word. A null doc_id is not held out. Repeated rows are
    scored each; extra columns are ignored; an empty table gives an empty one.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``; rows never leave their partition."""
    at = docs.columns.index(text)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
