"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A numpy logistic classifier turns the shape of a text into a likelihood ratio. Sums of its probabilities per host and per
path, taken by grouped aggregation, give rates that are shrunk: a path's towards its host's, a host's towards the
corpus's. How strongly is estimated from the data by the method of moments, so that sites with few documents follow their
parent and large ones speak for themselves. A document's posterior odds are its likelihood ratio times its path's odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize
from memtide.llm.toxicity import fold
from memtide.llm.workers import frugal

N_FEATURES = 10
#: Strength of a prior over sites that differ no more than chance would have it: every site follows its parent.
ALIKE = 1e12
#: Sites that may be sent to every task together.
MAX_SENT = 500_000
UNIT = 1_000_000  # probabilities are summed as whole millionths: exact in any order
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~_=", np.uint8)


def shape(text: str) -> list[float]:
    """Shape features of a text; all zero for a text without a word."""
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    n = len(words)
    hist = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    chars = sum(map(len, words))
    again = sum(map(str.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    return [
        min(3.0, float(hist[_SYMBOLS].sum()) / n), hist[65:91].sum() / letters, min(3.0, float(hist[33] + hist[63]) / n), again / n,
        1 - triples / max(1, n - 2) if n > 2 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), math.log(len(set(words)) + 1) / math.log(n + 1.5),
        min(20.0, chars / n), max(0.0, chars / n - 6.0), math.exp(-n / 8),
    ]


@dataclass
class ShapeModel:
    """Standardised logistic model; ``base`` is the logit of the labelled sample's rate, taken out of the evidence."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    base: float

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale @ self.weights + self.bias - self.base, -30, 30)


def fit_shape(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> ShapeModel:
    """Ridge logistic regression by Newton steps."""
    mean, scale = rows.mean(0), rows.std(0) + 1e-9
    x = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    theta = np.zeros(x.shape[1])
    penalty = np.diag([ridge * len(rows)] * (len(theta) - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (good - p) - penalty @ theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    rate = min(max(good.mean(), 1e-3), 1 - 1e-3)
    return ShapeModel(mean, scale, theta[:-1], float(theta[-1]), math.log(rate / (1 - rate)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000) -> ShapeModel | None:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out fold, chosen by a hash of the id.

    None when the sample has not both kinds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "_id"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(shape(t or "")).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "quality", "f"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    rows = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id bigint, quality int, f binary").toPandas().sort_values("doc_id")
    if rows["quality"].nunique() < 2:
        return None
    return fit_shape(np.stack([np.frombuffer(x) for x in rows["f"]]), (rows["quality"] > 0).to_numpy(float))


def evidence(docs: DataFrame, model: ShapeModel | None) -> DataFrame:
    """``(doc_id, host, path, text)`` -> ``(doc_id, host, path, llr)``; without a model the evidence is 0."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([shape(t or "") for t in batch.column(3).to_pylist()]).reshape(-1, N_FEATURES)
            llr = model.evidence(rows) if model is not None else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(llr, 6))], names=["doc_id", "host", "path", "llr"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, host string, path string, llr double")


def concentration(groups: DataFrame, rate: Column) -> float:
    """Strength of a beta prior with mean ``rate`` over group rates ``s / (n * UNIT)``, by the method of moments."""
    share = F.col("s") / (F.col("n") * UNIT)
    row = groups.select("n", (F.col("n") * (share - rate) ** 2).alias("d"), (rate * (1 - rate)).alias("v")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.sum("d").alias("d"), F.sum(F.col("n") * F.col("v")).alias("v")).first()
    if not row["k"] or row["k"] < 2 or row["n"] <= row["k"]:
        return 100.0
    v = row["v"] / row["n"]
    between = (row["d"] - (row["k"] - 1) * v) / (row["n"] - row["nn"] / row["n"])
    return float(min(ALIKE, max(2.0, v / between - 1))) if between > 0 else ALIKE


def by_url(docs: DataFrame, url: str = "url") -> DataFrame:
    """``docs`` with ``host`` and ``path`` of a URL: the lower-cased host, and the first part of the path ('/' if none).

    Both are null where the URL can't be read. They take the place of columns with their names.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    part = F.regexp_extract(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), r"\A/*([^/]*)", 1)
    return docs.withColumns({"host": host, "path": F.when(host.isNotNull(), F.concat(F.lit("/"), part))})


def page_text(html: str = "html") -> Column:
    """The readable text of a page: no head, scripts, styles or tags, and the commonest entities as characters."""
    body = F.regexp_replace(F.col(html), r"(?is)<(head|script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)<(?:/?p|br|/?div|/?li|/?h[1-6]|/?tr)\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return body


def _with_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """``rows`` with the rates of their site. Too many sites are shuffled, but large ones never: those go to every task."""
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    if sites.count() <= MAX_SENT:
        return rows.join(F.broadcast(sites), same)
    least = rows.count() // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    large, small = sites.where(F.col("n") >= least), sites.where(F.col("n") < least)  # four a partition at most are large
    rest = rows.join(F.broadcast(large.select("_h", "_p")), same, "left_anti")
    return rows.join(F.broadcast(large), same).unionByName(rest.join(small, same))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = 20000) -> DataFrame:
    """Documents and ``(doc_id, quality)`` -> per row ``(doc_id, score, evidence, host_rate, path_rate, kept)``.

    ``host`` and ``path`` name columns of ``docs``; a path is one within its host. ``kept`` is score >= 0.5.
    Null hosts and paths are groups like any other; null and empty texts have no word and the evidence of that; repeated
    rows count each; other columns are ignored; an empty table gives an empty one; without labels of both kinds the
    evidence is 0 and everything is judged by an even corpus rate.
    """
    return judge(docs, train(docs, labels, max_labelled), host, path)


def judge(docs: DataFrame, model: ShapeModel | None, host: str, path: str) -> DataFrame:
    """As :func:`quality`, by a model that was fitted elsewhere, such as on documents for the texts of pages."""
    rows = materialize(evidence(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text"), model), "evidence")
    base = model.base if model is not None else 0.0
    p = F.round(UNIT / (1 + F.exp(-(F.col("llr") + base)))).cast("bigint")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = whole["s"] / (whole["n"] * UNIT) if whole["n"] else 0.5
    k_host = concentration(hosts, F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("s") / UNIT + k_host * rate) / (F.col("n") + k_host))
    within = paths.join(hosts.select(F.col("host").alias("_host"), "host_rate"), F.col("host").eqNullSafe(F.col("_host")))
    k_path = concentration(within, F.col("host_rate"))
    shrunk = (F.col("s") / UNIT + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    sites = within.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "host_rate", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), shrunk)).alias("path_rate"))
    joined = _with_sites(rows, materialize(sites, "sites"))
    logit = F.col("llr") + F.ln(F.col("path_rate") / (1 - F.col("path_rate")))
    score = F.round(1 / (1 + F.exp(-logit)), 6)
    return joined.select("doc_id", score.alias("score"), F.col("llr").alias("evidence"), "host_rate", "path_rate", (score >= 0.5).alias("kept"))
