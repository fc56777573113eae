"""Embedding connectors: an engine turns texts into vectors inside Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memtide.functions import text as T


class Engine(Protocol):
    """What a connector needs: vectors of a list of texts, ``[n, dim]``."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEngine:
    """Deterministic unit vectors seeded by the text; stands in for a model where there is none."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).standard_normal(self.dim) for t in texts]
        out = np.array(rows).reshape(len(texts), self.dim)
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


class TooLong(ValueError):
    """The server refuses a text, or a batch, for its size."""


class HttpEngine:
    """A server that answers ``{"input": [...]}`` with vectors, one request a batch.

    If it refuses a batch for its size the texts go one by one, and one too long is halved and the means are taken.
    ``api_key``, or the environment variable named ``key_variable``, goes along as a bearer token.
    """

    def __init__(self, url: str, model: str, parse: Callable[[dict], list[list[float]]], timeout: float = 60.0, api_key: str | None = None, key_variable: str | None = None, batch: int = 128) -> None:
        self.url, self.model, self.parse, self.timeout, self.batch = url, model, parse, timeout, batch
        self.api_key, self.key_variable = api_key, key_variable

    def _post(self, texts: Sequence[str]) -> np.ndarray:
        import json
        import os
        import urllib.error
        import urllib.request

        key = self.api_key or os.environ.get(self.key_variable or "", "")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": list(texts)}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return np.array(self.parse(json.load(answer)), float)
        except urllib.error.HTTPError as error:
            said = error.read(2000).decode(errors="replace")
            if error.code == 413 or re.search("too (?:large|long)|maximum context|context (?:length|size)|exceed", said, re.IGNORECASE):
                raise TooLong(f"{error.code}: {said}") from error
            raise

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        parts = []
        for at in range(0, len(texts), self.batch):
            some = list(texts[at : at + self.batch])
            try:
                parts.append(self._post(some))
            except TooLong:
                parts.append(np.stack([halving(lambda t: self._post([t])[0], t) for t in some]))
        return np.concatenate(parts) if parts else np.zeros((0, 0))


def halving(encode_one: Callable[[str], np.ndarray], text: str, least: int = 64) -> np.ndarray:
    """Encode a text; on a too-large error, the mean of its halves."""
    try:
        return encode_one(text)
    except ValueError:
        if len(text) <= least:
            raise
        half = len(text) // 2
        return (halving(encode_one, text[:half], least) + halving(encode_one, text[half:], least)) / 2


def _data(answer: dict) -> list[list[float]]:
    return [row["embedding"] for row in answer["data"]]


def _sentence_transformer(model: str = "all-MiniLM-L6-v2", **_: object) -> Engine:
    from sentence_transformers import SentenceTransformer  # optional

    return SentenceTransformer(model)


BACKENDS: dict[str, Callable[..., Engine]] = {
    "hash": lambda dim=64, **_: HashEngine(dim),
    "llama-server": lambda url, model="default", **o: HttpEngine(url, model, _data, **o),
    "deepseek": lambda url, model="default", **o: HttpEngine(url, model, _data, **{"key_variable": "DEEPSEEK_API_KEY"} | o),
    "ollama": lambda url, model="default", **o: HttpEngine(url, model, lambda r: r["embeddings"], **o),
    "sentence-transformers": _sentence_transformer,
}


def create_engine(backend: str, **options: object) -> Engine:
    if backend not in BACKENDS:
        raise ValueError(f"unknown embedding backend {backend!r}; one of {sorted(BACKENDS)}")
    return BACKENDS[backend](**options)


def dimension(make: Callable[[], Engine]) -> int:
    """How long an engine's vectors are: as it says, or else as those of a word are."""
    engine = make()
    return int(getattr(engine, "dim", 0)) or len(np.asarray(engine.encode(["dimension"]))[0])


def embed(text: Column, make: Callable[[], Engine]) -> Column:
    """Vectors of a text column; the engine is made once a task."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = make()
        for batch in batches:
            yield pd.Series(list(np.asarray(engine.encode(batch.fillna("").tolist()), float)))

    return run(text)


def embed_chunked(docs: DataFrame, make: Callable[[], Engine], size: int = 4096) -> DataFrame:
    """``(id, text)`` -> ``(id, embedding)``: the mean of the vectors of the text's chunks."""
    parts = docs.select("id", F.explode(T.chunks(F.col("text"), size)).alias("chunk")).select("id", embed(F.col("chunk"), make).alias("v"))
    return mean_pool(parts)


def mean_pool(parts: DataFrame) -> DataFrame:
    """``(id, v)`` rows -> the mean vector of each id."""
    means = parts.select("id", F.posexplode("v").alias("d", "x")).groupBy("id", "d").agg(F.avg("x").alias("m"))
    return means.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("r")).select("id", F.col("r.m").alias("embedding"))
