"""A corpus from raw documents to packed sequences: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memtide.llm import decontam, linededup, nearcopies, packing, toxicity
from memtide.llm.queries import tokenizer_files
from memtide.llm.scratch import release, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more by a model of the labelled documents go.

    Each row is judged by its own text; a null or empty one has the score of no word and stays.
    """
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that three documents or more share stay in one of them; the others' text is shortened.

    A null text becomes an empty one. Rows without doc_id lose nothing; rows that share one each lose their own lines.
    """
    short = linededup.without_repeats(docs, min_chars=20, min_docs=3)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return short.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more) the row with the smallest doc_id stays.

    Of rows that repeat one stays; rows that share an id and differ in text are judged apart; a null id comes last. Texts
    without a word, null ones too, are copies of each other.
    """
    return nearcopies.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold half of a benchmark item or more go, each judged by its own text; null and empty texts stay."""
    return decontam.reject(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_match=5, min_coverage=0.5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048; every row is packed, one without text as its end alone."""
    return packing.pack(packing.token_pieces(docs, **tokenizer_files(), capacity=2048), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learning and tokenizing can't be written in SQL; tests hold the stages against brute force, the model against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    When a stage is written, what it read and the tables that it made on the way are deleted; the last result stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        release(before)
    return docs
