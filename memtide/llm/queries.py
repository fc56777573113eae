"""The thin queries over the operators of this subpackage, with the parameters meant for production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memtide.llm import chatformat, decontam, innertop, linededup, packing, quality_bayes, quality_rules, secrets, simhash, suffixdedup, toxicity, vectorcodes, whitening
from memtide.llm.scratch import settles
from memtide.sources.scan import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations", "embeddings") else df


@settles
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return chatformat.digests(chatformat.windows(turns.unionByName(tricky), budget=2048, history_budget=256, max_history=2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


@settles
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host="source", path="lang")


@settles
def op_pages_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and first part of the path of their URL; the evidence is that of the documents' model."""
    model = quality_bayes.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    pages = spread(_table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "url", quality_bayes.page_text().alias("text"))
    return quality_bayes.judge(quality_bayes.by_url(pages), model, "host", "path").withColumnRenamed("doc_id", "page_id")


@settles
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


@settles
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@settles
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"), length=50)


@settles
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, min_cost=10.0, min_chars=8, counts=secrets.word_counts(docs), json_path=tokenizer_files()["json_path"], min_per_char=0.9))


@settles
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_match=5, min_coverage=0.5)


def tokenizer_files() -> dict[str, str]:
    """The public vocabulary and its second form; every machine of the cluster has them installed."""
    import public_tokenizers as files

    return {"json_path": files.path("byte_bpe_50k.json"), "ranks_path": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


@settles
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), **tokenizer_files(), capacity=2048)
    return packing.pack(pieces, capacity=2048)


@settles
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digests(vectorcodes.compress(_table(spark, sf_dir, "embeddings"), parts=4, codes=256, rounds=4, scale=1024))


@settles
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4, scale=256)


@settles
def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return innertop.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_dedup, op2_chat_format, op3_toxicity, op4_quality_classifier, op_pages_quality, op5_quality_rules, op6_line_dedup, op7_suffix_dedup, op8_secret_scan, op9_decontamination, op10_best_fit_packing, op11_vector_codes, op12_whitening, op13_top_products)}

ORACLES: dict[str, str] = {"op5_quality_rules": quality_rules.ORACLE, "op6_line_dedup": linededup.ORACLE, "op11_vector_codes": vectorcodes.ORACLE, "op13_top_products": innertop.ORACLE}
