"""The queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import ann, bpe, decontaminate, language, lines, negatives, phrases, reputation, sharding, simhash, spelling, suffixes, toxicity
from vitrine.llm.oracle import oracle_sql  # noqa: F401 - next to the queries

TOKENIZER = "byte_bpe_50k.tiktoken"
#: The rules that the filter of the pages is asked to hold (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_rows(table(spark, sf_dir, "documents"), shards=40)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the same number, 0 being bad."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = pages.select("page_id", reputation.host_of(F.col("url")).alias("host")).join(
        labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad")), "page_id"
    )
    return reputation.judge(pages, outcomes.select("host", "bad"), RULES)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_length=True)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Trained on rows whose crc32(doc_id as text) mod 4 isn't 2."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return toxicity.train(docs.where(rest != 2), labels.where(rest != 2).select("doc_id", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.kept_words(table(spark, sf_dir, "documents"), window=13)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.word_counts(table(spark, sf_dir, "documents"), least=5, times=3, slip=97))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated(table(spark, sf_dir, "documents"), points=20, least=3)
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90, of=100, scale=256)


def queries() -> dict:
    found = (
        op1_multi_index_search, op2_byte_bpe, op3_simhash, op4_label_propagation, op5_suffix_array, op6_host_reputation,
        op7_language_model, op8_decontamination, op9_toxicity, op10_phrase_automata,
        op11_spelling_variants, op12_line_dedup, op13_hard_negatives,
    )
    return {f.__name__: f for f in found}
