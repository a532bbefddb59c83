"""The registered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import fill_in_middle, hard_negatives, line_dedup, ngram_join, warc
from touchline.llm.decontamination import contaminated
from touchline.llm.language_id import language_id
from touchline.llm.packing import best_fit_packing
from touchline.llm.passages import repeated_passages
from touchline.llm.quality_model import quality_scores
from touchline.llm.quality_rules import quality_rules
from touchline.llm.secrets import secret_digest
from touchline.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans")
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", spans, "other_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=F.col("vec_id") % 7 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_quality_model, op4_warc_round_trip, op5_ngram_join, op6_repeated_passages, op7_secret_scan, op8_best_fit_packing, op9_line_dedup, op10_decontamination, op11_hard_negatives, op12_fill_in_middle, op13_url_filter)}
ORACLES: dict[str, str] = {"op4_warc_round_trip": warc.ORACLE, "op5_ngram_join": ngram_join.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE}
