"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark passages, packing.

STAGES lists the stages in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, and
all but the last return the columns of documents.  run() writes what a stage returns as Parquet into the
shared folder and rereads it for the next one.

Nulls, empty texts and tables, repeated rows and other columns are treated as each operator's docstring says;
rows without an id pass the stages that drop by id, and rows that repeat an id and its text stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import shared_dir, without
from touchline.llm.decontamination import contaminated
from touchline.llm.language_id import accepted
from touchline.llm.line_dedup import line_dedup
from touchline.llm.ngram_join import ngram_join
from touchline.llm.packing import best_fit_packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; those that would keep no word, which are copies, are left to the next stage."""
    cut = line_dedup(docs, spare_emptied=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8)."""
    groups = ngram_join(docs, n=5, num=80, den=100)
    return without(docs, groups.where("component_id < doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids and their places in sequences."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the language model, the near duplicates at scale or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
