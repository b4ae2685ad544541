"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import jaccard_join, language_id, line_dedup, packing, pii
from tillroll.llm.common import materialise, table, vocabulary

#: A calibrated probability under this is no language (four languages: chance is 0.25).
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no learned language fits."""
    guess = language_id.predictor(language_id.learn(docs))
    rows = docs.withColumn("__guess", guess(F.col("text")))
    known = (F.col("__guess.lang_pred") != language_id.UNKNOWN) & (F.col("__guess.score") >= LEAST_LANGUAGE_SCORE)
    return rows.where(known).drop("__guess")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines from the texts; every document stays."""
    cleaned = line_dedup.remove_repeated_passages(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five words, 0.8).

    A document without any word is in no group and stays.
    """
    classes = jaccard_join.jaccard_classes(docs, jaccard_join.Params(), "pipeline")
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__d")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__d"), "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs, label="pipeline-pii").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 2048 ids."""
    return packing.pack(docs, packing.Params(vocabulary("word_bpe_49k.json")))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("private", private), ("packed", packed)]

#: Trained weights and a tokenizer are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
