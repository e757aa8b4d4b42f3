"""From raw documents to token ids: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.llm import decontaminate, jaccard, linedup, nbest, toxicity
from fieldscan.llm.common import saved


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier one has; their sizes follow."""
    found = linedup.dedup_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def texts_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's best segmentation, whether they decode to its text, and the n best ones."""
    found = nbest.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select("row.doc_id", "n_pieces", F.element_at("scores", 1).alias("best_score"), "decodes", "ids", "n_best")


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("ngram_jaccard", texts_once),
    ("decontamination", not_in_benchmark),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Stages 1, 3 and 5 (a trained model, components, a piece lattice) are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {}
