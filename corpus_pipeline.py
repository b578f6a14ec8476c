"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Every stage gets what its predecessor kept, decides on each of its documents and
returns the kept ones with the columns of documents; the last one returns the
placed pieces. Between stages the rows are written to the shared folder.

Null texts have no language and go in the first stage; a null id never makes a
row equal to another; repeated rows are exact copies; of rows that share an id
but not their text, all go when one of them is a near copy; an empty table passes
through; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm import exact_dedup, index_match, language_id, ngram_join, packing
from gridseries.llm.batches import ship_code
from gridseries.session import materialise

NEAR_WORDS = 5
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; those predicted `und` go."""
    ship_code(spark)
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_predicted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by similar word shingles."""
    ship_code(spark)
    groups = ngram_join.linked_groups(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    extra = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_extra"))
    extra = materialise(extra, "extra")  # of known size when the join is planned
    return docs.join(extra, docs["doc_id"] == extra["_extra"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = materialise(index_match.hit_rows(docs, items), "hit")
    own = index_match.own_key(docs["doc_id"], index_match.row_key(docs["text"]))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["id"]) & own.eqNullSafe(hit["own"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("benchmark_index", decontaminated),
    ("best_fit_packing", packed),
]

# SQL has neither the learned profiles nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
