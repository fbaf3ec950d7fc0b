"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's documents.  What a stage wrote on its way, and the documents it began with, are removed then.

Defined results: null and empty texts pass all stages, as do rows without doc_id, each judged on its own text; rows that repeat a doc_id stay or go together as near
copies, and lose lines and bytes each for itself; very long texts are read whole; further columns are dropped by the first stage; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import lines, minhash, packing, suffix, toxicity
from gistmill.lineage import noted, remove, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the lengths that the texts now have."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score under 0.5."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("toxicity < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one."""
    return _documents(lines.without_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies; rows without doc_id stay."""
    gone = minhash.near_dedup(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a 100-byte string covers which starts earlier."""
    return _documents(suffix.without_repeats(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_bytes),
    ("packing", pack),
]

#: Models, signatures and the vocabulary are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with noted() as paths:
            docs = written(stage(spark, docs, sf_dir))
        remove(spark, [*before, *paths[:-1]])  # the last one holds the stage's result
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
