"""The training-data pipeline over ``documents``: each stage reads what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. ``run`` writes every stage as Parquet in the
shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import decontam, langid, minhash, packing, queries, toxicity
from shroud.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no language model fits, go."""
    return langid.clean(docs, langid.trained(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the smallest id.

    Of several rows with the id that stays, the one with the smallest other columns stays. Rows with a null
    id are not told apart: all of them stay if their null id is kept.
    """
    kept = written(minhash.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct(), "kept")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = named.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*")  # partial: a hot id is no large group
    unnamed = docs.where("doc_id is null").join(F.broadcast(kept.where("doc_id is null")), F.lit(True), "left_semi")
    return one.select(*docs.columns).unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of 2048-token sequences, with their token ids."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Models and MinHash can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
