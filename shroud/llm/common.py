"""Helpers shared by the operators: tables, durable intermediate results, hold-out rows, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.text import Texts, slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only for a local master with none set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        found = os.path.join(tempfile.gettempdir(), "shroud-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, by: str | None = None, rows: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors; ``by``: a folder a value;
    ``rows``: of a file at most. A ``name`` with a folder is a path of its own."""
    path = name if "/" in name else f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judged(docs: DataFrame, make: Callable[[], Callable[[Texts], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose texts the judge says true, all columns; ``make`` gives a task its judge."""

    def run(batches):
        judge = make()
        for b in batches:
            at = b.schema.get_field_index(text)
            keep = [judge(t) for t in slices(b.column(at))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (u, v): (node, root), root the smallest node of the component.

    Each round hooks every node to the smallest neighbour in a hashed order and contracts the graph,
    so long chains shrink by a constant share a round; only the tables of a round are kept. Nodes
    without edges are not listed; null ends and loops are ignored.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    maps = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        up = up.select("u", F.when(F.col("m") < order("u"), F.col("m.v")).otherwise(F.col("u")).alias("p"))
        up = written(up, "hooks")
        maps.append(up)
        moved = edges.join(up, "u").select(F.col("p").alias("a"), "v")
        moved = moved.join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        edges = written(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    found = maps[0].select(F.col("u").alias("node"), F.col("p").alias("top"))
    for up in maps[1:]:
        found = found.join(up.withColumnRenamed("u", "top"), "top", "left").select("node", F.coalesce("p", "top").alias("top"))
    found = written(found, "found")
    least = found.groupBy("top").agg(F.min("node").alias("root"))
    return found.join(least, "top").select("node", "root")
