"""STR-01: document stream -> detect, pseudonymize, redact each arriving document.

The plan lies inside each row (``plans.rowwise``): no window, join, aggregate or state, so the stream runs in append mode
with the file sink, which commits each micro-batch once and resumes from its checkpoint. Names are keyed hashes of
the value alone (types without a generator included), so a value has one name in every batch and after a restart.
Memory of a task follows its documents, not the stream.

``process_batch`` runs the batch plan on one micro-batch for callers that have a ``foreachBatch`` of their own; it writes
a folder per batch, so a replayed batch replaces its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pseudonyms, redact, stats
from ..plans import detect as D
from ..plans import rowwise
from ..session import ensure_checkpoint_dir

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def process_batch(batch: DataFrame, out_dir: str, epoch: int = 0) -> None:
    """Redacts one micro-batch into ``out_dir/batch_id=epoch``; a replayed batch overwrites its own folder."""
    docs = batch.select("doc_id", "text")
    ents = D.materialize(pseudonyms.pseudonymize(D.materialize(D.detect(docs)), unknown="hash"))
    red = redact.redact_offsets(docs, ents).select("doc_id", "redacted_text")
    s = stats.doc_stats(docs, ents)
    by = F.array_join(F.sort_array(F.transform(F.map_entries("entities_by_type"),
                                               lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    out = s.select("doc_id", "total_entities", by.alias("entities_by_type"), "avg_confidence").join(red, "doc_id")
    out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={epoch}")


OUTPUT = ["doc_id", "total_entities", "entities_by_type", "avg_confidence", "redacted_text"]


def redacted_stream(docs: DataFrame, **options) -> DataFrame:
    """A stream (or table) of documents (doc_id, text) as redacted documents with their statistics."""
    return rowwise.redacted(docs, **options).select(*OUTPUT)


def start(spark: SparkSession, source_glob: str, out_dir: str, checkpoint: str, max_files: int | None = None, **options):
    """Start the streaming redaction (processes what is available, then stops); ``max_files`` limits a
    micro-batch, by default all waiting files are one. ``options`` are those of ``rowwise.entity_arrays``."""
    reader = spark.readStream.schema(DOC_SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source_glob)
    return (redacted_stream(stream, **options).writeStream.outputMode("append").format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over ``documents`` to completion and return the per-document output."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    q = start(spark, f"{sf_dir}/documents*.parquet", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "total_entities", "entities_by_type", "avg_confidence", "redacted_text")
