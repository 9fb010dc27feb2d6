"""Text files as a stream: parse, chunk and append, each chunk once. An extension; the batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallystone.functions.text import chunks
from tallystone.operators.monitoring import escalates
from tallystone.sources.store import append, catalogue


def chunk_stream(documents: DataFrame) -> DataFrame:
    """(project_id, document_id, page_number, chunk_index, text) of a stream (project_id, document_id, text)."""
    return documents.select("project_id", "document_id", F.lit(None).cast("int").alias("page_number"), F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text"))


def start_ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of Parquet files of documents; each batch goes to the store without chunks that it has."""
    stream = chunk_stream(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.foreachBatch(lambda df, _: append(spark, store, catalogue(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def escalation_counts(items: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Escalated items of a stream (created_at, project_id, requires_escalation, risk_score) in windows, late ones allowed for."""
    flagged = items.withWatermark("created_at", late).where(escalates(F.col("requires_escalation"), F.col("risk_score")))
    return flagged.groupBy(F.window("created_at", window), "project_id").agg(F.count("*").alias("n"))
