"""Uploaded documents as a stream: raw bytes landed by project, each document's states kept, its pages given once.

``land`` stores uploads under a fresh id. ``document_states`` follows what has landed: a document is UPLOADED, then PARSING, then COMPLETED, or FAILED with its
error. The state of each storage key is kept between batches and restarts, so bytes that come again are not parsed again once they are COMPLETED; a
FAILED document that is landed again under its key is tried again. Checkpoints from before the keys were kept by shards can't be gone on with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallystone.functions.text import extension
from tallystone.schema import ACCEPTED_EXTENSIONS
from tallystone.sources.files import Parser, parse_docx, parse_txt

LANDED = "document_id bigint, document_name string, document_type string, storage_key string, uploaded_by bigint, content binary, project_id bigint"
STATES = "project_id bigint, document_id bigint, storage_key string, step int, processing_status string, error_message string, page_number int, text string"
#: Shards of the keys, fixed with the first checkpoint; rows and characters after which a shard gives out a frame.
SHARDS, FRAME_ROWS, FRAME_CHARS = 512, 2000, 4_000_000


def accept(uploads: DataFrame, uploader: DataFrame | None = None) -> DataFrame:
    """Uploads with ``error_message``: no type, a file type that isn't taken, or, if ``uploader(actor)`` is given and has no row, no right to upload."""
    ext = extension(F.col("document_name"))
    rows = uploads
    able: Column = F.lit(True)
    if uploader is not None:
        rows = rows.join(F.broadcast(uploader.select(F.col("actor").alias("_actor"))), F.lit(True), "left")  # one row at most
        able = F.col("_actor").isNotNull()
    blank = F.coalesce(F.col("document_type"), F.lit("")) == ""
    error = F.when(~able, "not allowed").when(blank, "Document type is required").when(~F.coalesce(ext.isin(ACCEPTED_EXTENSIONS), F.lit(False)), "Unsupported file format")
    return rows.withColumn("error_message", error).select(*uploads.columns, "error_message")


def land(uploads: DataFrame, path: str, storage_key: Column | None = None) -> None:
    """Appends ``uploads(project_id, document_id, document_name, document_type, uploaded_by, content)`` to the landing table, by project.

    Each gets a storage key: its project, a fresh id and the name's extension. Rows are written once, so the id is drawn once.
    """
    fresh = F.concat(F.col("project_id").cast("string"), F.lit("/"), F.uuid(), extension(F.col("document_name")))
    rows = uploads.withColumn("storage_key", fresh if storage_key is None else storage_key)
    rows.select("document_id", "document_name", "document_type", "storage_key", "uploaded_by", "content", "project_id").write.mode("append").partitionBy("project_id").parquet(path)


class DocumentMachine(StatefulProcessor):
    """States of the storage keys of one shard: each one's last status, and how many steps it has taken.

    Each shard takes many keys, as a call and a frame for every key cost more than its parsing.
    """

    def __init__(self, parsers: dict[str, Parser]):
        self.parsers = parsers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getMapState("status", "storage_key string", "status string, step int")

    def _steps(self, row: dict) -> list[tuple]:
        key = row["storage_key"]
        held = self.status.getValue((key,))
        if held is not None and held[0] == "COMPLETED":
            return []
        step = held[1] if held is not None else 0
        base = (int(row["project_id"]), int(row["document_id"]), key)
        out = [(*base, step + 1, "UPLOADED", None, None, None), (*base, step + 2, "PARSING", None, None, None)]
        step += 3
        try:
            name = str(row["document_name"])
            ext = "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""
            if ext not in self.parsers:
                raise ValueError("Unsupported file format")
            pages = self.parsers[ext](bytes(row["content"]))
            out += [(*base, step, "COMPLETED", None, n, t) for n, t in pages] or [(*base, step, "COMPLETED", None, None, None)]
            self.status.updateValue((key,), ("COMPLETED", step))
        except Exception as e:
            out.append((*base, step, "FAILED", str(e) or type(e).__name__, None, None))
            self.status.updateValue((key,), ("FAILED", step))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, size = [], 0
        for pdf in rows:
            for row in zip(*(pdf[c] for c in pdf.columns), strict=True):
                own = self._steps(dict(zip(pdf.columns, row, strict=True)))
                out += own
                size += sum(len(x[-1]) for x in own if x[-1])
                if len(out) >= FRAME_ROWS or size >= FRAME_CHARS:
                    yield self._frame(out)
                    out, size = [], 0
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])
        return frame.astype({"page_number": "Int32", "step": "int32"})

    def close(self) -> None:
        pass


def document_states(landed: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """The steps of each landed document of a stream: (project_id, document_id, storage_key, step, processing_status, error_message, page_number, text).

    A COMPLETED document has a row for each page, with its text. Parsers by extension; text and docx are built in.
    """
    machine = DocumentMachine({".txt": parse_txt, ".docx": parse_docx, **(parsers or {})})
    shard = F.pmod(F.xxhash64("storage_key"), F.lit(SHARDS)).cast("int").alias("shard")
    rows = landed.select("project_id", "document_id", "document_name", "storage_key", "content", shard)
    return rows.groupBy("shard").transformWithStateInPandas(machine, STATES, "Append", "None")


def start_documents(spark: SparkSession, landed: str, states: str, checkpoint: str, parsers: dict[str, Parser] | None = None) -> StreamingQuery:
    """Follows the landing table and appends every document's steps to ``states``, by project. Needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = document_states(spark.readStream.schema(LANDED).parquet(landed), parsers)
    return stream.writeStream.partitionBy("project_id").option("path", states).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_states(states: DataFrame) -> DataFrame:
    """(project_id, document_id, storage_key, processing_status, error_message, n_pages) of each document, by its last step."""
    last = states.groupBy("storage_key").agg(F.max(F.struct("step", "project_id", "document_id", "processing_status", "error_message")).alias("s"), F.count("text").alias("n_pages"))
    return last.select("s.project_id", "s.document_id", "storage_key", "s.processing_status", "s.error_message", "n_pages")
