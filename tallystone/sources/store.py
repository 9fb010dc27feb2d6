"""Chunk store and tables: Parquet by project, appended to without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallystone.functions.text import chunk_id
from tallystone.operators.retrieval import term_statistics
from tallystone.sources.shared import exists, folder, remove


def page_or_none(page: Column) -> Column:
    """Stores take no nulls: no page, or page 0, is -1."""
    return F.when(page.isNull() | (page == 0), -1).otherwise(page)


def catalogue(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_id`` and stored page numbers to (project_id, document_id, page_number, chunk_index, text)."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("project_id"), F.col("document_id"), F.col("chunk_index"))).withColumn("page_number", page_or_none(F.col("page_number")))


def read_store(spark: SparkSession, path: str, project_id: int | None = None) -> DataFrame:
    """The store, or one project of it; only that project's files are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("project_id") == project_id) if project_id is not None else df


def absent_rows(spark: SparkSession, path: str, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key the store doesn't have, one for each key. Of the store only the rows' projects are read."""
    fresh = rows.dropDuplicates([key])
    if exists(spark, path):
        # a key names its project, so the join prunes the store's partitions by the projects of the rows
        fresh = fresh.join(spark.read.parquet(path).select("project_id", key), ["project_id", key], "left_anti")
    return fresh


def append(spark: SparkSession, path: str, rows: DataFrame, key: str = "chunk_id") -> None:
    """Appends rows whose key the store doesn't have; the first write of a key stays."""
    absent_rows(spark, path, rows, key).write.mode("append").partitionBy("project_id").parquet(path)


def index(spark: SparkSession, path: str, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> None:
    """Writes chunks (project_id, chunk_id, text, ...) to both indexes in ``path``, without those that they have.

    ``chunks`` holds text for sparse search and, by ``encode``, vectors for dense search; ``terms`` has statistics for scores. New
    chunks are settled once, in the shared folder; their statistics are added beside the older ones, whose texts aren't read.
    """
    fresh, at = absent_rows(spark, f"{path}/chunks", chunks), folder(spark, "fresh")
    encode(fresh).write.parquet(at)
    fresh = spark.read.parquet(at)
    fresh.write.mode("append").partitionBy("project_id").parquet(f"{path}/chunks")
    term_statistics(fresh, "project_id").write.mode("append").partitionBy("project_id").parquet(f"{path}/terms")
    remove(spark, at)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The chunks with their vectors, and the statistics, added up over all appends, for ``retrieval.retrieve``."""
    terms = spark.read.parquet(f"{path}/terms").groupBy("project_id", "t").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    return spark.read.parquet(f"{path}/chunks"), terms


def with_ids(rows: DataFrame, existing: DataFrame, order: list[str], id_: str = "id") -> DataFrame:
    """Rows with dense ids that go on after the existing ones, in the given order.

    Rows are sorted into ranges and written once, each with its range and its place there; the sizes of the ranges are counted from
    what was written, so ids neither repeat nor leave gaps, whatever ran twice. No task sees all rows, and rows that agree in the order are
    spread by a hash of what can be hashed.
    """
    spark, at = rows.sparkSession, folder(rows.sparkSession, "ids")
    plain = [f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, (MapType, VariantType))]
    ties = [*(F.col(c) for c in order), F.xxhash64(*plain)]
    # an id that grows in a partition and tells its partition: range << 33 | place
    rows.repartitionByRange(*ties).sortWithinPartitions(*ties).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    held = spark.read.parquet(at).withColumn("_range", F.shiftright("_at", 33))
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("_range", before.alias("_before"))  # a row for each range
    start = existing.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(before), "_range").withColumn(id_, (F.lit(start) + F.col("_before") + place).cast("long")).select(id_, *rows.columns)


def truncate(spark: SparkSession, tables: dict[str, str], keep: tuple[str, ...] = ("users",)) -> int:
    """Empties the Parquet tables, by name and path, but those to keep, whatever their case; how many it emptied."""
    done = 0
    for name, path in tables.items():
        if name.lower() not in {k.lower() for k in keep}:
            spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
            done += 1
    return done
