"""Insert if absent by stored Bloom filters: only keys that may be there meet the store.

Beside a store under ``path``, partitioned by project, ``path``_filter holds for each append and project a filter of the new keys: ``bits`` (word, bits),
64 bits a row, only those that are not all 0, and ``sizes`` (n_bits), ``BITS`` or more for a key, so about one new key in 300 is looked up in
vain. A key is tested against the filters of its project, by joins on words; keys that fail every filter are new for sure and go in without a look at the store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources.shared import exists, folder, remove

BITS, HASHES = 12, 4


def _places(key: str) -> Column:
    """Bit places of a key in a filter of ``n_bits``; both hashes are cut so that sums stay in 64 bits."""
    first, step = F.shiftrightunsigned(F.xxhash64(key), 2), F.shiftrightunsigned(F.xxhash64(F.lit(7), key), 4)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(HASHES - 1).cast("bigint")), lambda i: F.pmod(first + i * step, F.col("n_bits")))


def _words(rows: DataFrame, key: str) -> DataFrame:
    """Rows by word and mask of each of their places."""
    placed = rows.withColumn("place", F.explode(_places(key)))
    return placed.select("*", F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("mask")).drop("place", "n_bits")


def add(spark: SparkSession, path: str, keys: DataFrame, key: str) -> None:
    """Adds a filter of ``keys(project_id, key)`` for each project."""
    gen = uuid.uuid4().hex
    n = F.greatest(F.count("*") * BITS, F.lit(64))
    sizes = keys.groupBy("project_id").agg(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long").alias("n_bits")).withColumn("gen", F.lit(gen))
    words = _words(keys.join(sizes.select("project_id", "n_bits"), "project_id"), key)
    words.groupBy("project_id", "word").agg(F.bit_or("mask").alias("bits")).withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("project_id").parquet(f"{path}_filter/bits")
    sizes.write.mode("append").parquet(f"{path}_filter/sizes")  # last: without its size a filter isn't read


def possible(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """(project_id, key) of the rows whose key a filter has, or seems to have."""
    sizes = spark.read.parquet(f"{path}_filter/sizes")
    asked = _words(rows.select("project_id", key).join(sizes, "project_id"), key)
    bits = spark.read.parquet(f"{path}_filter/bits")
    hits = asked.join(bits, ["project_id", "gen", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    # two places of a key may be one
    full = hits.groupBy("project_id", "gen", key).agg(F.count("*").alias("n")).where(F.col("n") == HASHES)
    return full.select("project_id", key).distinct()


def append(spark: SparkSession, path: str, rows: DataFrame, key: str = "chunk_id") -> tuple[int, int]:
    """Appends rows whose key the store doesn't have, one for each key; how many keys the store was asked for, and how many rows went in.

    Rows without a project or key are left out. A store that has no filters yet gets them first, from its keys.
    """
    at = folder(spark, "fresh")
    rows.where(F.col(key).isNotNull() & F.col("project_id").isNotNull()).dropDuplicates(["project_id", key]).write.parquet(f"{at}/all")
    fresh, asked = spark.read.parquet(f"{at}/all"), 0
    if exists(spark, path):
        if not exists(spark, f"{path}_filter/sizes"):
            add(spark, path, spark.read.parquet(path).select("project_id", key), key)
        possible(spark, path, fresh, key).write.parquet(f"{at}/possible")
        maybe = spark.read.parquet(f"{at}/possible")
        asked = maybe.count()
        if asked:
            there = spark.read.parquet(path).select("project_id", key).join(maybe, ["project_id", key], "left_semi")
            there.write.parquet(f"{at}/there")
            fresh = fresh.join(spark.read.parquet(f"{at}/there"), ["project_id", key], "left_anti")
    fresh.write.parquet(f"{at}/new")
    fresh = spark.read.parquet(f"{at}/new")
    n = fresh.count()
    if n:
        # the filter goes first: if the job ends between, keys are looked up in vain, never taken for new
        add(spark, path, fresh.select("project_id", key), key)
        fresh.write.mode("append").partitionBy("project_id").parquet(path)
    remove(spark, at)
    return asked, n
