"""Tables that change by key, as a base and a log of changes: appended, read by latest change, compacted bucket by bucket.

``base`` has whole rows, ``log`` the changed rows with a growing number, both partitioned by a hash of the key. A read takes of each key the row of
the highest number. ``compact`` rewrites the buckets that have a log, and no others; a compaction that is cut short is made again by
the next one, as applying the log twice is applying it once.

``Recent`` keeps the newest n rows of each group beside such appends, so that reading them costs no scan of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.relational import newest
from tallystone.sources.shared import exists, folder, remove

BUCKETS = 32


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _replace(df: DataFrame, path: str) -> None:
    """Writes the buckets that ``df`` has over the old ones. The rows are settled first, as they may come from those."""
    spark, at = df.sparkSession, folder(df.sparkSession, "settled")
    df.write.parquet(at)
    settled = spark.read.schema(df.schema).parquet(at)
    settled.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    remove(spark, at)


class ChangeLog:
    """A table under ``path`` with a key; all rows of a key that are given at once must be one."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    def create(self, rows: DataFrame) -> None:
        rows.select("*", F.lit(0).cast("long").alias("change"), _bucket(self.key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/base")

    def _log(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/log") if exists(self.spark, f"{self.path}/log") else None

    def append(self, changed: DataFrame) -> int:
        """Adds rows as they are after a change; the number that they get. Nothing that is stored is read but the last number."""
        log = self._log()
        last = 0 if log is None else log.agg(F.max("change")).first()[0] or 0
        last = max(last, self.spark.read.parquet(f"{self.path}/base").agg(F.max("change")).first()[0] or 0)
        rows = changed.select("*", F.lit(last + 1).cast("long").alias("change"), _bucket(self.key))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/log")
        return last + 1

    def _current(self, base: DataFrame, log: DataFrame | None) -> DataFrame:
        if log is None:
            return base
        rows = base.unionByName(log)
        others = [c for c in rows.columns if c not in (self.key, "bucket")]
        # a maximum is combined before the shuffle, so a key with very many changes is no matter
        best = rows.groupBy(self.key, "bucket").agg(F.max_by(F.struct(*others), "change").alias("r"))
        return best.select(*((F.col(c) if c in (self.key, "bucket") else F.col(f"r.`{c}`").alias(c)) for c in base.columns))

    def read(self) -> DataFrame:
        """The latest row of each key."""
        return self._current(self.spark.read.parquet(f"{self.path}/base"), self._log()).drop("change", "bucket")

    def compact(self) -> list[int]:
        """Rewrites the buckets with changes; which ones."""
        log = self._log()
        if log is None:
            return []
        touched = sorted(r[0] for r in log.select("bucket").distinct().collect())  # BUCKETS at most
        base = self.spark.read.parquet(f"{self.path}/base").where(F.col("bucket").isin(touched))
        _replace(self._current(base, log), f"{self.path}/base")
        remove(self.spark, f"{self.path}/log")
        return touched


class Recent:
    """The newest ``n`` rows of each group under ``path``, merged with every append; ``order`` sorts newest first."""

    def __init__(self, spark: SparkSession, path: str, by: str, n: int, *order: Column):
        self.spark, self.path, self.by, self.n, self.order = spark, path, by, n, order

    def append(self, rows: DataFrame) -> None:
        """Merges rows into the buckets of their groups. A row that comes again, whole, counts once, so a batch that runs again changes nothing."""
        new = rows.select("*", _bucket(self.by))
        at = folder(self.spark, "new")
        newest(new, self.by, self.n, *self.order).drop("rn").write.parquet(at)  # no group brings more than n
        new = self.spark.read.parquet(at)
        merged = new
        if exists(self.spark, self.path):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            merged = self.spark.read.schema(new.schema).parquet(self.path).where(F.col("bucket").isin(touched)).unionByName(new)
        _replace(newest(merged.distinct(), self.by, self.n, *self.order).drop("rn"), self.path)
        remove(self.spark, at)

    def follow(self, stream: DataFrame, checkpoint: str):
        """The same for a stream, batch by batch."""
        return stream.writeStream.foreachBatch(lambda df, _: self.append(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The newest rows, numbered from 1 in ``rn``."""
        return newest(self.spark.read.parquet(self.path).drop("bucket"), self.by, self.n, *self.order)
