"""Shared storage, size-checked broadcasts and connected components for the operators of this subpackage.

Intermediate tables are Parquet files in the folder that the cluster names in ``spark.checkpoint.dir``:
they cut the lineage, and a lost executor costs a re-read, not a recomputation of the whole job.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: A side is broadcast only if its rows, as measured when they were written, take no more than this in memory.
BROADCAST_BYTES = 96 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and the master is local, a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        holder = tempfile.TemporaryDirectory(prefix="tallystone-")
        atexit.register(holder.cleanup)
        _own_dirs[app] = holder.name
    return "file://" + _own_dirs[app]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bytes(field: StructField) -> Column:
    """What a column takes in a row of Spark's memory format, about."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, (StringType, BinaryType)):
            return 24 + F.coalesce(F.aggregate(column, F.lit(0), lambda acc, x: acc + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        return 24 + F.coalesce(F.size(column), F.lit(0)) * (8 + 16 * len(inner) if isinstance(inner, StructType) else 8)
    return F.lit(8 + 8 * len(kind) if isinstance(kind, StructType) else 8)


class Scratch:
    """Intermediate tables of one call, each under its own name in the shared folder, with figures measured as they are written."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallystone/{operator}-{uuid.uuid4().hex}"
        self.figures: dict[str, dict] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, *figures: Column) -> DataFrame:
        """Writes the rows once and reads them back; what follows no longer depends on how they were made.

        ``figures``: further aggregates over the rows to take on the way, by their names, to ``self.figures[name]``.
        """
        path, seen = self.path(name), Observation()
        width = functools.reduce(Column.__add__, (_bytes(f) for f in df.schema), F.lit(16))
        measured = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(width.cast("long")).alias("bytes"), *figures)
        measured.write.mode("overwrite").parquet(path)
        self.figures[name] = seen.get
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, which ``keep`` gave for ``name``, with a broadcast hint if its measured size allows it."""
        return F.broadcast(df) if (self.figures[name]["bytes"] or 0) <= BROADCAST_BYTES else df

    def clear(self, *needed: str) -> None:
        """Drops all tables but those that a result still reads."""
        self.drop(*(self.figures.keys() - set(needed)))

    def drop(self, *names: str) -> None:
        for name in names:
            p, fs = _path(self.spark, self.path(name))
            fs.delete(p, True)


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; ``lower`` does the same at less cost where all is ASCII."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def rekeyed(key: str, twin: str) -> Column:
    """The key of a thing that shares its own with another: a hash of its key and of a second hash."""
    return F.xxhash64(F.col(key), F.col(twin))


def told_apart(scratch: Scratch, rows: DataFrame, key: str, twin: str) -> DataFrame:
    """``rows`` with one 64-bit key for one thing: where two things, which differ in a second hash, have one key, both get new ones.

    Among n things about n * n / 2**65 pairs share a key, so the table of such keys stays small; it is broadcast by its
    measured size. Null keys stay null.
    """
    shared = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(twin).alias("lo"), F.max(twin).alias("hi")).where("lo <> hi")
    shared = scratch.keep(shared.select(F.col(key).alias("__shared")), "shared-keys")
    if not scratch.figures["shared-keys"]["rows"]:
        scratch.drop("shared-keys")
        return rows
    both = rows.join(scratch.small(shared, "shared-keys"), F.col(key) == F.col("__shared"), "left")
    return both.withColumn(key, F.when(F.col("__shared").isNull(), F.col(key)).otherwise(rekeyed(key, twin))).drop("__shared")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``, two columns of one orderable type: ``(node, root)``, root the least node.

    Alternates large-star and small-star steps until nothing changes. A step takes a minimum per node, which
    Spark combines before the shuffle, and a join that adaptive execution can split, so that a node with very
    many links never has its links gathered in one place. Each round is written to the shared folder.
    """
    spark = scratch.spark

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # links and their hashes, taken as they are written
    marks = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("marks")

    def digest(name: str) -> tuple:
        found = scratch.figures[name]
        return found["rows"], found["marks"]

    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, step = scratch.keep(current, f"{name}-0", marks), 0
    before = digest(f"{name}-0")
    while before[0]:
        least = both(current).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both(current).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y")).where("x <> y")
        small = small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        current = scratch.keep(small, f"{name}-{step}", marks)
        scratch.drop(f"{name}-{step - 1}")
        after = digest(f"{name}-{step}")
        if after == before:
            break
        before = after
    if not before[0]:
        return spark.createDataFrame([], current.schema).select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
