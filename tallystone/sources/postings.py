"""Stored inverted postings with block maxima, and BM25 statistics that appends add to.

An index is a folder of Parquet tables, all appended to and never rewritten:

- ``postings`` (project_id, t, block, n, peaks, entries): the n units that hold a term, by blocks of about ``UNITS`` units, the same for
  all terms. ``peaks`` are the (tf, dl) pairs of which one gives the block's highest score, whatever the mean length is;
- ``terms`` (project_id, t, df), ``sizes`` (project_id, n, words) and ``shape`` (project_id, df, terms: how many terms have that df):
  differences of one append each. Sums of them are the statistics of all units, and ``shape`` gives the mean idf without the vocabulary;
- ``units`` (project_id, unit): what is in;
- ``commits`` (gen): finished appends. What an append that was cut short has left is not read.

``postings`` and ``terms`` are partitioned by a hash of the term, so a search opens its terms' buckets only. It first takes the blocks'
highest scores, scores the best blocks of each query, and then only blocks that could still beat the k-th score found: the result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.functions.text import not_blank, tokens
from tallystone.operators.retrieval import EPSILON, K1, B
from tallystone.sources.shared import exists, folder, remove

BUCKETS, UNITS = 64, 128
#: Words of an append for each task that writes its postings.
TASK_WORDS = 1_000_000
#: Blocks of each query that are scored first, to learn what a block must reach.
FIRST_BLOCKS = 4
#: Words or weights of a batch of queries up to which they go to the postings, and not the postings to them.
FEW = 1000


def _bucket(t: str) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int").alias("bucket")


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table's rows of finished appends; None before the first one."""
    if not exists(spark, f"{path}/commits"):
        return None
    done = [r[0] for r in spark.read.parquet(f"{path}/commits").collect()]  # a row for each append
    return spark.read.parquet(f"{path}/{name}").where(F.col("gen").isin(done))


def _peaks(entries: Column) -> Column:
    """(tf, dl) pairs that no other pair beats in both: more occurrences in no more words."""
    pairs = F.sort_array(F.transform(entries, lambda e: F.struct((-e["tf"]).alias("less"), e["dl"].alias("dl"))))
    none = F.array().cast("array<struct<tf:bigint,dl:int>>")

    def best(found: Column, pair: Column) -> Column:
        own = F.array(F.struct((-pair["less"]).alias("tf"), pair["dl"].alias("dl")))
        return F.when((F.size(found) == 0) | (pair["dl"] < F.try_element_at(found, F.lit(-1))["dl"]), F.concat(found, own)).otherwise(found)

    return F.when(F.size(entries) == 1, F.transform(entries, lambda e: F.struct(e["tf"].alias("tf"), e["dl"].alias("dl")))).otherwise(F.aggregate(pairs, none, best))


def _counted(ts: Column) -> Column:
    """(t, tf) of each word, from its sorted words: counts of a text are made inside its row."""
    starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (ts[i] != ts[i - 1]))
    return F.transform(F.arrays_zip(starts.alias("i"), F.concat(F.slice(starts, 2, F.size(ts)), F.array(F.size(ts))).alias("j")), lambda x: F.struct(ts[x["i"]].alias("t"), (x["j"] - x["i"]).cast("long").alias("tf")))


def _dealt(rows: DataFrame, tasks: int, *key: str) -> DataFrame:
    """Rows over ``tasks`` tasks of even size, by bucket: a task has few buckets, so that it writes few files. A bucket that several tasks share is dealt by ``key``, whose rows stay together."""
    shares = -(-tasks // BUCKETS)
    share = F.pmod(F.xxhash64(F.lit("share"), *key), F.lit(shares)).cast("int")
    rows = rows.withColumn("task", F.floor((F.col("bucket") * shares + share) * tasks / (BUCKETS * shares)).cast("int"))
    return rows.repartitionById(tasks, "task")


def append(spark: SparkSession, path: str, units: DataFrame) -> None:
    """Adds ``units(project_id, unit, kind, text)`` that the index doesn't have; only new texts are read, and of ``terms`` the buckets.

    Of units given twice one counts. A null or blank text has no postings and counts nowhere, nor does a unit without project.
    """
    gen = uuid.uuid4().hex
    fresh = units.select("project_id", "unit", "kind", "text").where(not_blank(F.col("text")) & F.col("project_id").isNotNull())
    held = _committed(spark, path, "units")
    if held is not None:
        fresh = fresh.join(held.select("project_id", "unit"), ["project_id", "unit"], "left_anti")
    fresh = fresh.dropDuplicates(["project_id", "unit"]).withColumn("ts", F.sort_array(tokens(F.col("text"))))
    at = folder(spark, "fresh")
    fresh.select("project_id", "unit", "kind", F.size("ts").alias("dl"), _counted(F.col("ts")).alias("counts")).write.parquet(f"{at}/units")
    fresh = spark.read.parquet(f"{at}/units")

    fresh.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).write.parquet(f"{at}/sizes")
    sizes = spark.read.parquet(f"{at}/sizes")
    words = sizes.agg(F.sum("words")).first()[0]
    if not words:
        remove(spark, at)
        return
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_WORDS))
    large = sizes.where(F.col("n") > UNITS).select("project_id", F.ceil(F.col("n") / UNITS).alias("n_blocks"))
    # a project may have most texts: they aren't dealt by it, but meet the few projects of more than a block where they are
    blocked = fresh.join(F.broadcast(large), "project_id", "left").withColumn("b", F.pmod(F.xxhash64("unit"), F.coalesce("n_blocks", F.lit(1))))
    counted = blocked.select("project_id", "unit", "kind", "dl", "b", F.inline("counts"))
    dealt = _dealt(counted.withColumn("bucket", _bucket("t")), tasks, "project_id", "t", "b")
    rows = dealt.groupBy("task", "bucket", "project_id", "t", "b").agg(F.collect_list(F.struct("unit", "kind", "tf", "dl")).alias("entries"))
    rows = rows.select("project_id", "t", F.concat(F.lit(f"{gen}-"), F.col("b").cast("string")).alias("block"), F.size("entries").alias("n"), _peaks(F.col("entries")).alias("peaks"), "entries", F.lit(gen).alias("gen"), "bucket")
    rows.sortWithinPartitions("bucket", "project_id", "t", "block").write.mode("append").partitionBy("gen", "bucket").parquet(f"{path}/postings")

    own = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings/gen={gen}")
    key = ["bucket", "project_id", "t"]
    old = _committed(spark, path, "terms")
    was = 0 if old is None else _committed(spark, path, "sizes").agg(F.sum("words")).first()[0] or 0
    parts = max(tasks, -(-(was + words) // TASK_WORDS))  # tasks that don't grow with the index
    new = own.repartition(parts, *key).groupBy(*key).agg(F.sum("n").alias("df"))
    if old is not None:
        new = new.join(old.repartition(parts, *key).groupBy(*key).agg(F.sum("df").alias("was")), key, "left")
    else:
        new = new.withColumn("was", F.lit(None).cast("long"))
    new.write.parquet(f"{at}/terms")
    new = spark.read.parquet(f"{at}/terms")
    moves = F.array(F.struct((F.col("df") + F.coalesce("was", F.lit(0))).alias("df"), F.lit(1).alias("terms")), F.struct(F.col("was").alias("df"), F.lit(-1).alias("terms")))
    shape = new.select("project_id", F.inline(moves)).where("df is not null").groupBy("project_id", "df").agg(F.sum("terms").alias("terms"))
    shape.where("terms <> 0").withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen").parquet(f"{path}/shape")
    terms = _dealt(new, tasks, "project_id", "t").select("project_id", "t", "df", F.lit(gen).alias("gen"), "bucket")
    terms.sortWithinPartitions("bucket", "project_id", "t").write.mode("append").partitionBy("gen", "bucket").parquet(f"{path}/terms")
    sizes.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen").parquet(f"{path}/sizes")
    fresh.select("project_id", "unit", F.lit(gen).alias("gen")).write.mode("append").partitionBy("gen").parquet(f"{path}/units")
    spark.createDataFrame([(gen,)], "gen string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    remove(spark, at)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, n, words, n_terms, avgdl, eps): all that scores need of a project but its terms' df. A row for each project and df is read."""
    sizes = _committed(spark, path, "sizes").groupBy("project_id").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    shape = _committed(spark, path, "shape").groupBy("project_id", "df").agg(F.sum("terms").alias("terms")).where("terms > 0").join(sizes, "project_id")
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = shape.groupBy("project_id").agg(F.sum("terms").alias("n_terms"), (F.lit(EPSILON) * F.sum(F.col("terms") * idf) / F.sum("terms")).alias("eps"))
    return sizes.join(mean, "project_id").withColumn("avgdl", F.col("words") / F.col("n"))


def _part(weight: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return weight * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))


class Search:
    """Best units for a batch of ``queries(query_id, project_id, text)``, each within its project, by an index of ``append``.

    ``hits`` are (query_id, project_id, unit, kind, score, rank), the k best by score to nine places, then unit. ``bounds`` has each query's blocks with
    the highest score that a unit of theirs can have, ``read`` those whose postings were scored.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int = 10, kinds: Sequence[str] | None = None):
        self.spark, self.k, self.kinds, self.at = spark, k, kinds, folder(spark, "search")
        asked = queries.select("query_id", "project_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("query_id", "project_id", "t").agg(F.count("*").alias("asks"))
        asked = self._settle(asked.withColumn("bucket", _bucket("t")), "asked")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        own = F.col("bucket").isin(buckets)
        if len(words := [r[0] for r in asked.select("t").distinct().limit(FEW + 1).collect()]) <= FEW:  # of these buckets, only the words' own rows go on
            own = own & F.col("t").isin(words)
        postings, terms = (None if (x := _committed(spark, path, n)) is None else x.where(own) for n in ("postings", "terms"))
        if postings is None:
            raise ValueError(f"no index in {path}")
        self.postings = postings
        stats = statistics(spark, path).select("project_id", "n", "avgdl", "eps")
        df = terms.join(asked.select("project_id", "t").distinct(), ["project_id", "t"], "left_semi").groupBy("project_id", "t").agg(F.sum("df").alias("df"))
        weighted = asked.join(df, ["project_id", "t"]).join(stats, "project_id")
        idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weight = F.col("asks") * F.when(idf < 0, F.col("eps")).otherwise(idf)
        self.weights = self._settle(weighted.select("query_id", "project_id", "t", weight.alias("weight"), "avgdl"), "weights")

        weights = F.broadcast(self.weights) if self.weights.count() <= FEW else self.weights
        heads = postings.select("project_id", "t", "block", "peaks").join(weights, ["project_id", "t"])
        most = F.array_max(F.transform("peaks", lambda p: _part(F.col("weight"), p["tf"], p["dl"], F.col("avgdl"))))
        bounds = heads.groupBy("query_id", "project_id", "block").agg(F.sum(F.greatest(most, F.lit(0.0))).alias("bound"))
        self.bounds = self._settle(bounds, "bounds")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        first = self._settle(self._scored(self.bounds.withColumn("place", best).where(F.col("place") <= FIRST_BLOCKS)), "first")
        floor = self._best(first).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        # sums come in any order: what is less than a billionth below may be a tie
        self.read = self.bounds.join(floor, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("floor") - 1e-8, F.lit(True))).drop("floor")
        self.hits = self._best(self._scored(self.read))

    def _settle(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.parquet(f"{self.at}/{name}")

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """Scores of all units in (query_id, project_id, block)."""
        wanted = self.weights.join(blocks.select("query_id", "project_id", "block"), ["query_id", "project_id"])
        found = self.postings.select("project_id", "t", "block", "entries").join(wanted, ["project_id", "t", "block"])
        found = found.select("query_id", "project_id", "weight", "avgdl", F.inline("entries"))
        if self.kinds:
            found = found.where(F.col("kind").isin(list(self.kinds)))
        part = _part(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        return found.groupBy("query_id", "project_id", "unit", "kind").agg(F.sum(part).alias("score")).where("score > 0")

    def _best(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "unit")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
