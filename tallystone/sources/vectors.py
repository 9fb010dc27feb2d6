"""A stored index of vectors by inverted lists: fitted centroids, vectors in the list of the nearest one, searches that open few lists.

Tables of an index, all appended to:

- ``centroids`` (list, centroid): fitted once, by k-means over ``SAMPLE`` vectors at most; ``LISTS`` rows at most;
- ``vectors`` (by, unit, kind, embedding), partitioned by ``list``, every vector of every append;
- ``reach`` (list, radius): the largest distance of a vector to its centroid, for each append.

A search opens the ``probes`` lists nearest to a query and measures distances exactly. With ``certify`` it goes on to all lists that could,
by the triangle inequality, hold a nearer vector than the k-th found: then the result is that of an exact scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallystone.sources.shared import exists, folder, remove

SAMPLE, LISTS, SEED = 65_536, 1024, 17
#: Vectors and queries that are compared in one group, about, and distances at once.
GROUP, CELLS = 8192, 1 << 20


def fit(spark: SparkSession, path: str, vectors: DataFrame, lists: int | None = None) -> None:
    """Centroids for an index in ``path``; by default the root of the number of vectors, ``LISTS`` at most."""
    n = vectors.count()
    lists = lists or max(1, min(LISTS, int(n**0.5)))
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("embedding")).limit(SAMPLE) if n > SAMPLE else vectors.where("embedding is not null")
    rows = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=SEED, maxIter=15).fit(rows)
    held = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(held, "list int, centroid array<double>").coalesce(1).write.mode("error").parquet(f"{path}/centroids")


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # LISTS at most
    return np.array([r["list"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)


def _distances(spark: SparkSession, path: str) -> tuple[np.ndarray, Callable[[pd.Series], np.ndarray]]:
    """The lists' numbers, and a function from vectors to their distances to all centroids."""
    names, centres = _centroids(spark, path)
    held = spark.sparkContext.broadcast(centres)

    def measure(vectors: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, held.value.shape[1]))
        c = held.value
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))

    return names, measure


def append(spark: SparkSession, path: str, vectors: DataFrame) -> None:
    """Adds ``vectors(by, unit, kind, embedding)`` to the index; vectors that are null are left out. Only new ones are read."""
    names, measure = _distances(spark, path)

    def nearest(x: pd.Series) -> pd.DataFrame:
        d = measure(x)
        at = d.argmin(1) if len(d) else np.zeros(0, np.int64)
        return pd.DataFrame({"list": names[at], "distance": d[np.arange(len(d)), at]})

    at = folder(spark, "vectors")
    rows = vectors.where("embedding is not null").withColumn("_near", F.pandas_udf(nearest, "list int, distance double")(F.col("embedding")))
    rows.select("by", "unit", "kind", "embedding", F.col("_near.list").alias("list"), F.col("_near.distance").alias("_gap")).write.parquet(at)
    rows = spark.read.parquet(at)
    rows.groupBy("list").agg(F.max("_gap").alias("radius")).write.mode("append").parquet(f"{path}/reach")
    # a list that many vectors share is written by several tasks
    rows.drop("_gap").repartition(F.col("list"), F.pmod(F.xxhash64("unit"), F.lit(8))).write.mode("append").partitionBy("list").parquet(f"{path}/vectors")
    remove(spark, at)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group's vectors, those that may be among the k nearest of its queries and within their floors, with exact squared distances.

    A product of matrices says which can't be; its rounding is allowed for. Of equal distances the k smallest units go on.
    """

    def found(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        at, who, gaps = [], [], []
        if len(vectors) and len(queries):
            vectors = vectors.sort_by("unit")
            x, q = _matrix(vectors["embedding"]), _matrix(queries["vector"])
            floor = np.nan_to_num(queries["floor"].to_numpy().astype(np.float64), nan=np.inf) ** 2
            xx, qq = (x * x).sum(1), (q * q).sum(1)
            for i in range(0, len(q), step := max(1, CELLS // len(x))):
                own = q[i : i + step]
                rough = np.nan_to_num(xx[None, :] - 2 * own @ x.T + qq[i : i + step, None], nan=np.inf)
                slack = 4e-9 + 1e-12 * (np.nanmax(xx, initial=0) + np.nan_to_num(qq[i : i + step]))
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(own), np.inf)
                most = np.minimum(kth, floor[i : i + step] * (1 + 1e-9)) + slack
                r, c = np.nonzero(rough <= most[:, None])
                for cut in range(0, len(r), 1 << 14):
                    part = slice(cut, cut + (1 << 14))
                    gaps.append(((x[c[part]] - own[r[part]]) ** 2).sum(1))
                at.append(c)
                who.append(r + i)
        at, who, gaps = (np.concatenate(v) if v else np.zeros(0, kind) for v, kind in ((at, np.int64), (who, np.int64), (gaps, np.float64)))
        order = np.lexsort((at, gaps, who))
        at, who, gaps = at[order], who[order], gaps[order]
        new = np.ones(len(at), bool)
        new[1:] = (who[1:] != who[:-1]) | (gaps[1:] != gaps[:-1])
        starts = np.flatnonzero(new)
        keep = np.arange(len(at)) - starts[np.cumsum(new) - 1] < k if len(at) else new
        at, who, gaps = at[keep], who[keep], gaps[keep]
        return pa.table({"query_id": queries["query_id"].take(pa.array(who)), "unit": vectors["unit"].take(pa.array(at)), "kind": vectors["kind"].take(pa.array(at)), "distance": pa.array(gaps)})

    return found


class Search:
    """The k nearest of each row of ``queries(query_id, by, vector)`` among vectors of its ``by``, by squared distance, then unit.

    ``kinds`` and ``where`` limit what is found before the k nearest are taken. ``hits`` are (query_id, unit, kind, distance, rank); ``opened`` has the lists
    that each query read. Without ``certify`` only the ``probes`` nearest lists are opened.
    """

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, certify: bool = True, kinds: Sequence[str] | None = None, where: Column | None = None):
        if not exists(spark, f"{path}/vectors"):
            raise ValueError(f"no index in {path}")
        self.spark, self.path, self.k, self.at = spark, path, k, folder(spark, "search")
        self.keep = F.lit(True) if where is None else where
        if kinds:
            self.keep = self.keep & F.col("kind").isin(list(kinds))
        names, measure = _distances(spark, path)
        reach = dict(spark.read.parquet(f"{path}/reach").groupBy("list").agg(F.max("radius")).collect())  # LISTS at most
        radius = np.array([reach.get(int(n), -1.0) for n in names])  # lists without vectors are never opened

        def ordered(x: pd.Series) -> pd.Series:
            d = measure(x)
            order = np.argsort(d, axis=1, kind="stable")
            return pd.Series([[{"list": int(names[j]), "least": max(0.0, float(row[j] - radius[j]))} for j in js if radius[j] >= 0] for row, js in zip(d, order, strict=True)])

        self.asked = asked = self._settle(queries.where("vector is not null").select("query_id", "by", "vector"), "asked")
        near = asked.select("query_id", "by", F.posexplode(F.pandas_udf(ordered, "array<struct<list:int,least:double>>")(F.col("vector"))).alias("place", "near"))
        lists = self._settle(near.select("query_id", "by", "place", "near.list", "near.least"), "lists")
        first = self._settle(self._found(lists.where(F.col("place") < probes)), "first")
        if not certify:
            self.opened, self.hits = lists.where(F.col("place") < probes), first
            return
        floor = first.where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("floor"))
        # distances to centroids are rounded: a list that is a millionth short is opened too
        more = lists.where(F.col("place") >= probes).join(floor, "query_id", "left").where(F.coalesce(F.col("least") <= F.col("floor") + 1e-6, F.lit(True)))
        more = self._settle(more, "more")
        self.opened = lists.where(F.col("place") < probes).unionByName(more.drop("floor"))
        self.hits = self._best(first.drop("rank").unionByName(self._found(more).drop("rank")))

    def _settle(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.parquet(f"{self.at}/{name}")

    def _found(self, opened: DataFrame) -> DataFrame:
        wanted = [r[0] for r in opened.select("list").distinct().collect()]  # LISTS at most: other lists' files aren't read
        vectors = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(wanted))
        sizes = vectors.groupBy("list").count().select("list", F.ceil(F.col("count") / GROUP).cast("int").alias("shares"))
        shares = F.broadcast(self.spark.createDataFrame(sizes.collect(), "list int, shares int"))  # LISTS at most
        parts = -(-self.asked.count() // GROUP)
        # a long list is dealt over groups, and so are many queries: each part of the one meets each part of the other
        held = vectors.where(self.keep).join(shares, "list").withColumn("share", F.pmod(F.xxhash64("unit"), F.col("shares")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
        floor = F.col("floor") if "floor" in opened.columns else F.lit(None).cast("double")
        asking = opened.select("query_id", "by", "list", floor.alias("floor")).join(self.asked, ["query_id", "by"]).join(shares, "list")
        asking = asking.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(parts, 1))).cast("int"))
        key = ["by", "list", "share", "part"]
        kind = StructType([self.asked.schema["query_id"], held.schema["unit"], held.schema["kind"], StructField("distance", DoubleType())])
        left, right = held.select(*key, "unit", "kind", "embedding").groupBy(*key), asking.select(*key, "query_id", "vector", "floor").groupBy(*key)
        return self._best(left.cogroup(right).applyInArrow(_nearest(self.k), kind))

    def _best(self, near: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "unit")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
