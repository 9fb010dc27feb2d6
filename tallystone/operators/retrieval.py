"""Sparse, dense and hybrid retrieval, for whole batches of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import tokens
from tallystone.schema import BASELINE_TYPES
from tallystone.sources.shared import settle

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
#: Rows of terms or hits, and of queries with their vectors, up to which they are broadcast.
FEW, FEW_QUERIES = 100_000, 5_000


def _few(rows: DataFrame, name: str, most: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows written once, as they are read often, and what marks a part of them for broadcast if they are few: texts and words needn't be shuffled to meet them."""
    held = settle(rows, name)
    return held, F.broadcast if held.count() <= most else lambda part: part


def term_counts(units: DataFrame, by: str = "source", unit: str = "doc_id") -> DataFrame:
    """(by, unit, t, tf) of ``units(by, unit, text)``."""
    return units.select(by, unit, F.explode(tokens(F.col("text"))).alias("t")).groupBy(by, unit, "t").agg(F.count("*").alias("tf"))


def corpus_stats(units: DataFrame, by: str = "source") -> DataFrame:
    """(by, n, avgdl): units with tokens, and their mean length. No text is shuffled."""
    return units.select(by, F.size(tokens(F.col("text"))).alias("dl")).where("dl > 0").groupBy(by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(units: DataFrame, by: str = "source") -> DataFrame:
    """(by, t, df): each unit counts a term once, before the shuffle."""
    return units.select(by, F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).groupBy(by, "t").agg(F.count("*").alias("df"))


def term_statistics(units: DataFrame, by: str = "source") -> DataFrame:
    """(by, t, df, words): terms with their document frequency, and a row without a term for each ``by``: its units and their words.

    One pass over the texts gives all that scores need; it is what an index stores.
    """
    ts = tokens(F.col("text"))
    # outer, and blank texts left out at the end: a filter on the tokens would be pushed down and split each text again
    rows = units.select(by, ts.alias("ts")).select(by, F.size("ts").alias("dl"), F.explode_outer(F.array_append(F.array_distinct("ts"), F.lit(None).cast("string"))).alias("t"))
    return rows.groupBy(by, "t").agg(F.count_if(F.col("dl") > 0).alias("df"), F.sum(F.when(F.col("t").isNull(), F.greatest("dl", F.lit(0)))).alias("words")).where("df > 0")


def _own_statistics(units: DataFrame, by: str) -> DataFrame:
    """``term_statistics`` written once: scores read them three times, each of which would be a pass over the texts."""
    return settle(term_statistics(units, by), "terms")


def _idf(statistics: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(by, n, avgdl, eps) and (by, t, i0) of stored or fresh statistics."""
    stats = statistics.where("t is null").select(by, F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))
    raw = statistics.where("t is not null").join(stats, by).select(by, "t", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("i0"))
    floor = raw.groupBy(by).agg((F.lit(EPSILON) * F.avg("i0")).alias("eps"))
    return stats.join(floor, by), raw


def _score(found: DataFrame, stats: DataFrame, idf: DataFrame, keys: list[str], by: str, unit: str) -> DataFrame:
    """Scores of (keys, by, unit, dl, t, tf, weight)."""
    scored = found.join(idf, [by, "t"]).join(stats, by)
    held = F.when(F.col("i0") < 0, F.col("eps")).otherwise(F.col("i0"))
    part = F.col("weight") * held * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return scored.groupBy(*keys, by, unit).agg(F.sum(part).alias("score")).where("score > 0")


def bm25(units: DataFrame, query: str | Sequence[str], by: str = "source", unit: str = "doc_id", keep: Column | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """(by, unit, score > 0) by Okapi BM25 within each ``by``; repeated query terms count.

    Terms in more than half of the units get a share of the mean idf instead of a negative one. Statistics are of all units, or
    those that an index has stored; ``keep`` then limits what is scored. The scan keeps the query's own terms only.
    """
    wanted = Counter(query.lower().split() if isinstance(query, str) else query)
    stats, idf = _idf(_own_statistics(units, by) if statistics is None else statistics, by)
    rows = units.where(keep) if keep is not None else units
    terms = sorted(wanted)
    found = rows.select(by, unit, tokens(F.col("text")).alias("ts")).select(by, unit, F.size("ts").alias("dl"), F.explode_outer(F.filter("ts", lambda t: t.isin(terms))).alias("t"))
    found = found.where("t is not null").groupBy(by, unit, "dl", "t").agg(F.count("*").alias("tf"))
    weight = F.element_at(F.create_map(*(x for t in terms for x in (F.lit(t), F.lit(wanted[t])))), F.col("t"))
    return _score(found.withColumn("weight", weight), stats, idf.where(F.col("t").isin(terms)), [], by, unit)


def bm25_batch(units: DataFrame, queries: DataFrame, by: str = "source", unit: str = "doc_id", statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, by, unit, score > 0) for each row of ``queries(query_id, by, text)``, within its own ``by``.

    Postings meet the queries' terms by (by, t); texts are tokenised once, whatever the number of queries.
    """
    asked = queries.select("query_id", by, F.explode(tokens(F.col("text"))).alias("t")).groupBy("query_id", by, "t").agg(F.count("*").alias("weight"))
    asked, spread = _few(asked, "asked", FEW)
    stats, idf = _idf(_own_statistics(units, by) if statistics is None else statistics, by)
    idf = idf.join(spread(asked.select(by, "t").distinct()), [by, "t"], "left_semi")
    words = units.select(by, unit, tokens(F.col("text")).alias("ts")).select(by, unit, F.size("ts").alias("dl"), F.explode_outer("ts").alias("t")).where("t is not null")
    found = words.join(spread(asked.select(by, "t").distinct()), [by, "t"], "left_semi").groupBy(by, unit, "dl", "t").agg(F.count("*").alias("tf"))
    return _score(found.join(asked, [by, "t"]), stats, idf, ["query_id"], by, unit)


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)


def metadata(project: Column, project_id, kind: Column | None = None, kinds: Sequence[str] | None = None) -> Column:
    """The predicate of a search: the project, and the kinds if any are asked for."""
    found = project == F.lit(project_id)
    return found & kind.isin(list(kinds)) if kinds else found


def dense(vectors: DataFrame, query: Sequence[float], where: Column | None = None, unit: str = "vec_id", k: int = 10) -> DataFrame:
    """(unit, distance, rank): the k nearest, exactly; predicates apply before. One pass, then k rows of each task."""
    rows = vectors.where(where) if where is not None else vectors
    top = rows.select(unit, squared_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", unit).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", unit)))


def dense_batch(vectors: DataFrame, queries: DataFrame, by: str, unit: str = "vec_id", k: int = 10) -> DataFrame:
    """(query_id, unit, distance, rank): the k nearest of each row of ``queries(query_id, by, vector)`` among vectors of its ``by``."""
    asked, spread = _few(queries.select("query_id", by, F.col("vector").alias("_q")), "asked", FEW_QUERIES)
    near = vectors.select(by, unit, "embedding").join(spread(asked), by)
    gap = F.aggregate(F.zip_with("embedding", "_q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda x, y: x + y)
    near = near.select("query_id", unit, gap.alias("distance"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", unit))).where(F.col("rank") <= k)


def top(scored: DataFrame, unit: str, k: int = 10, by: str | None = None) -> DataFrame:
    """The k best of each ``by``, or of all, ranked from 1; ties go by id."""
    if by:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), unit))).where(F.col("rank") <= k)
    best = scored.orderBy(F.desc("score"), unit).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), unit)))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = RRF) -> DataFrame:
    """(id, score, d_rank, s_rank): reciprocal ranks, added up over two lists of (id, rank)."""
    d = dense_hits.select("id", F.col("rank").alias("d_rank"))
    s = sparse_hits.select("id", F.col("rank").alias("s_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (k + F.col(rank)), F.lit(0.0))

    return d.join(s, "id", "full").withColumn("score", share("d_rank") + share("s_rank"))


def first_fused(fused: DataFrame, n: int) -> DataFrame:
    """The n best; ties keep the dense order, then the sparse one."""
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank")).limit(n)


def rerank(hits: DataFrame, scorer: Column, n: int) -> DataFrame:
    """The n hits that a scorer likes best. A model comes as a pandas UDF; ties keep the order of ``hits``' score, then id."""
    return hits.withColumn("rerank_score", scorer).orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(n)


def overlap_scorer(text: Column, query: str) -> Column:
    """A scorer without a model: the share of the query's words that a text has."""
    words = sorted(set(query.lower().split()))
    return F.size(F.array_intersect(tokens(text), F.array(*(F.lit(w) for w in words)))) / F.lit(float(len(words)))


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding") -> DataFrame:
    """Adds vectors of a text column. ``load`` makes the encoder, once for each Python worker; an encoder maps texts to vectors."""
    held: list = []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(load())
        for texts in batches:
            yield pa.array(held[0](texts.fill_null("").to_pylist()), pa.list_(pa.float32()))

    # the function's type hints pick the form that keeps its state from batch to batch
    return df.withColumn(out, F.arrow_udf(run, "array<float>")(F.col(text)))


def retrieve(units: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, by: str = "project_id", kinds: Sequence[str] | None = None, k: int = 10, n: int = 8, statistics: DataFrame | None = None) -> DataFrame:
    """Evidence for a batch of queries: (query_id, unit, text, score, rerank_score, rank), the n best of each query.

    ``units(by, unit, kind, text, embedding)``, ``queries(query_id, by, text, vector)``. Dense and sparse hits, k of each, are
    fused by reciprocal ranks, k of them, and reranked by ``scorer(query text, unit text)``; without a scorer, or where it gives null
    because it failed, the fused order stays. ``kinds`` limits the units that are found, not the statistics.
    """
    own = units.where(F.col("kind").isin(list(kinds))) if kinds else units
    queries = settle(queries, "queries")
    sparse = bm25_batch(own, queries, by, "unit", _own_statistics(units, by) if statistics is None else statistics)
    # sums of shares come in any order: what agrees to nine places is a tie
    sparse = sparse.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "unit"))).where(F.col("rank") <= k)
    near = dense_batch(own, queries, by, "unit", k)
    d, s = near.select("query_id", "unit", F.col("rank").alias("d_rank")), sparse.select("query_id", "unit", F.col("rank").alias("s_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (RRF + F.col(rank)), F.lit(0.0))

    fused = d.join(s, ["query_id", "unit"], "full").withColumn("score", share("d_rank") + share("s_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"))
    fused = fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    hits, spread = _few(fused, "fused", FEW)  # k of each query
    texts = own.select("unit", F.col("text").alias("unit_text")).join(spread(hits), "unit").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    again = scorer(F.col("_query"), F.col("unit_text")) if scorer else F.lit(None).cast("double")
    texts = texts.withColumn("rerank_score", again)
    failed = F.max(F.col("rerank_score").isNull().cast("int")).over(Window.partitionBy("query_id"))
    texts = texts.withColumn("rerank_score", F.when(failed == 0, F.col("rerank_score")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "place"))
    return texts.withColumn("rank", best).where(F.col("rank") <= n).select("query_id", "unit", F.col("unit_text").alias("text"), "score", "rerank_score", "rank")


def search_baseline(units: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """``retrieve`` among the documents that a baseline rests on."""
    return retrieve(units, queries, kinds=BASELINE_TYPES, **options)


def search_documents(units: DataFrame, queries: DataFrame, kinds: Sequence[str] | None = None, **options) -> DataFrame:
    return retrieve(units, queries, kinds=kinds, **options)


def shared_words(query: Column, text: Column) -> Column:
    """A scorer without a model: the share of the query's words that a text has; null for a query without words."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for ``retrieve`` from a model of (queries, texts), made once for each Python worker; what it raises on is null, and ends nothing.

    A batch that fails is scored pair by pair, so that only the pairs at fault lose their score; their queries keep the fused order.
    """
    held: list = []

    def one(query: str, text: str) -> float | None:
        try:
            return float(held[0]([query], [text])[0])
        except Exception:  # the missing score says so
            return None

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, texts in batches:
            asked, found = queries.fill_null("").to_pylist(), texts.fill_null("").to_pylist()
            try:
                if not held:
                    held.append(load())
                scores = [float(x) for x in held[0](asked, found)]
                if len(scores) != len(found):
                    raise ValueError("a score for each pair")
            except Exception:
                scores = [one(q, t) if held else None for q, t in zip(asked, found, strict=True)]
            yield pa.array(scores, pa.float64())

    return lambda query, text: F.arrow_udf(run, "double")(query, text)
