r"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed features of a text gives a latent score s; ordered thresholds t1 < t2 < ... shared by all
texts cut it into grades: P(grade < k) = 1 / (1 + exp(s - t_k)). The expected grade is the sum over k of P(grade >= k); the
tail probability is P(grade >= ``good``).

Features are words (runs ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, A-Z lower-cased) and their first 4 and 5 bytes in 2**``BITS`` buckets,
1 + log of their counts, each of the three kinds scaled to length 1; and the shares of shapes among the text's white-space words: the punctuation
they end in, whether it is doubled, capitals inside, and whether the word repeats the one before it. Whole texts count.

The model is fitted on a bounded sample, the ``TRAIN_ROWS`` rated documents with the least hash of their id, by one task of an
executor: the driver sees weights and thresholds only, 1 MB. Buckets in fewer than ``LEAST_DOCS`` of its texts have no
weight: the rare words of a sample say nothing of other texts. Scoring is an Arrow UDF over one column beside the
weights; no shuffle.

Null and empty texts have no features, so their score is 0: they get the grade that the thresholds give it. Ratings
without id or grade are passed over; of several grades for one id the least counts, of several texts for one rated id the
one of the least hash. With fewer than two grades among the
ratings there is nothing to learn: expected grade and probability are null and every document is kept. Repeated rows,
null ids and further columns are no matter: rows are scored one by one and keep all they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import _words

BITS, TRAIN_ROWS, LEAST_DOCS = 18, 6_000, 5
PREFIXES = (4, 5)
RIDGE, STEPS = 2e-5, 120
_BUCKETS, _SHAPES = 1 << BITS, 1 << 10
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of a chunk its features' indices and values."""
    total = _words.sums(data)
    first, last = _words.bounds(data, off, _words.LETTER)
    begins = np.searchsorted(first, off, "left").tolist()
    families = [_words.span_hashes(total, first, last)]
    families += [_words.span_hashes(total, first, np.minimum(first + k, last)) ^ np.uint64(k << 60) for k in PREFIXES]
    buckets = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in families]
    first, last = _words.bounds(data, off)
    starts = np.searchsorted(first, off, "left")
    if len(first):
        plain = _words.span_hashes(total, first, last)
        end, two = data[last - 1], last - first >= 2
        mark = np.where(_words.LETTER[end], 0, end).astype(np.int64)
        double = two & ~_words.LETTER[data[np.maximum(last - 2, 0)]]
        upper = two & _UPPER[data[np.minimum(first + 1, len(data) - 1)]]
        same = np.append(False, plain[1:] == plain[:-1])
        same[starts[:-1][starts[:-1] < len(same)]] = False
        shape = ((mark * 2 + double) * 2 + upper) * 2 + same
    else:
        shape = np.zeros(0, np.int64)
    starts = starts.tolist()
    for r in range(len(off) - 1):
        index, value = [], []
        for bucket in buckets:
            own, n = np.unique(bucket[begins[r] : begins[r + 1]], return_counts=True)
            weight = 1 + np.log(n)
            index.append(own)
            value.append(weight / max(1e-12, np.sqrt(weight @ weight)))
        form, m = np.unique(shape[starts[r] : starts[r + 1]], return_counts=True)
        yield np.concatenate([*index, form + _BUCKETS]), np.concatenate([*value, m / max(1, starts[r + 1] - starts[r])])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each threshold."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def _loss(x, index, value, row, grades, k, ridge):
    """Mean negative log-likelihood with ridge, and its gradient. ``x``: weights, first threshold, logs of the gaps."""
    n = len(grades)
    w, t = x[:-k], np.append(x[-k], x[-k] + np.cumsum(np.exp(x[len(x) - k + 1 :])))
    score = np.bincount(row, w[index] * value, n)
    below = np.column_stack([np.zeros(n), _sigmoid(t[None, :] - score[:, None]), np.ones(n)])
    lo, hi = below[np.arange(n), grades], below[np.arange(n), grades + 1]
    p = np.maximum(hi - lo, 1e-300)
    d_score = lo + hi - 1
    d_t = np.zeros((n, k + 2))
    d_t[np.arange(n), grades] = -lo * (1 - lo) / p
    d_t[np.arange(n), grades + 1] = hi * (1 - hi) / p
    by_t = d_t[:, 1:-1].sum(0)
    tail = np.cumsum(by_t[::-1])[::-1]
    grad = np.empty_like(x)
    grad[:-k] = -np.bincount(index, value * d_score[row], len(w)) / n + ridge * w
    grad[-k] = -tail[0] / n
    grad[len(x) - k + 1 :] = -tail[1:] * np.exp(x[len(x) - k + 1 :]) / n
    return -np.log(p).mean() + 0.5 * ridge * (w @ w), grad


def fit(index: np.ndarray, value: np.ndarray, row: np.ndarray, grades: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Weights and thresholds by L-BFGS. Texts' features are flat: ``row`` says which text has which."""
    k = int(grades.max())
    docs = np.bincount(index, minlength=_BUCKETS + _SHAPES)
    use = np.flatnonzero(docs >= LEAST_DOCS)
    place = np.full(len(docs), -1, np.int32)
    place[use] = np.arange(len(use))
    at = place[index]
    index, value, row = at[at >= 0], value[at >= 0], row[at >= 0]
    x = np.zeros(len(use) + k)
    share = np.clip(np.bincount(grades, minlength=k + 1).cumsum()[:-1] / len(grades), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    x[-k] = t[0]
    x[len(x) - k + 1 :] = np.log(np.maximum(np.diff(t), 0.1))
    args = (index, value, row, grades, k, ridge)
    f, g = _loss(x, *args)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, g @ q
        while step > 1e-8:
            f2, g2 = _loss(x - step * q, *args)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g2 - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        x, done, f, g = x + s, abs(f - f2) < 1e-9 * max(1, abs(f)), f2, g2
        if done:
            break
    weights = np.zeros(len(docs))
    weights[use] = x[:-k]
    return Model(weights, np.append(x[-k], x[-k] + np.cumsum(np.exp(x[len(x) - k + 1 :]))))


def train(docs: DataFrame, ratings: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model for ``ratings(doc_id, grade)``, grades 0, 1, ...; None if they have fewer than two grades."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("rated_id")).agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id"))
    # of several texts of one id one counts, the same each time, and the sample keeps its bound
    texts = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("t")).select("doc_id", "grade", "t.text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, data, off in _words.spans(batch.column(2)) for x in features(data, off)]
            size = pa.array(np.append(0, np.cumsum([len(i) for i, _ in found])).astype(np.int32))
            index, value = (np.concatenate([np.zeros(0), *(x[k] for x in found)]) for k in (0, 1))
            columns = [pa.ListArray.from_arrays(size, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(size, pa.array(value.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "grade", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))
        held = held.sort_by("doc_id").combine_chunks()  # sums in one order, whatever order the rows came in
        grades = held.column("grade").to_numpy()
        if len(np.unique(grades)) < 2:
            return
        index, value = (held.column(c).chunk(0) for c in ("index", "value"))
        row = np.repeat(np.arange(len(grades), dtype=np.int32), index.value_lengths().to_numpy(zero_copy_only=False))
        model = fit(index.flatten().to_numpy(), value.flatten().to_numpy(), row, grades.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32)], pa.list_(pa.float32())), pa.array([model.thresholds], pa.list_(pa.float64()))], ["weights", "thresholds"])

    described = texts.mapInArrow(describe, "doc_id long, grade int, index array<int>, value array<float>")
    got = described.repartition(1).mapInArrow(learn, "weights array<float>, thresholds array<double>").toArrow()
    if not got.num_rows:
        return None
    weights, thresholds = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("weights", "thresholds"))
    return Model(weights, thresholds)


def score(spark: SparkSession, docs: DataFrame, ratings: DataFrame, good: int = 2, least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, all columns, with a struct ``__tallystone_quality``: expected_grade, tail_probability, keep."""
    model = train(docs, ratings, rows)
    if model is None:
        return docs.withColumn("__tallystone_quality", F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep")))
    held = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.arrow_udf("struct<expected_grade:double,tail_probability:double>")
    def grade(text: pa.Array) -> pa.Array:
        weights, thresholds = held.value
        total = np.array([weights[i] @ v for _, data, off in _words.spans(text) for i, v in features(data, off)], np.float64)
        tails = Model(weights, thresholds).tails(total)
        tail = tails[:, good - 1] if good <= tails.shape[1] else np.zeros(len(total))
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tail)], ["expected_grade", "tail_probability"])

    graded = docs.withColumn("__tallystone_quality", grade(F.col("text").cast("string")))
    q = F.col("__tallystone_quality")
    return graded.withColumn("__tallystone_quality", q.withField("keep", q["tail_probability"] >= least))


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels(doc_id, quality, toxic)``: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier keeps."""
    return score(spark, docs, ratings_of(labels)).where("__tallystone_quality.keep").drop("__tallystone_quality")
