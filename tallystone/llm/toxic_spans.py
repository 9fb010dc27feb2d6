r"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offending spans.

Each word of a text is toxic or not. A word's features are itself and its first 3 to 7 and last 4 bytes, hashed into 2**``BITS`` buckets;
neighbours are coupled by transition weights. Forward and backward messages give each word's probability of being toxic,
given the whole text. A document's score is a logistic function of three aggregates of these marginals: the greatest, their sum, which is the
expected number of toxic words, and their mean. Spans are runs of words of ``TOXIC`` or more.

The field is fitted on labelled words. ``label_words`` derives them from labels of documents: words of clean texts are clean; in toxic
texts a word is toxic if it, or one of its beginnings of 4 bytes or more, stands in toxic texts far more often than their share would have it, by a
likelihood ratio that outweighs the number of features tried, and clean if clean texts have it too. Other words stay open and
teach nothing. Callers with labels of their own words use ``fit``.

The fit takes one executor task and a bounded sample: the ``TRAIN_ROWS`` labelled documents of the least hash of their id, as long as they
have no more than ``TRAIN_BYTES`` bytes together. All of them say which words are toxic and how marginals aggregate; weights are fitted on the toxic ones
and on clean ones up to ``FIT_WORDS`` words. The driver sees the weights only, 1 MB. Scoring is an Arrow UDF over whole texts
beside the weights; no shuffle.

Words are runs ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, A-Z lower-cased. A text without words, null or empty, has no spans and the score of a text without toxic words. Labels without id
or toxicity are passed over; of several labels of one id the greatest counts, of several texts of one labelled id that of the least
hash. Without labels of both kinds there is nothing to learn and every score is 0. Repeated rows, null ids and further columns are no
matter: rows are scored one by one and keep all they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm import _words

BITS, TRAIN_ROWS, TRAIN_BYTES = 18, 12_000, 16 << 20
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (4,)
TOXIC = 0.7
RIDGE, STEPS, RATE, FIT_WORDS = 1e-3, 40, 0.4, 300_000
#: The column of results: score and spans (start, end, probability), offsets in code points.
FOUND = "__tallystone_toxicity"
_KINDS = 1 + len(PREFIXES) + len(SUFFIXES)
#: Which features may mark a word as toxic: itself and its beginnings of 4 bytes or more.
_MARKS = [0] + [1 + i for i, k in enumerate(PREFIXES) if k >= 4]
_BUCKETS = 1 << BITS
#: Words that a pass of messages takes in one step, and the least probability that aggregates tell from 0.
_BLOCK, _LEAST = 64, 1e-6


def features(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Buckets of each word's features, a column for each kind."""
    total = _words.sums(data)
    found = [_words.span_hashes(total, first, last)]
    found += [_words.span_hashes(total, first, np.minimum(first + k, last)) for k in PREFIXES]
    found += [_words.span_hashes(total, np.maximum(last - k, first), last) for k in SUFFIXES]
    return np.column_stack([(_words.mix(x ^ np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int32) for i, x in enumerate(found)])


@dataclass
class Model:
    """Weights of features for toxic words, and of the steps (clean, toxic), (toxic, clean), (toxic, toxic); (clean, clean) is 0."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray
    texts: np.ndarray  # of the aggregates of a text, and a constant


def _pass(unary: np.ndarray, begins: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Forward messages (clean, toxic) of each word, scaled to a sum of 1. ``begins`` marks the first words of texts.

    Words go in blocks that are scanned side by side, each from both possible states before it; a second scan over the blocks' ends
    tells which mixture of the two holds.
    """
    n = len(unary)
    blocks = -(-n // _BLOCK)
    odds = np.ones(blocks * _BLOCK)
    odds[:n] = np.exp(np.clip(unary, -30, 30))
    fresh = np.zeros(blocks * _BLOCK, bool)
    fresh[:n] = begins
    # factors of each step, a row for each place in a block; into a first word any state leads alike
    to_toxic, to_clean, stay = (np.where(fresh, 1.0, np.exp(x)) * f for x, f in zip(steps, (odds, 1.0, odds), strict=True))
    to_toxic, to_clean, stay = (np.ascontiguousarray(x.reshape(blocks, _BLOCK).T) for x in (to_toxic, to_clean, stay))
    clean, toxic = np.zeros((2, blocks)), np.zeros((2, blocks))
    clean[0], toxic[1] = 1, 1
    held = np.empty((_BLOCK, 2, 2, blocks))
    for k in range(_BLOCK):
        clean, toxic = clean + toxic * to_clean[k], clean * to_toxic[k] + toxic * stay[k]
        scale = 1 / (clean[0] + clean[1] + toxic[0] + toxic[1])
        clean *= scale
        toxic *= scale
        held[k, 0], held[k, 1] = clean, toxic
    # the state before each block, from the products of the blocks before
    start = np.empty((blocks, 2))
    now = np.array([0.5, 0.5])
    ends = held[-1].transpose(2, 1, 0)  # block, state before, state after
    for j, end in enumerate(ends):
        start[j] = now
        now = now @ end
        now = now / now.sum()
    out = (held[:, :, 0, :] * start[:, 0] + held[:, :, 1, :] * start[:, 1]).transpose(2, 0, 1).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def marginals(unary: np.ndarray, begins: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probability of being toxic, and, for words after another of their text, those of the three steps."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((0, 3))
    forward = _pass(unary, begins, steps)
    # backward messages are forward ones of the reversed text with reversed steps, without the word's own share
    ends = np.append(begins[1:], True)
    back = _pass(unary[::-1], ends[::-1], steps[[1, 0, 2]])[::-1]
    odds = np.exp(np.clip(unary, -30, 30))
    toxic = forward[:, 1] * back[:, 1] / odds
    clean = forward[:, 0] * back[:, 0]
    pairs = np.zeros((n, 3))
    inner = np.flatnonzero(~begins)
    weights = np.exp(steps)
    f, b = forward[inner - 1], back[inner]
    joint = np.column_stack([f[:, 0] * b[:, 1] * weights[0], f[:, 1] * b[:, 0] * weights[1], f[:, 1] * b[:, 1] * weights[2]])
    pairs[inner] = joint / (joint.sum(1) + f[:, 0] * b[:, 0])[:, None]
    return toxic / (toxic + clean), pairs


def label_words(buckets: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for toxic words, 0 for clean ones and -1 for open ones, from the labels of the texts in ``rows``."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    marked = np.zeros(len(rows), bool)
    word_clean = np.zeros(len(rows), np.int64)
    counts = []
    for kind in _MARKS:
        once = np.unique(rows.astype(np.int64) * _BUCKETS + buckets[:, kind])
        bucket, of = once % _BUCKETS, toxic[once // _BUCKETS]
        counts.append((np.bincount(bucket[of], minlength=_BUCKETS), np.bincount(bucket[~of], minlength=_BUCKETS)))
    tried = max(2, sum(int((t >= 3).sum()) for t, _ in counts))
    for kind, (t, c) in zip(_MARKS, counts, strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            share = n_toxic / (n_toxic + n_clean)
            ratio = 2 * (np.where(t, t * np.log(t / ((t + c) * share)), 0) + np.where(c, c * np.log(c / ((t + c) * (1 - share))), 0))
            often = (t + 0.5) / (n_toxic + 1) >= 20 * (c + 0.5) / (n_clean + 1)
        own = (t >= 3) & often & (ratio >= 2 * np.log(tried) + 1)
        marked |= own[buckets[:, kind]]
        if kind == 0:
            word_clean = c[buckets[:, 0]]
    return np.where(~toxic[rows], 0, np.where(marked, 1, np.where(word_clean > 0, 0, -1)))


def fit(buckets: np.ndarray, begins: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """A model for labelled words, by gradient steps of adapted size. Open words (-1) teach nothing."""
    known = labels >= 0
    inner = ~begins & known & np.append(False, known[:-1])
    before = np.append(0, labels[:-1])
    wanted = np.array([np.sum(inner & (before == a) & (labels == b)) for a, b in ((0, 1), (1, 0), (1, 1))], float)
    used, at = np.unique(buckets, return_inverse=True)
    at = at.reshape(buckets.shape)
    x = np.zeros(len(used) + 4)
    toxic = float(max(1, (labels == 1).sum()))
    x[-4] = np.log(toxic / max(1.0, (labels == 0).sum()))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    flat = at.ravel()
    for step in range(1, steps + 1):
        unary = x[at].sum(1) + x[-4]
        p, pairs = marginals(unary, begins, x[-3:])
        gap = np.where(known, p - labels, 0.0)
        gradient = np.empty_like(x)
        gradient[:-4] = np.bincount(flat, np.repeat(gap, buckets.shape[1]), len(used))
        gradient[-4] = gap.sum()
        gradient[-3:] = pairs[inner].sum(0) - wanted
        # by the number of toxic words, so that rare ones are heard
        gradient = gradient / toxic + ridge * x
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        x -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(_BUCKETS)
    weights[used] = x[:-4]
    return Model(weights, float(x[-4]), x[-3:], np.zeros(4))


def aggregates(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, from its words' marginals: logit of the greatest, logs of sum and mean, and 1."""
    size = np.diff(starts)
    full = size > 0
    greatest, total = np.full(len(size), _LEAST), np.full(len(size), _LEAST)
    greatest[full] = np.clip(np.maximum.reduceat(p, starts[:-1][full]), _LEAST, 1 - _LEAST)
    total[full] = np.maximum(np.add.reduceat(p, starts[:-1][full]), _LEAST)
    return np.column_stack([np.log(greatest / (1 - greatest)), np.log(total), np.log(total / np.maximum(size, 1)), np.ones(len(size))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; none below 0 but the constant's, as no toxic word makes a text cleaner."""
    w, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        w[:] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            held = x[:, free]
            hessian = (held * (p * (1 - p))[:, None]).T @ held / len(y) + ridge / 10 * np.eye(held.shape[1])
            move = np.linalg.solve(hessian, held.T @ (p - y) / len(y) + ridge / 10 * w[free])
            w[free] -= np.clip(move, -1, 1)
        bad = w[:-1] < 0
        if not bad.any():
            break
        free[:-1] &= ~bad
    return w


def learnt(buckets: np.ndarray, begins: np.ndarray, rows: np.ndarray, toxic: np.ndarray, words: int = FIT_WORDS) -> Model:
    """A model from the words of labelled texts: ``rows`` has each word's text, in order."""
    labels = label_words(buckets, rows, toxic)
    cost = np.where(toxic[rows], 0, 1)
    use = (cost == 0) | (np.cumsum(cost) <= words)
    model = fit(buckets[use], begins[use], labels[use])
    p, _ = marginals(model.weights[buckets].sum(1) + model.bias, begins, model.steps)
    starts = np.searchsorted(rows, np.arange(len(toxic) + 1))
    model.texts = logistic(aggregates(p, starts), toxic.astype(float))
    return model


def _flat(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts its bytes and rows' offsets, the bounds of its words, and where each row's words begin."""
    for _, data, off in _words.spans(texts):
        first, last = _words.bounds(data, off, _words.LETTER)
        yield data, off, first, last, np.searchsorted(first, off, "left")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, n_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model for ``labels(doc_id, toxic)``; None if they aren't of both kinds."""
    rated = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("rated_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id"))
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    # ``rows`` rows at most go through this one window
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    texts = texts.withColumn("so_far", so_far).where(F.col("so_far") <= n_bytes).drop("so_far")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, begins, of, toxic = [], [], [], []
        for batch in batches:
            toxic += [x == 1 for x in batch.column(1).to_pylist()]
            done = len(toxic) - batch.num_rows
            for data, _, first, last, starts in _flat(batch.column(2)):
                if len(first):
                    buckets.append(features(data, first, last))
                    mark = np.zeros(len(first), bool)
                    mark[starts[:-1][starts[:-1] < starts[1:]]] = True
                    begins.append(mark)
                    of.append(done + np.repeat(np.arange(len(starts) - 1), np.diff(starts)))
                done += len(starts) - 1
        if not any(toxic) or all(toxic) or not buckets:
            return
        model = learnt(np.concatenate(buckets), np.concatenate(begins), np.concatenate(of), np.array(toxic))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32)], pa.list_(pa.float32())), pa.array([[model.bias, *model.steps, *model.texts]], pa.list_(pa.float64()))], ["weights", "others"])

    got = texts.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "weights array<float>, others array<double>").toArrow()
    if not got.num_rows:
        return None
    weights, others = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("weights", "others"))
    return Model(weights, float(others[0]), others[1:4], others[4:])


def tag(texts: pa.Array, model: Model, least: float = TOXIC) -> pa.Array:
    """Score and spans of each text."""
    scores, counts, starts, ends, sure = [], [], [], [], []
    for data, off, first, last, begin in _flat(texts):
        rows = len(off) - 1
        spans = np.zeros(rows, np.int64)
        p = np.zeros(0)
        if len(first):
            mark = np.zeros(len(first), bool)
            mark[begin[:-1][begin[:-1] < begin[1:]]] = True
            unary = model.weights[features(data, first, last)].sum(1, dtype=np.float64) + model.bias
            p, _ = marginals(unary, mark, model.steps)
            bad = p >= least
            opens = np.flatnonzero(bad & (mark | ~np.append(False, bad[:-1])))
            if len(opens):
                closes = np.flatnonzero(bad & np.append(mark[1:] | ~bad[1:], True))
                letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
                row = np.searchsorted(off, first[opens], "right") - 1
                base = letters[off[row]]
                starts.append(letters[first[opens]] - base)
                ends.append(letters[last[closes]] - base)
                sure += [p[a : b + 1].max() for a, b in zip(opens.tolist(), closes.tolist(), strict=True)]
                spans = np.bincount(row, minlength=rows)
        scores.append(1 / (1 + np.exp(-np.clip(aggregates(p, begin) @ model.texts, -30, 30))))
        counts.append(spans)
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, ends)]
    kinds = [pa.field("start", pa.int64()), pa.field("end", pa.int64()), pa.field("probability", pa.float64())]
    held = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(sure, pa.float64())], fields=kinds)
    size = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *scores])), pa.ListArray.from_arrays(pa.array(size), held)], ["score", "spans"])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, with a struct ``FOUND``: score and spans of toxic words."""
    kind = "struct<score:double,spans:array<struct<start:bigint,end:bigint,probability:double>>>"
    model = train(docs, labels)
    if model is None:
        return docs.withColumn(FOUND, F.struct(F.lit(0.0).alias("score"), F.array().alias("spans")).cast(kind))
    held = spark.sparkContext.broadcast((model.weights, model.bias, model.steps, model.texts))

    def work(texts: pa.Array) -> pa.Array:
        return tag(texts, Model(*held.value))

    return docs.withColumn(FOUND, F.arrow_udf(work, kind)(F.col("text").cast("string")))
