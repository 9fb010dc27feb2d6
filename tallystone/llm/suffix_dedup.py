r"""Repeated passages by sparse suffix arrays.

A passage of ``least`` words or more that stands in two different texts is found, to its full length. Words are runs
of ``[^\x20\x09-\x0D]``, A-Z lower-cased.

Suffixes are kept only at minimisers: of every ``least - GRAM + 1`` consecutive runs of ``GRAM`` words the one with the
least hash (of equal ones the last). A shared passage has the same runs in both texts, so it has a minimiser in common.
1. Kept suffixes whose first ``GRAM`` words no other text has at a kept place go; the others get their words back: to the left as far
   as windows of ``least`` words begin that have this minimiser, to the right to the end of the last of these windows.
2. They are dealt to tasks by ranges of the hash of those first words and sorted there by their words. The common prefix of neighbours
   in this order says how far each agrees to the right with any other.
3. To the left they are extended word by word: after i words those that agree in all of them and, by the order of step 2, in
   ``least - i`` words to the right are one window of ``least`` words. It counts if two texts have it. Words are compared one by one, by
   hashes of 64 bits each, so that other windows can't pass for equal ones by a hash of the whole.
4. Windows that follow one another through a text make up its passages.

A run of first words that more than ``GROUP`` suffixes have is hot, and its suffixes are not brought together: its windows are counted on each
executor first, by hashes of 128 bits, as a least and a greatest text, and joined back from tables in storage, which adaptive
execution splits. So no task gets a common passage whole, and no pairs arise. Texts are read again only where step 1 left something.

Equal texts are one text of several documents: all their words repeat, if they are ``least`` at least, and it is
searched once. Repeats inside one text don't count. Null and empty texts have none. Rows with equal id and text are one
document. Null ids count as documents and have rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm import _words as words
from tallystone.llm._shared import Scratch, rekeyed, told_apart

LEAST, GRAM = 50, 8
#: Suffixes of one run that are compared in one task (in some seconds and 200 MB), and suffixes that a task takes at a time.
GROUP, CHUNK = 1 << 16, 1 << 15
_POSITION = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray, begins: np.ndarray, least: int, gram: int) -> np.ndarray:
    """For each window of ``least`` words of a chunk that lies in one row, by its first word: the place of its
    minimiser among the chunk's words; -1 for other places."""
    width = least - gram + 1
    out = np.full(len(hashes), -1, np.int64)
    if len(hashes) < least:
        return out
    runs = words._runs(hashes, gram)
    place = np.arange(len(runs), dtype=np.uint64)
    low = (runs & ~_POSITION) | (_POSITION - (place & _POSITION))  # the last of equal ones is the least
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    first = np.arange(len(low))
    row = np.searchsorted(begins, first, "right")
    inside = first + least <= begins[np.minimum(row, len(begins) - 1)]
    at = (_POSITION - (low & _POSITION)).astype(np.int64)
    at += (first - at + int(_POSITION)) // (int(_POSITION) + 1) * (int(_POSITION) + 1)  # places beyond 24 bits
    out[: len(low)][inside] = at[inside]
    return out


def _kept(least: int, gram: int):
    """Per text: its words, and the keys and places of its kept suffixes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts, keys, places = [], [], []
            for _, data, off in words.spans(batch.column(3)):
                hashes, begins = words.word_hashes(data, off)
                found = minimisers(hashes, begins, least, gram)
                runs = words._runs(hashes, gram)
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    at = words.distinct(found[a:b])
                    at = at[at >= 0]
                    counts.append(b - a)
                    keys.append(runs[at])
                    places.append((at - a).astype(np.int32))
            size = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(x) if x else np.zeros(0, kind)).cast(to)) for x, kind, to in ((([k.view(np.int64) for k in keys]), np.int64, pa.int64()), (places, np.int32, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), *columns], ["doc_id", "mark", "twin", "n_words", "keys", "places"])

    return run


def _ranges(flat: np.ndarray, first: np.ndarray, size: np.ndarray, step: int = 1) -> pa.ListArray:
    """Lists flat[first], flat[first + step], ... of the given sizes."""
    off = np.append(0, np.cumsum(size))
    at = np.repeat(first, size) + step * (np.arange(off[-1]) - np.repeat(off[:-1], size))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat[at].view(np.int64)))


def _contexts(least: int, gram: int):
    """Wanted suffixes with their words: (mark, lo, hi, start, key, hot, left, right); of hot ones two hashes of each window instead."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            off_places, places = batch.column(2).offsets.to_numpy(), batch.column(2).values
            place, hot = (places.field(k).to_numpy(zero_copy_only=False) for k in ("place", "hot"))
            for row, data, off in words.spans(batch.column(1)):
                hashes, begins = words.word_hashes(data, off)
                found = minimisers(hashes, begins, least, gram)
                part = slice(off_places[row], off_places[row + len(off) - 1])
                wanted = place[part] + np.repeat(begins[:-1], np.diff(off_places[row : row + len(off)]))
                is_hot = np.zeros(len(hashes), bool)
                is_hot[wanted[hot[part]]] = True
                keep = np.zeros(len(hashes) + 1, bool)
                keep[wanted] = True
                starts = np.flatnonzero(keep[found])  # -1 finds the last, which is never wanted
                if not len(starts):
                    continue
                at = found[starts]
                new = np.append(True, at[1:] != at[:-1])
                first, at = starts[new], at[new]
                last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
                owner = np.searchsorted(begins, at, "right") - 1
                runs = words._runs(hashes, gram)
                twins = [words._runs(h, least) for h in (hashes, words.mix(hashes + np.uint64(1)))] if is_hot.any() else []
                for common in (False, True):
                    mine = np.flatnonzero(is_hot[at] == common)
                    if not len(mine):
                        continue
                    f, l, p, o = first[mine], last[mine], at[mine], owner[mine]
                    facts = [batch.column(k).take(pa.array(o + row)) for k in (0, 3, 4)]
                    lists = [_ranges(x, f, l - f + 1) for x in twins] if common else [_ranges(hashes, p - 1, p - f, -1), _ranges(hashes, p, l + least - p)]
                    columns = [*facts, pa.array((f - begins[o]).astype(np.int32)), pa.array(runs[p].view(np.int64)), pa.array(np.full(len(mine), common)), *lists]
                    yield pa.RecordBatch.from_arrays(columns, ["mark", "lo", "hi", "start", "key", "hot", "left", "right"])

    return run


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows, filled up with 0, and their lengths."""
    off, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(off)
    out = np.zeros((len(size), max(1, size.max(initial=0))), np.int64)
    inside = np.arange(out.shape[1])[None, :] < size[:, None]
    out[inside] = flat[off[0] : off[-1]]
    return out, size


def repeated(table: pa.Table, least: int) -> pa.RecordBatch:
    """Runs of windows that two texts have: (mark, first, last, lo, hi), of suffixes (mark, lo, hi, start, key, left, right) sorted by key and right."""
    table = table.combine_chunks()
    get = lambda c: table.column(c).chunk(0)
    mark, start, key = (get(c).to_numpy() for c in ("mark", "start", "key"))
    ids = [get(c).fill_null(x).to_numpy() for c, x in (("lo", np.iinfo(np.int64).max), ("hi", np.iinfo(np.int64).min))]
    (left, before), (right, after) = _matrix(get("left")), _matrix(get("right"))
    m = len(mark)
    same = (right[1:] == right[:-1]) & (np.arange(right.shape[1])[None, :] < np.minimum(after[1:], after[:-1])[:, None])
    prefix = np.append(0, np.where(key[1:] == key[:-1], np.logical_and.accumulate(same, axis=1).sum(1), 0))  # of neighbours
    windows = before + after - least + 1
    twice = np.zeros((m, windows.max() + 1), bool)
    bounds = [np.zeros(twice.shape, np.int64) for _ in ids]
    alike = np.cumsum(np.append(0, key[1:] != key[:-1]))  # those that agree in i words to the left
    live = np.arange(m)
    for i in range(before.max() + 1):
        if i:
            live = live[before[live] >= i]
            word = left[live, i - 1]
            order = np.lexsort((word, alike[live]))
            a, w = alike[live][order], word[order]
            new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))[: len(order)]
            live = live[order]
            alike[live] = np.cumsum(new)
            some = ~(new & np.append(new[1:], True)[: len(order)])
            live = live[some]  # who has no like has no window in common from here on
        here = live[i >= before[live] - windows[live] + 1]
        if not len(here):
            if not len(live):
                break
            continue
        to_right = np.cumsum(prefix < least - i)
        code = alike[here] * (m + 1) + to_right[here]
        order = np.argsort(code, kind="stable")
        here, code = here[order], code[order]
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        size = np.diff(np.append(begin, len(code)))
        two = np.repeat(np.minimum.reduceat(mark[here], begin) != np.maximum.reduceat(mark[here], begin), size)
        at = before[here] - i
        twice[here[two], at[two]] = True
        for held, x, least_or_most in zip(bounds, ids, (np.minimum, np.maximum), strict=True):
            held[here[two], at[two]] = np.repeat(least_or_most.reduceat(x[here], begin), size)[two]
    edge = np.zeros((m, 1), bool)
    row, begin = np.nonzero(twice & ~np.hstack([edge, twice[:, :-1]]))
    _, end = np.nonzero(twice & ~np.hstack([twice[:, 1:], edge]))
    lo, hi = (x[row, begin] for x in bounds)
    none = lo > hi  # no text of these has an id
    columns = [pa.array(mark[row]), pa.array((start[row] + begin).astype(np.int32)), pa.array((start[row] + end).astype(np.int32)), pa.array(lo, mask=none), pa.array(hi, mask=none)]
    return pa.RecordBatch.from_arrays(columns, ["mark", "first", "last", "lo", "hi"])


def _compared(least: int, chunk: int):
    """``repeated`` of a task's sorted suffixes, as many at a time as ``chunk`` and a run hold."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in rows:
            held.append(batch)
            n += batch.num_rows
            if n < chunk:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield repeated(table.slice(0, cut), least)
            held, n = table.slice(cut).to_batches(), len(key) - cut
        if n:
            yield repeated(pa.Table.from_batches(held), least)

    return run


def passages(spark: SparkSession, docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, first_word, n_words, other_doc_id): each longest stretch of words covered by repeated windows.

    ``first_word`` counts from 0; ``other_doc_id`` is the least id of the documents that hold the stretch's first window, in
    that document's own row the greatest. Documents without repeated passages have no row.
    """
    scratch = Scratch(spark, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(1), "text").alias("twin"), "text")
    kept = scratch.keep(marked.mapInArrow(_kept(least, gram), "doc_id long, mark long, twin long, n_words long, keys array<long>, places array<int>"), "kept")
    kept = told_apart(scratch, kept, "mark", "twin")

    holders = kept.where(F.col("n_words") >= least).select("mark", "n_words", "doc_id").distinct()
    texts = holders.groupBy("mark").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n_words").alias("n_words"))
    texts = scratch.keep(texts, "texts")
    suffixes = kept.where(F.size("keys") > 0).dropDuplicates(["mark"]).select("mark", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("mark", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    shared = suffixes.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    shared = scratch.keep(shared.select("key", (F.col("n") > GROUP).alias("hot")), "shared")
    wanted = suffixes.join(scratch.small(shared, "shared"), "key").groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("place", "hot"))).alias("places"))
    wanted = wanted.join(texts.select("mark", F.col("least").alias("lo"), F.col("most").alias("hi")), "mark").select(F.col("mark").alias("m"), "lo", "hi", "places")
    wanted = scratch.keep(wanted, "wanted")
    of_text = (F.col("mark") == F.col("m")) | (rekeyed("mark", "twin") == F.col("m"))
    again = marked.join(scratch.small(wanted, "wanted"), F.col("doc_id").eqNullSafe(F.col("lo")) & of_text).select(F.col("m").alias("mark"), "text", "places", "lo", "hi")
    found = again.mapInArrow(_contexts(least, gram), "mark long, lo long, hi long, start int, key long, hot boolean, left array<long>, right array<long>")
    found = scratch.keep(found, "contexts")
    ordered = found.where("not hot").drop("hot").repartitionByRange("key").sortWithinPartitions("key", "right")
    runs = ordered.mapInArrow(_compared(least, CHUNK), "mark long, first int, last int, lo long, hi long")

    windows = found.where("hot").select("mark", "lo", "hi", "start", F.posexplode(F.arrays_zip("left", "right")).alias("at", "w"))
    windows = windows.select("mark", "lo", "hi", (F.col("start") + F.col("at")).alias("start"), F.col("w.left").alias("w1"), F.col("w.right").alias("w2"))
    both = windows.groupBy("w1", "w2").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("a <> b").select("w1", "w2", "lo", "hi")
    both = scratch.small(scratch.keep(both, "both"), "both")
    common = windows.drop("lo", "hi").join(both, ["w1", "w2"]).select("mark", F.col("start").alias("first"), F.col("start").alias("last"), "lo", "hi")
    # a text whose document has repeated rows was read as often
    met = scratch.keep(runs.union(common).repartition("mark").distinct(), "met")

    copied = texts.where("docs > 1")
    # windows that overlap or touch make one stretch
    own = Window.partitionBy("mark").orderBy("first")
    fresh = (F.col("first") > F.lag("last", 1, -least - 1).over(own) + least).cast("int")
    spans = met.join(copied.select("mark"), "mark", "left_anti").withColumn("at", F.sum(fresh).over(own))
    spans = spans.groupBy("mark", "at").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("first", "lo", "hi")).alias("f"))
    spans = spans.select("mark", "first", (F.col("last") + least - F.col("first")).alias("n"), "f.lo", "f.hi")
    begin = met.where("first = 0").select("mark", F.col("lo").alias("l"), F.col("hi").alias("h"))
    whole = copied.join(begin, "mark", "left").select("mark", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("n"), F.coalesce("l", "least").alias("lo"), F.coalesce("h", "most").alias("hi"))
    found = scratch.keep(spans.union(whole), "found")
    scratch.clear("kept", "shared-keys", "found")
    rows = kept.where(F.col("n_words") >= least).select("mark", "doc_id").distinct().join(found, "mark")
    other = F.when(F.col("doc_id").eqNullSafe(F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    return rows.select("doc_id", F.col("first").cast("long").alias("first_word"), F.col("n").cast("long").alias("n_words"), other.alias("other_doc_id"))
