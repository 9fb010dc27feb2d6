r"""Phrase collocation mining: phrases of 2 to ``longest`` words that stand together more often than their parts alone.

First pass: each task counts its phrases of 1 to ``longest`` words in a count-min sketch and ships what it has, cell by cell, in
blocks; equal blocks are added up, so the merged sketch is the sketch of all texts. A cell counts all phrases that fall into
it, so it overestimates. Only one bit of it is needed, whether it reaches ``least``. Second pass: phrases whose cells, and those of all phrases
within them, reach ``least`` are the survivors. They are counted exactly, by their words, first in the task and then
over all. A phrase of ``least`` occurrences or more always survives, so nothing frequent is lost; a survivor that is rarer goes by its exact count.

The sketch has ``DEPTH`` rows of a width that grows with the bytes of text, up to 2**``MOST_BITS`` cells, whose bits take 64 MB in each
worker. Beyond about 4 GB of text the width stays and more rare phrases survive to be counted exactly: the second pass then shuffles
more, up to all phrases of each task, and the result is the same.

Scores: a phrase with a occurrences is cut after its first k words into parts with l and r occurrences; its score is the least of
floor(2000000 * a / (l + r)) over all cuts. A candidate whose words lie inside a longer candidate with ``inside`` percent
of its occurrences or more is dropped, whether or not that one is dropped itself.

A-Z are lower-cased, ``[.,;:!?\x0A-\x0D]`` end pieces, words are ``[^\x20\x09]+`` in them. Everything is per language, null being
``und``. Null and empty texts have no words; repeated rows count each time; an empty table gives no phrases. Ids and further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm import _words
from tallystone.llm._shared import Scratch

LEAST, LONGEST, INSIDE, TOP = 30, 4, 80, 2000
DEPTH, LEAST_BITS, MOST_BITS = 2, 16, 28
#: Bytes of text for each cell of a row of the sketch.
BYTES_A_CELL = 16
#: Bytes of text that one task of the second pass counts at most, where there are more tasks than two for each core.
TASK_BYTES = 1 << 30
#: Cells of a block of the sketch, phrases whose cells a task holds before it ships them, and phrases that wait to be added up and that it holds added up.
BLOCK, BUFFER, WAITING, HELD = 1 << 16, 1 << 21, 400_000, 1_500_000

_U = np.uint64
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_END
_WORD[[9, 32]] = False


def width_bits(n_bytes: int) -> int:
    """The sketch's width for so many bytes of text, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (n_bytes // BYTES_A_CELL).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * _U(_ROWS[row])) >> _U(64 - bits)).astype(np.uint32)


class Chunk:
    """The words of some texts with the hashes of their phrases."""

    def __init__(self, data: np.ndarray, off: np.ndarray, own: np.ndarray, seeds: np.ndarray, longest: int):
        self.data, self.seeds, self.longest = data, seeds, longest
        self.first, self.last = _words.bounds(data, off, _WORD)
        n = len(self.first)
        self.row = np.searchsorted(off, self.first, "right") - 1
        self.words = _words.span_hashes(_words.sums(data), self.first, self.last) if n else np.zeros(0, np.uint64)
        self.langs = seeds[own][self.row] if n else np.zeros(0, np.uint64)
        # a piece goes on to the next word if no mark and no end of a row lies between
        marks = np.append(0, np.cumsum(_END[data]))
        self.joined = (marks[self.first[1:]] == marks[self.last[:-1]]) & (self.row[1:] == self.row[:-1]) if n else np.zeros(0, bool)

    def places(self) -> Iterator[np.ndarray]:
        """For 1, 2, ... words the first words of all phrases."""
        whole = np.ones(len(self.first), bool)
        for n in range(1, self.longest + 1):
            if n > 1:
                whole = whole[:-1] & self.joined[n - 2 :] if len(whole) else whole
            yield np.flatnonzero(whole)

    def keys(self, n: int) -> np.ndarray:
        """64-bit keys of the runs of n words from each word on."""
        runs = _words._runs(self.words, n)
        return _words.mix(runs ^ self.langs[: len(runs)])

    def twins(self) -> np.ndarray:
        """Second hashes of the words, by another table of bytes."""
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_words.mix(_words._BYTE[self.data]) * _words._power(len(self.data))[0], out=total[1:])
        return _words.span_hashes(total, self.first, self.last)


def _chunks(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[Chunk, np.ndarray, list[str]]]:
    """Chunks of a batch (lang, text), with each row's language, as an index of a list."""
    found = batch.column(0).dictionary_encode()
    names = found.dictionary.to_pylist()
    seeds = np.array([zlib.crc32(x.encode()) | (zlib.adler32(x.encode()) << 32) for x in names], np.uint64)
    index = found.indices.to_numpy()
    for at, data, off in _words.spans(batch.column(1)):
        own = index[at : at + len(off) - 1]
        yield Chunk(data, off, own, seeds, longest), own, names


def _sketch(bits: int, longest: int, least: int):
    """A task's share of the sketch: rows (slot, offsets, counts), a slot for each block of each row of cells."""
    kind = _count_type(least)

    def ship(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        slots, offsets, counts = [], [], []
        for row in range(DEPTH):
            held = np.sort(cells(keys, row, bits))
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            n = np.minimum(np.diff(np.append(first, len(held))), least).astype(kind)
            held = held[first]
            block = held >> 16
            begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(held)).tolist(), strict=True):
                slots.append((row << 16) | int(block[a]))
                offsets.append(held[a:b].astype(np.uint16).tobytes())
                counts.append(n[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(offsets, pa.binary()), pa.array(counts, pa.binary())], ["slot", "offsets", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for chunk, _, _ in _chunks(batch, longest):
                for n, at in enumerate(chunk.places(), 1):
                    held.append(chunk.keys(n)[at])
                    size += len(at)
                if size >= BUFFER:
                    yield from ship(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from ship(np.concatenate(held))

    return run


def _count_type(least: int) -> type:
    """What holds a cell's count; it stays at ``least`` once it is there."""
    return np.uint8 if least < 256 else np.uint32


def _merge(least: int):
    """Adds up the blocks of each slot and tells which cells reach ``least``; a partition holds its own slots only."""
    kind = _count_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, offsets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot not in held:
                    held[slot] = np.zeros(BLOCK, kind)
                at = np.frombuffer(offsets, np.uint16)
                held[slot][at] = np.minimum(held[slot][at].astype(np.int64) + np.frombuffer(counts, kind), least)
        slots = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([np.packbits(held[s] >= least, bitorder="little").tobytes() for s in slots], pa.binary())], ["slot", "bits"])

    return run


def _survivors(sketch, bits: int, longest: int):
    """Exact counts, within a task, of the phrases that the sketch lets through: (lang, phrase, words, n); without a phrase all words of a language."""

    def phrases(keys: np.ndarray, twins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First places, counts, keys and second hashes of the phrases of one length; phrases of one key that differ in the second hash are counted apart."""
        order = np.argsort(keys, kind="stable")
        held, other = keys[order], twins[order]
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        size = np.diff(np.append(first, len(held)))
        alien = other != np.repeat(other[first], size)
        count = size - np.add.reduceat(alien.astype(np.int64), first)
        apart = order[alien]
        chosen = np.concatenate([order[first], apart])
        return at[chosen], np.concatenate([count, np.ones(len(apart), np.int64)]), keys[chosen], twins[chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(b, np.uint8) for b in sketch.value]

        def reaches(keys: np.ndarray) -> np.ndarray:
            out = np.ones(len(keys), bool)
            for row, held in enumerate(rows):
                cell = cells(keys, row, bits)
                out &= (held[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            return out

        waiting: list[Counted] = []
        size = 0
        for batch in batches:
            for chunk, own, names in _chunks(batch, longest):
                if not len(chunk.first):
                    continue
                # words as strings, lower-cased, from their bytes
                low = chunk.data.copy()
                low[(low >= 65) & (low <= 90)] += 32
                length = chunk.last - chunk.first
                ends = np.cumsum(length)
                taken = low[np.arange(ends[-1]) + np.repeat(chunk.first - (ends - length), length)]
                words = pa.StringArray.from_buffers(len(length), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes()))
                second = chunk.twins()
                lang = own[chunk.row]
                alive: np.ndarray | None = None
                tables = [Counted(chunk.seeds, ~chunk.seeds, np.bincount(lang, minlength=len(names)), np.zeros(len(names), np.int32), pa.array(names, pa.string()), pa.nulls(len(names), pa.string()))]
                for n, at in enumerate(chunk.places(), 1):
                    if alive is not None:  # both phrases of one word less must have come through
                        at = at[alive[at] & alive[at + 1]]
                    keys = chunk.keys(n)[at]
                    through = reaches(keys)
                    at, keys = at[through], keys[through]
                    alive = np.zeros(len(chunk.first) + 1, bool)
                    alive[at] = True
                    if not len(at):
                        break
                    twins = _words._runs(second, n)[at] ^ chunk.langs[at]
                    where, count, key, twin = phrases(keys, twins, at)
                    parts = [words.take(pa.array(where + k)) for k in range(n)]
                    text = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                    tables.append(Counted(key, twin, count, np.full(len(where), n, np.int32), pa.array(names, pa.string()).take(pa.array(lang[where])), text))
                waiting += tables
                size += sum(len(t.n) for t in tables)
                if size >= WAITING:
                    waiting, size = [_added(waiting)], 0
                    if len(waiting[0].n) >= HELD:
                        yield from _shipped(waiting)
        if waiting:
            waiting = [_added(waiting)]
            yield from _shipped(waiting)

    return run


@dataclass
class Counted:
    """Phrases with their counts; ``key`` and ``twin`` together, 128 bits, tell them apart within a task."""

    key: np.ndarray
    twin: np.ndarray
    n: np.ndarray
    words: np.ndarray
    lang: pa.Array
    phrase: pa.Array


def _added(tables: list[Counted]) -> Counted:
    """One table of several, which leave the list, with equal phrases added up; sorted by number, which takes less memory than by text."""
    key, twin, n, words = (np.concatenate([getattr(t, c) for t in tables]) for c in ("key", "twin", "n", "words"))
    lang, phrase = (pa.concat_arrays([getattr(t, c) for t in tables]) for c in ("lang", "phrase"))
    tables.clear()
    order = np.lexsort((twin, key))
    held, other = key[order], twin[order]
    first = np.flatnonzero(np.append(True, (held[1:] != held[:-1]) | (other[1:] != other[:-1])))
    at = order[first]
    out = Counted(key[at], twin[at], np.add.reduceat(n[order], first), words[at], lang.take(pa.array(at)), phrase.take(pa.array(at)))
    del lang, phrase
    pa.default_memory_pool().release_unused()
    return out


def _shipped(tables: list[Counted]) -> Iterator[pa.RecordBatch]:
    """The rows of one table, which leaves the list, in small batches, as Spark holds a batch beside its heap."""
    t = tables.pop()
    yield from pa.table({"lang": t.lang, "phrase": t.phrase, "words": pa.array(t.words), "n": pa.array(t.n)}).to_batches(max_chunksize=20_000)


def frequent(spark: SparkSession, scratch: Scratch, docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n): exact counts of all phrases of ``least`` occurrences or more, and, without a phrase, of all words of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width_bits(n_bytes)
    shares = texts.mapInArrow(_sketch(bits, longest, least), "slot int, offsets binary, counts binary")
    merged = shares.repartition("slot").mapInArrow(_merge(least), "slot int, bits binary")
    rows = [bytearray(1 << (bits - 3)) for _ in range(DEPTH)]
    found = merged.toArrow()  # DEPTH rows of 2**MOST_BITS bits at most
    for slot, held in zip(found.column("slot").to_pylist(), found.column("bits").to_pylist(), strict=True):
        at = (slot & 0xFFFF) * (BLOCK // 8)
        rows[slot >> 16][at : at + len(held)] = held
    sketch = spark.sparkContext.broadcast([bytes(r) for r in rows])
    # frequent phrases stand in nearly every task's texts: the more a task adds up, the less is shuffled
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    counted = texts.coalesce(tasks).mapInArrow(_survivors(sketch, bits, longest), "lang string, phrase string, words int, n bigint")
    exact = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
    return scratch.keep(exact, "frequent")


def mine(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations, best first."""
    scratch = Scratch(spark, "collocations")
    counts = frequent(spark, scratch, docs, least, longest)
    total = counts.where("phrase is null and n > 0").select("lang", "n")
    phrases = counts.where("phrase is not null").select("lang", "phrase", "words", F.col("n").alias("a"))
    candidates = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))

    # parts are at least as frequent as the whole, so they have been counted too
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    # exact beyond 64 bits
    cut = cut.withColumn("score", F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")

    size = F.size("w")
    places = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(places)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left")
    wide = "decimal(20,0)"
    swallowed = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast(wide) >= F.lit(inside).cast("decimal(3,0)") * F.col("a").cast(wide)
    kept = kept.where(~F.coalesce(swallowed, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

