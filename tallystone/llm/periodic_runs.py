r"""Periodic run detection: all maximal periodic stretches of a text's words, by Lyndon words under both orders.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that no
neighbouring word extends keeping period q. The longest Lyndon word at a position ends where the next smaller suffix begins; a stack
scanned from right to left gives it, once for the order of the words' numbers and once for the reverse. Every run has a root
among these words, so each is held against the word after it and extended to both sides. Suffixes are compared by their longest
common extension: binary search over rolling hashes, whose answer is held against the words themselves.

Before that, hashes of short windows narrow each text: the windows of a run recur one period later, so words where no window recurs
soon enough hold no run. That is a necessary condition, and hashes can only let more through; all that is left
goes through the stack. Texts are worked on one by one in Arrow batches, without a shuffle; memory follows the longest text.

Words are runs ``[^\x20\x09-\x0D]+``, by their bytes. A null, empty or blank text has no words, no runs and an empty collapsed text.
Repeated rows give repeated results, null ids are no matter, an empty table gives an empty one; further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm import _words

LEAST, TIMES = 24, 3
#: The column of results: every run by start and period, the index of the one with most periods (null: none), and the text without repeats.
FOUND = "__tallystone_runs"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_MASK, _BASE = (1 << 64) - 1, 0x2545F4914F6CDD1D


class Extensions:
    """Longest common extensions of a list of numbers, to the right and to the left."""

    def __init__(self, s: list[int]):
        self.s, self.n = s, len(s)
        self.bytes = np.array(s, np.int32).tobytes()
        # from a numpy array to Python numbers once: the search works on single values
        powers = np.full(self.n + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_words.mix(np.array(s, np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
        self.power, self.total = powers.tolist(), total.tolist()

    def same(self, i: int, j: int, length: int) -> bool:
        """Whether the stretches at i <= j have equal hashes."""
        t = self.total
        return ((t[i + length] - t[i]) * self.power[j - i] - t[j + length] + t[j]) & _MASK == 0

    def equal(self, i: int, j: int, length: int) -> bool:
        return self.bytes[4 * i : 4 * (i + length)] == self.bytes[4 * j : 4 * (j + length)]

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        most = self.n - j
        low, step = 0, 8  # equal so far; growing steps, then halves
        while low < most:
            reach = min(step, most - low)
            if not self.same(i + low, j + low, reach):
                break
            low, step = low + reach, 2 * step
        high = min(low + step, most)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i + low, j + low, middle - low):
                low = middle
            else:
                high = middle - 1
        if self.equal(i, j, low):
            return low
        a, b = (np.frombuffer(self.bytes, np.int32, low, 4 * k) for k in (i, j))  # equal hashes of different words
        return int(np.flatnonzero(a != b)[0])

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        low, high = 0, i
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        if self.equal(i - low, j - low, low):
            return low
        a, b = (np.frombuffer(self.bytes, np.int32, low, 4 * (k - low)) for k in (i, j))
        return low - 1 - int(np.flatnonzero(a != b)[-1])


def find_runs(s: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a list of numbers, sorted by start and period."""
    n, found = len(s), set()
    ext = Extensions(s)
    for order in (1, -1):
        after = [n] * n  # the stack: from each position to the next smaller suffix
        for i in range(n - 1, -1, -1):
            j, first = i + 1, s[i]
            common = 0
            while j < n:
                other = s[j]
                if first != other:
                    common = 0
                    smaller = (other - first) * order < 0
                else:
                    common = ext.right(i, j)
                    # of two suffixes that agree to the end the shorter is the smaller
                    smaller = j + common == n or (s[j + common] - s[i + common]) * order < 0
                if smaller:
                    break
                j = after[j]
            after[i] = j
            period = j - i
            # one of a run's first ``period`` positions has its root, with all further periods to the right of it
            if j == n or common <= (times - 2) * period or (i >= period and ext.same(i - period, i, period) and ext.equal(i - period, i, period)):
                continue
            before = ext.left(i, j)
            length = before + period + common
            if before < period and length >= max(least, times * period):
                found.add((i - before, length, period))
    return sorted(found)


def _window(least: int, times: int) -> int:
    """The longest window that every run has at least once more, a period later."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _spread(least: int, times: int, window: int, most: int) -> np.ndarray:
    """For q = 0, 1, ...: how many windows in a row recur within q words, at least, in a run with period q or more."""
    q = np.arange(most + 1)
    need = np.maximum(least, times * q) - q - window + 1
    need[0] = need[1] if most else 1
    return np.minimum.accumulate(need[::-1])[::-1]


def narrow(windows: np.ndarray, window: int, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words, first and after the last, that can hold runs; ``windows`` are the hashes of all windows of one text."""
    n = len(windows)
    if not n:
        return []
    order = np.argsort(windows, kind="stable")
    held = windows[order]
    gap = np.zeros(n, np.int64)  # words to the next equal window; 0: none
    again = held[1:] == held[:-1]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    some = gap > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], some, [False]])))
    if not len(edges):
        return []
    first, last = edges[::2], edges[1::2]
    nearest = np.minimum.reduceat(np.append(gap, n), np.ravel(np.column_stack([first, last])))[::2]
    need = _spread(least, times, window, n)
    out: list[tuple[int, int]] = []
    for a, b, q in zip(first.tolist(), last.tolist(), nearest.tolist(), strict=True):
        size = b - a
        if size >= need[q]:
            longest = int(np.searchsorted(need, size, "right")) - 1  # periods beyond need more windows in a row
            end = min(n + window - 1, b + window - 1 + longest)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((a, end))
    return out


def describe(words: list[bytes], stretches: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], int | None, list[bytes]]:
    """Runs of a text, the index of the one with most periods, and the words that no run drops."""
    runs: list[tuple[int, int, int]] = []
    for a, b in stretches:
        number: dict[bytes, int] = {}
        runs += [(a + start, length, period) for start, length, period in find_runs([number.setdefault(w, len(number)) for w in words[a:b]], least, times)]
    if not runs:
        return runs, None, words
    best, drop = 0, np.zeros(len(words), bool)
    for k, (start, length, period) in enumerate(runs):
        drop[start + period : start + length] = True
        if length * runs[best][2] > runs[best][1] * period:
            best = k
    return runs, best, [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents, all columns, with a struct ``FOUND``: n_words, runs, strongest, collapsed."""
    if times < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    window = _window(least, times)

    def work(texts: pa.Array) -> pa.Array:
        sizes, counts, flat, strongest, collapsed = [], [], [], [], []
        for _, data, off in _words.spans(texts):
            hashes, begins = _words.word_hashes(data, off)
            windows = _words.shingle_hashes(hashes, begins, window)
            raw, at = data.tobytes(), off.tolist()
            for r, held in enumerate(windows):
                words = raw[at[r] : at[r + 1]].split()
                stretches = narrow(held, window, least, times) if len(words) >= max(least, times) else []
                runs, best, rest = describe(words, stretches, least, times)
                sizes.append(len(words))
                counts.append(len(runs))
                flat += runs
                strongest.append(best)
                collapsed.append(b" ".join(rest))
        values = np.array(flat, np.int64).reshape(-1, 3)
        runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], fields=list(_RUN)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), runs, pa.array(strongest, pa.int32()), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "strongest", "collapsed"])

    found = F.arrow_udf(work, "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,strongest:int,collapsed:string>")
    return docs.withColumn(FOUND, found(F.col(text).cast("string")))
