r"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary is a trie over bytes. A node's failure link leads to the node that the rest of its string stands at
after as many longest pieces as possible are split off, and its count says how many pieces that pops. A word is read
byte by byte: where the trie has no edge, the count is added and the failure link taken. So each byte is read
once, however often pieces would have to be taken back, and only numbers are kept.

Words are runs of bytes other than ``[\x20\x09-\x0D]``, each read with a space before it, as byte-level vocabularies
mark the start of a word. A vocabulary may also give separate pieces for the inside of a word. A word that the
vocabulary can't spell counts as one unknown token.

The automaton is made once on the driver and broadcast; its size is that of the vocabulary, not of the data. Executors
read Arrow batches and remember counts of recent words (``REMEMBERED`` at most). No shuffle.

Null text has 0 words and 0 tokens, as empty text has. Rows stay as they are, repeated or with null ids; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import _words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 200_000


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Automaton:
    """Longest-match automaton. ``edges[node << 8 | byte]`` is a node; ``link`` and ``pops`` are by node, -1 is no link."""

    def __init__(self, start: Iterable[bytes], inside: Iterable[bytes] | None = None):
        self.edges: dict[int, int] = {}
        self.link, self.pops, whole = [-1], [0], [False]
        parents: list[tuple[int, int]] = [(-1, -1)]

        def node(parent: int, byte: int) -> int:
            to = self.edges.get(parent << 8 | byte)
            if to is None:
                to = self.edges[parent << 8 | byte] = len(whole)
                whole.append(False)
                self.link.append(-1)
                self.pops.append(0)
                parents.append((parent, byte))
            return to

        self.inside = 0
        if inside is not None:
            self.inside = 1
            whole.append(False)
            self.link.append(-1)
            self.pops.append(0)
            parents.append((-1, -1))
        for root, pieces in ((0, start), (self.inside, inside or ())):
            for piece in pieces:
                at = root
                for byte in piece:
                    at = node(at, byte)
                if piece:
                    whole[at] = True
        below: dict[int, list[int]] = {}
        for v, (parent, _) in enumerate(parents):
            if parent >= 0:
                below.setdefault(parent, []).append(v)
        queue = deque([0] if self.inside == 0 else [self.inside, 0])
        while queue:  # by depth, so that shorter strings are done first
            for v in below.get(queue.popleft(), ()):
                queue.append(v)
                parent, byte = parents[v]
                if whole[v]:
                    self.link[v], self.pops[v] = self.inside, 1
                    continue
                to, popped = self.link[parent], self.pops[parent]
                while to >= 0 and (to << 8 | byte) not in self.edges:
                    popped += self.pops[to]
                    to = self.link[to]
                if to >= 0:
                    self.link[v], self.pops[v] = self.edges[to << 8 | byte], popped

    def count(self, word: bytes) -> int:
        edges, link, pops = self.edges, self.link, self.pops
        at = total = 0
        for byte in word:
            to = edges.get(at << 8 | byte)
            while to is None:
                total += pops[at]
                at = link[at]
                if at < 0:
                    return 1
                to = edges.get(at << 8 | byte)
            at = to
        while at != self.inside or not total:  # pop what is left
            if at == 0 and not word:
                return 0
            total += pops[at]
            at = link[at]
            if at < 0:
                return 1
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word)
        return n


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str | Iterable[bytes] = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs(doc_id, text)``."""
    pieces = read_pieces(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    shared = spark.sparkContext.broadcast(Automaton(pieces))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(shared.value)
        for batch in rows:
            n_words, n_tokens = [], []
            for _, data, off in _words.spans(batch.column(1)):
                raw = data.tobytes()
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    found = raw[a:b].split()
                    n_words.append(len(found))
                    n_tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
