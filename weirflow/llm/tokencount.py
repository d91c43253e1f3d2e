"""Token counts by greedy longest match in linear time.

A text is cut into words (runs of non-space); a word is matched piece by piece, each the longest piece of
the vocabulary at that place: first pieces from those that begin a word, later ones from those that continue
one. The counts come from one pass of an automaton over the word's bytes: a trie of both kinds of
pieces, where a failure link leads from a string that cannot go on to what is left after its greedy pieces
are popped, and each link has the number of pieces popped on the way. No piece is ever built.

The vocabulary is a file of a public byte-level tokenizer: one base64 token and its rank a line. Tokens
that start with a space begin words, the others continue them; every single byte does both, so each word has
a count. Which file is read is a parameter; the default directory is that of the installed tokenizers. The driver
reads it once and sends it to the executors; where there is no such file, FileNotFoundError is raised before any job.

Defined results: null and empty texts, and texts of nothing but space, have 0 words and 0 tokens; a piece
that repeats in the file counts once; very long texts and words are counted whole; repeated rows are counted each; an empty table gives an empty result;
other columns do not enter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Counts of words a worker remembers; beyond that it starts anew.
MEMORY = 200_000


def read_vocabulary(data: bytes) -> tuple[set[bytes], set[bytes]]:
    """(pieces that begin a word, pieces that continue one), without the leading space; all bytes are in both."""
    single = {bytes([b]) for b in range(256)}
    first, later = set(single), set(single)
    for line in data.split(b"\n"):
        if line:
            token = base64.b64decode(line.split()[0])
            (first.add(token[1:]) if token[:1] == b" " and len(token) > 1 else later.add(token))
    return first, later


class Automaton:
    """Nodes of two tries: 0 is the root of a word, 1 the root of its continuation."""

    def __init__(self, first: set[bytes], later: set[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for byte in piece:
                    to = self.next[at].get(byte)
                    if to is None:
                        to = self.next[at][byte] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] = True
        n = len(self.next)
        #: Where a node goes when it cannot read on, and how many pieces that pops; -1 where nowhere.
        self.link, self.popped = [-1] * n, [0] * n
        queue = [(p, b) for p in (0, 1) for b in self.next[p]]
        at = 0
        while at < len(queue):  # nodes in order of depth
            parent, byte = queue[at]
            at += 1
            node = self.next[parent][byte]
            if ends[node]:
                self.link[node], self.popped[node] = 1, 1
            else:
                to, count = self.link[parent], self.popped[parent]
                while to != -1 and byte not in self.next[to]:
                    to, count = self.link[to], count + self.popped[to]
                if to != -1:
                    self.link[node], self.popped[node] = self.next[to][byte], count
            queue.extend((node, b) for b in self.next[node])

    def count(self, word: bytes) -> int:
        """Greedy pieces of one word."""
        nexts, link, popped = self.next, self.link, self.popped
        at = n = 0
        for byte in word:
            while (to := nexts[at].get(byte)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at > 1:  # pop what the rest holds
            n += popped[at]
            at = link[at]
        return n


@lru_cache(maxsize=2)
def automaton(data: bytes) -> Automaton:
    return Automaton(*read_vocabulary(data))


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_tokens and n_bytes (of the words) of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a few MB, whatever the documents
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("__text"))
    schema = rows.drop("__text").withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_tokens", "n_bytes")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memory = automaton(vocabulary.value).count, {}
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for i, t in enumerate(b.column(1)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                total = 0
                for w in words:
                    n = memory.get(w)
                    if n is None:
                        n = count(w)
                        if len(w) <= 64:
                            memory[w] = n
                    total += n
                out[:, i] = len(words), total, sum(map(len, words))
                if len(memory) > MEMORY:
                    memory.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """op4: tokens of every document."""
    return count_tokens(docs, path)
