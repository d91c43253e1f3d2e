"""Encoding and decoding by a byte-pair vocabulary with word ends.

A text is cut at white space and at the strings of special tokens, what is left into words by the vocabulary's pattern.
A word's bytes are symbols in a doubly linked list; neighbouring symbols that a merge rule joins wait in a priority queue by
rank, then place. An entry whose symbols have been joined otherwise since is stale and skipped. So a word of n bytes takes O(n log n), however long it is. Decoding looks ids up and concatenates
their strings, with the separator that the vocabulary file's missing decoder stands for: one space.

The vocabulary is a tokenizer file of public form (JSON): byte-level symbols, lower case, composed characters,
white space dropped. Another kind of file is refused. Its path is a parameter; the driver reads it once and sends it to
the executors (two MB, whatever the documents).

Ids leave as little-endian unsigned 32-bit integers, the form in which shards of tokens are stored; ``ids_of`` gives them as
an array.

Defined results: null and empty texts, and texts of nothing but white space, have no ids and decode to the empty text; very long texts and
words are encoded whole; strings of special tokens in a text are those tokens; repeated rows are encoded each; an empty table
gives an empty result; other columns do not enter; ids outside the vocabulary are skipped on decoding; null ids decode to the empty text.
Letters, numbers and small letters are those of Unicode 16; pairs of characters that only Unicode 16 composes stay apart.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words, and runs between white space, that a worker remembers (twice as many at most), and the longest of them.
MEMORY, MEMORY_CHARS = 150_000, 64
#: Rows that are worked on at once.
ROWS = 256
#: White space as the vocabulary's pattern has it, and what only Python takes for it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN, _NOT_SPACE = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Longer texts are cut one run after the other, not into a list of all.
LONG_CHARS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


# Letters and numbers that Unicode 16 has and Python's tables may lack, and small letters of capitals of Unicode 16 and 17.
LATER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
LATER_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@lru_cache(maxsize=None)
def ranges(kind: str) -> str:
    """The inside of a character class: all code points whose general category starts with ``kind``."""
    out, start, last = [f"{chr(a)}-{chr(b)}" for a, b in LATER[kind]], None, None
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c)[0] == kind:
            start, last = (c if start is None else start), c
        elif start is not None:
            out.append(f"{start}-{last}")
            start = None
    return "".join(out)


def python_pattern(pattern: str) -> str:
    """The vocabulary's pattern with its classes of letters, numbers and white space written out."""
    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{ranges(kind)}]").replace(f"\\p{{{kind}}}", ranges(kind))
    if "\\p" in pattern:
        raise ValueError("a pattern with other classes than letters and numbers")
    return pattern.replace("\\s", SPACE)


class Memory:
    """Packed ids of strings: those met lately, and those met before them."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= MEMORY_CHARS:
            if len(self.new) >= MEMORY:
                self.old = dict(self.new)
                self.new.clear()
            self.new[key] = ids


class Vocabulary:
    """Symbols, merges and special tokens of one tokenizer file."""

    def __init__(self, data: bytes) -> None:
        file = json.loads(data)
        model, kinds = file["model"], [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        split, level = ((file["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
        known = model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and level.get("type") == "ByteLevel" and not level.get("use_regex", True) and file["decoder"] is None
        if not known or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("not a byte-level vocabulary with word ends, composed lower case and dropped white space")
        ids: dict[str, int] = model["vocab"]
        end, symbols = model["end_of_word_suffix"] or "", byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + end] for s in symbols]
        #: Of two neighbouring symbols, as one number: the rank of their merge and the symbol it gives, as one number.
        self.size = 1 + max(ids.values())
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[a] * self.size + ids[b]] = rank * self.size + ids[a + b]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pattern = re.compile(python_pattern(split["pattern"]["Regex"]))
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.chunks, self.words = Memory(), Memory()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        n, size, known = len(word), self.size, self.merges.get
        ids = [self.inner[b] for b in word[:-1]] + [self.final[b] for b in word[-1:]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry is rank * n + place, so that the least is the first in rank, then place
        queue = [m // size * n + i for i in range(n - 1) if (m := known(ids[i] * size + ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if j < 0 or ids[i] < 0 or (m := known(ids[i] * size + ids[j])) is None or m // size != rank:
                continue  # stale: one of the two has been joined with another
            to = m % size
            ids[i], ids[j] = to, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := known(to * size + ids[k])) is not None:
                    heappush(queue, m // size * n + i)
            k = before[i]
            if k >= 0 and (m := known(ids[k] * size + to)) is not None:
                heappush(queue, m // size * n + k)
        return [i for i in ids if i >= 0]

    def _part(self, text: str) -> bytes:
        """Packed ids of a text without special tokens and white space."""
        text = unicodedata.normalize("NFC", text)
        # by character: a sigma is not written otherwise at the end of a word
        text = text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))
        if not text.isascii():
            text = text.translate(LATER_SMALL)
        out = []
        for w in self.pattern.findall(text):
            ids = self.words.get(w)
            if ids is None:
                ids = array("I", self.merge(w.encode()))
                if sys.byteorder != "little":
                    ids.byteswap()
                self.words.put(w, ids := ids.tobytes())
            out.append(ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without white space, remembered."""
        ids = self.chunks.get(chunk)
        if ids is None:
            if self.specials is None or not self.specials.search(chunk):
                ids = self._part(chunk)
            else:
                ids = b"".join([self.special[p].to_bytes(4, "little") if p in self.special else self._part(p) for p in self.specials.split(chunk)])
            self.chunks.put(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        listed = len(text) <= LONG_CHARS and not _NOT_SPACE.search(text)
        chunks = text.split() if listed else (m[0] for m in _RUN.finditer(text))
        chunk = self._chunk
        known = self.chunks.new.get
        return b"".join([known(c) or chunk(c) for c in chunks])


class Strings:
    """Strings of the symbols and special tokens of a tokenizer file, by id."""

    def __init__(self, data: bytes) -> None:
        file = json.loads(data)
        ids = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        self.known: list[str | None] = [None] * (1 + max(ids.values()))
        for s, i in ids.items():
            self.known[i] = s

    def decode(self, ids: bytes) -> str:
        known = self.known
        return " ".join([s for i in np.frombuffer(ids, "<u4").tolist() if i < len(known) and (s := known[i]) is not None])


@lru_cache(maxsize=2)
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


@lru_cache(maxsize=2)
def strings(data: bytes) -> Strings:
    return Strings(data)


def _read(df: DataFrame, path: str):
    data = Path(path).read_bytes()
    vocabulary(data)  # another kind of file is refused before any job
    return df.sparkSession.sparkContext.broadcast(data)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows: decoded texts are some times longer than what they come from."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens and ids (packed) of every row."""
    data = _read(docs, path)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("__text"))
    schema = rows.select(F.col(f"`{id_col}`"), F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = vocabulary(data.value).encode
        for b in _pieces(batches):
            ids = [encoded(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``tokens`` with the strings of its packed ids in ``decoded``, in place of the ids."""
    data = _read(tokens, path)
    others = [f"`{c}`" for c in tokens.columns if c != ids]
    rows = tokens.select(*others, F.col(f"`{ids}`").alias("__ids"))
    schema = rows.drop("__ids").withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = strings(data.value).decode
        for b in _pieces(batches):
            *kept, packed = b.columns
            texts = [decoded(i.as_py() or b"") for i in packed]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def ids_of(packed: Column) -> Column:
    """Packed ids as an array of longs."""

    def number(k: Column) -> Column:
        return F.conv(F.concat(*(F.hex(F.substring(packed, 4 * k + b, F.lit(1))) for b in (4, 3, 2, 1))), 16, 10).cast("long")

    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<bigint>"))


def query(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """op12: ids of every document and the text that they decode to, as digests."""
    tokens = encode(docs, path)
    decoded = decode(tokens.withColumn("ids_sha256", F.sha2("ids", 256)), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
