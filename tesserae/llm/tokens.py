"""Problem 8: the whole corpus encoded by a public byte-level BPE vocabulary.

Method: pieces (the vocabulary's own pre-tokens) are counted over all documents; the most frequent ones are compiled
into a minimal acyclic automaton (suffixes shared, built from sorted words), whose path counts number its words; the
ids of word n stand in an array. The file lies in the shared folder and is memory-mapped by the workers, which
look up a piece in it once and remember it; a piece that isn't in the lexicon is merged exactly by the ranks.

Defined results: null and empty texts have the empty list; a blank text is encoded like any other; strings of special
tokens are ordinary text; every document has one row, repeated rows each their own.
"""

from __future__ import annotations

import base64
import mmap
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.counts import most_frequent
from tesserae.plans.shared import write_bytes

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary parts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 32_768  # the automaton's size is bounded; what isn't in it is merged
MEMO = 300_000
BLOCK = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The piece's ids: the pair of the lowest rank is joined, again and again."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) > 400:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for very long pieces, by a heap over a linked list: n log n instead of n squared."""
    import heapq

    n = len(piece)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return tuple(out)


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic automaton over sorted words, as flat arrays, with the ids of each word by its number."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # nodes not settled yet, along the last word
    last = b""
    ordered = sorted(words)
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        for depth in range(len(last), common, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], settle(node)))
        if word is None:
            break
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    root = settle(path[0])
    reach = np.zeros(len(states), np.int64)  # words below each state; children are settled before
    first, labels, targets, skips, finals = [0], [], [], [], []
    for i, (final, edges) in enumerate(states):
        n = int(final)
        for label, to in edges:
            labels.append(label)
            targets.append(to)
            skips.append(n)
            n += reach[to]
        reach[i] = n
        first.append(len(labels))
        finals.append(final)
    ids = [words[w] for w in ordered]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.array([y for x in ids for y in x], np.int32)
    arrays = [np.array(first, np.int32), np.array(labels, np.int32), np.array(targets, np.int32), np.array(skips, np.int32), np.array(finals, np.int32), offsets, flat]
    return struct.pack("<2i7i", 1, root, *map(len, arrays)) + b"".join(x.tobytes() for x in arrays)


class Lexicon:
    """The compiled automaton, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        self.root = data[1]
        at, arrays = 9, []
        for n in data[2:9]:
            arrays.append(data[at : at + n])
            at += n
        self.first, self.labels, self.targets, self.skips, self.finals, self.offsets, self.ids = arrays

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, number = self.root, 0
        first, labels, targets, skips = self.first, self.labels, self.targets, self.skips
        for byte in word:
            hi = first[state + 1]
            at = bisect_left(labels, byte, first[state], hi)
            if at >= hi or labels[at] != byte:
                return None
            number += skips[at]
            state = targets[at]
        if not self.finals[state]:
            return None
        return tuple(self.ids[self.offsets[number] : self.offsets[number + 1]])


#: Characters that both expressions below class alike; texts of these alone are parted by the faster one.
_PLAIN = re.compile("[^\\n\\t\\r\\x20-\\x7e\\xa0«»À-ÖØ-öø-ɏА-яЁёІіЇїЄєҐґ–—‘’“”„…№]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def piece_finder() -> Callable[[str], list[str]]:
    """A function that parts a text by PATTERN."""
    import regex

    exact, fast, other = regex.compile(PATTERN).findall, _FAST.findall, _PLAIN.search
    return lambda text: exact(text) if other(text) else fast(text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = piece_finder()
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(find(text))
            if len(counts) > BLOCK:
                yield rows()
                counts.clear()
    yield rows()


def _encoder(lexicon: str, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = piece_finder()
        known, ranks = Lexicon(SparkFiles.get(lexicon)), {}
        memo: dict[str, tuple[int, ...]] = {}

        def ids_of(piece: str) -> tuple[int, ...]:
            data = piece.encode("utf-8")
            ids = known.get(data)
            if ids is None:
                if not ranks:
                    ranks.update(load_ranks(SparkFiles.get(vocabulary)))
                ids = merge(data, ranks)
            if len(memo) >= MEMO:
                memo.clear()
            memo[piece] = ids
            return ids

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, offsets = [], [0]
                for text in part.column(1).to_pylist():
                    for piece in find(text or ""):
                        flat += memo.get(piece) or ids_of(piece)
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return encode


def encoded(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document by the vocabulary ``byte_bpe_50k`` in the folder ``tokenizers``."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    counted = texts.where("text is not null").select("text").mapInArrow(_counts, "piece string, n bigint")
    top = most_frequent(counted.groupBy("piece").agg(F.sum("n").alias("n")), "piece", LEXICON_WORDS)
    vocabulary = str(Path(tokenizers) / VOCABULARY)
    ranks = load_ranks(vocabulary)
    words = {p: merge(p, ranks) for p in (t.encode("utf-8") for t in top)}
    path = write_bytes(spark, "p8-lexicon", compile_lexicon(words))
    for file in (path, vocabulary):  # the workers get both from the driver
        spark.sparkContext.addFile(file)
    return texts.mapInArrow(_encoder(Path(path).name, VOCABULARY), "doc_id bigint, ids array<int>")
