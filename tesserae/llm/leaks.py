"""Problem 9: passages of held-out test items inside documents.

Method: winnowing. Words (parted by blanks; letter case, punctuation, invisible characters and look-alike letters don't
matter) are hashed in shingles of K words; of every WINDOW neighbouring shingles the smallest hash is kept, on both
sides, so every shared run of K + WINDOW - 1 = 7 words shares a kept hash. A passage of at least 24 words with at most
one in ten replaced holds such a run: r replaced words leave r + 1 runs, and (n - r) / (r + 1) > 6 for all n >= 24. Each
hit fixes a diagonal (document position less item position), along which the match is extended and checked exactly.

The items are a stated query set; they go against all documents in blocks of bounded size, each held by every task.

Defined results: null or empty texts share nothing; repeated items are reported each by its id; a document is reported
once for each item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.lookalike import JOINED, look_map

K, WINDOW = 5, 3
EXACT, LOOSE, ONE_IN = 12, 24, 10  # fixed by the problem
BLOCK_WORDS = 2_000_000  # words of items held by a task at once


def _word_table() -> dict[int, str]:
    """Lower-case characters to one of their class: what looks alike in either case is one."""
    table = {}
    for a, b in (look_map() | JOINED).items():
        table[a.lower()] = b.lower()
        if len(a.lower()) == 1:
            table[a] = b.lower()
    table["ў"] = "y\u0306"
    return str.maketrans({a: b for a, b in table.items() if len(a) == 1})


_TABLE = _word_table()
_MARKS = re.compile(r"[^\w\s]+|_+")


def words(text: str) -> list[str]:
    text = text.lower().translate(_TABLE)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _MARKS.sub("", text).split()


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of K word codes."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of every window, the last one of equals; of a shorter sequence its smallest."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < WINDOW:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    at = WINDOW - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(at + np.arange(n - WINDOW + 1))


def passage(same: np.ndarray) -> bool:
    """Whether a run of EXACT equal words, or LOOSE or more with at most one in ONE_IN replaced, is in the diagonal."""
    n = len(same)
    if n < EXACT:
        return False
    total = np.concatenate([[0], np.cumsum(same)])
    if (total[EXACT:] - total[:-EXACT] == EXACT).any():
        return True
    if n < LOOSE:
        return False
    # words less ONE_IN times the replaced ones: not negative over the passage
    score = np.arange(n + 1) - ONE_IN * (np.arange(n + 1) - total)
    lowest = np.minimum.accumulate(score[: n - LOOSE + 1])
    return bool((score[LOOSE:] - lowest >= 0).any())


def _matcher(items: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """items: (item_id, text). Their words travel with the task; documents stream by."""
    ids = [i for i, _ in items]
    texts = [words(t) for _, t in items]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        rng = np.random.default_rng(11)
        for t in texts:
            for w in t:
                known.setdefault(w, len(known) + 1)
        mix = rng.integers(1, 2**63, len(known) + 1, dtype=np.uint64)
        mix[0] = 0  # a word of no item; shingles with one can match nothing
        codes = [np.array([known[w] for w in t], np.int64) for t in texts]
        where: dict[int, list[tuple[int, int]]] = {}
        for i, c in enumerate(codes):
            h = shingles(mix[c])
            for p in winnow(h):
                where.setdefault(int(h[p]), []).append((i, int(p)))
        prints = np.array(sorted(where), np.uint64)
        get = known.get
        for batch in batches:
            out_doc, out_item = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.fromiter((get(w, 0) for w in words(text)), np.int64)
                h = shingles(mix[own])
                kept = winnow(h)
                if not len(kept) or not len(prints):
                    continue
                at = np.minimum(np.searchsorted(prints, h[kept]), len(prints) - 1)
                hits = kept[prints[at] == h[kept]]
                diagonals = {(i, int(p) - q) for p in hits for i, q in where[int(h[p])]}
                found = set()
                for i, d in diagonals:
                    if ids[i] in found:
                        continue
                    c = codes[i]
                    lo, hi = max(0, -d), min(len(c), len(own) - d)
                    if passage(c[lo:hi] == own[lo + d : hi + d]):
                        found.add(ids[i])
                out_doc += [doc] * len(found)
                out_item += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_item, pa.int64())], ["doc_id", "item_id"])

    return match


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1]) // 4 + 1
        if size > BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document that holds a passage of the item."""
    texts = documents.where("text is not null").select("doc_id", "text")
    found = None
    for block in _blocks(items):
        part = texts.mapInArrow(_matcher(block), "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    return found
