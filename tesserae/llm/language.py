"""Problem 3: the language of each page and of each segment of a mixed page.

Method: error-correcting output codes. The codewords are the columns of the exhaustive code of six languages: every way
to part them in two is one bit (31), and a linear classifier of character trigrams predicts each bit. A segment (one
sentence) gets the language whose codeword has the least total logistic loss over the bits, weighted by the classifiers'
margins; the distance to the next codeword is the confidence, and a segment is ambiguous where it is small. Classifiers
are fitted on the sentences of a bounded sample of labelled pages, once on the labels and once more on the sentences
whose label the first fit confirms.

Defined results: null, empty and blank text has no segment; a text without letters has no language; without labelled
pages there are no languages.
"""

from __future__ import annotations

import re

import numpy as np

from tesserae.llm.sample import LANGUAGES

BITS = 14
MIN_LETTERS = 12
END = re.compile(r"[.!?…]+[\"”»')]*")
CODE_START = re.compile(r"\s*(?:def|for|cd|SELECT|return|import)\b")
ENTITY_END = re.compile(r"&[a-z#0-9]{2,8};$")
N = len(LANGUAGES)
#: Every way to part the languages in two, the first one always on the same side.
CODEWORDS = np.array([[1 if (bit >> lang) & 1 else -1 for bit in range(1, 2 ** (N - 1))] for lang in range(N - 1)] + [[-1] * (2 ** (N - 1) - 1)], np.float32)
AMBIGUOUS = 0.75
MEMO = 40_000  # words whose weights are remembered
SEGMENTS = 1_000  # decoded at once


def _blank(codes: np.ndarray) -> np.ndarray:
    return (codes < 97) | ((codes > 122) & (codes < 0xC0)) | ((codes >= 0x2000) & (codes < 0x2C00))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' character trigrams, and the text of each; digits and marks count as blanks.

    All texts are hashed as one array: a trigram across two of them has a blank in the middle, and those are left out."""
    padded = ["  " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).copy()
    if len(codes) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])[1:-1]
    codes[_blank(codes)] = 32
    keep = codes[1:-1] != 32
    x, y, z = codes[:-2][keep], codes[1:-1][keep], codes[2:][keep]
    h = x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77) + z * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), owner[keep]


def is_code(line: str) -> bool:
    bare = line.rstrip()
    return "&&" in bare or "::" in bare or (bare.endswith(";") and not ENTITY_END.search(bare)) or CODE_START.match(bare) is not None


def sentences(text: str) -> list[str]:
    """The sentences of a line; code has none."""
    if is_code(text):
        return []
    out, at = [], 0
    for m in END.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    return out


def _fit_once(langs: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    counts = np.bincount(langs[owner].astype(np.int64) * (1 << BITS) + grams, minlength=N << BITS).reshape(N, 1 << BITS)
    share = counts / np.maximum(1.0, counts.sum(1, keepdims=True))  # languages weigh the same
    weights = np.zeros((1 << BITS, CODEWORDS.shape[1]), np.float32)
    present = counts.sum(1) > 0
    for bit in range(CODEWORDS.shape[1]):
        up, down = (CODEWORDS[:, bit] > 0) & present, (CODEWORDS[:, bit] < 0) & present
        if up.any() and down.any():
            weights[:, bit] = np.log((share[up].mean(0) + 1e-6) / (share[down].mean(0) + 1e-6))
    return weights


def fit(texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (trigram by bit) and which languages were seen; texts: (language, body text)."""
    rows = [(LANGUAGES.index(lang), s) for lang, text in texts for line in text.split("\n") for s in sentences(line) if len(s) >= 30]
    if not rows:
        return None
    langs = np.array([r[0] for r in rows])
    seen = np.bincount(langs, minlength=N) > 0
    grams, owner = trigrams([r[1] for r in rows])
    weights = _fit_once(langs, grams, owner)
    right = np.zeros(len(rows), bool)
    for at in range(0, len(rows), 1_000):
        lo, hi = np.searchsorted(owner, [at, at + 1_000])
        n = min(1_000, len(rows) - at)
        right[at : at + n] = decode(weights, seen, grams[lo:hi], owner[lo:hi] - at, n)[0] == langs[at : at + n]
    return (_fit_once(langs, grams[right[owner]], owner[right[owner]]), seen) if right.any() else (weights, seen)


def decode(weights: np.ndarray, seen: np.ndarray, grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``nearest`` says of each of n texts, and its number of trigrams. ``owner``: the text of each trigram, rising."""
    size = np.bincount(owner, minlength=n)
    return *nearest(_sums(weights[grams], owner, n), size, seen), size


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of each owner's rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(rows):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def nearest(margins: np.ndarray, size: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (its trigrams' summed weights, their number) the nearest codeword, and by how much it is nearer than the
    next one, as a confidence between 0 and 1."""
    margins = margins * (4 / np.maximum(1, size)[:, None]).astype(np.float32)
    strength = np.abs(margins)
    # the loss of a bit that says yes is that of one that says no less its margin, so one sum serves all codewords
    losses = (np.logaddexp(0, margins) * strength).sum(1)[:, None] - (margins * strength) @ (CODEWORDS > 0).T.astype(np.float32)
    losses[:, ~seen] = np.inf
    best = losses.argmin(1)
    first = losses[np.arange(len(size)), best]
    losses[np.arange(len(size)), best] = np.inf
    gap = (losses.min(1) - first) / np.maximum(1e-9, strength.mean(1))
    return best, np.where(size > 0, 1 - np.exp(-gap), 0.0)


class Detector:
    """Tells segments apart; no trigram goes over a blank, so a text's weights are the sums of its words', which are remembered
    up to a bound."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.weights, self.seen = model
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, self.weights.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        n = len(self.words)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        grams, owner = trigrams(words)
        self.table[n : n + len(words)] = _sums(self.weights[grams], owner, len(words))
        self.words.update(zip(words, range(n, n + len(words)), strict=True))

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each text, the confidence and the number of trigrams."""
        lowered = [" " + t.lower() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lowered])[:-1]])
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        letters = ~_blank(codes)
        begins = np.append(letters[1:] & ~letters[:-1], False)  # the blank before a word
        size = np.add.reduceat(letters, starts, dtype=np.int64)
        counts = np.add.reduceat(begins, starts, dtype=np.int64)
        kept = letters | begins
        words = np.where(begins, np.uint32(32), codes)[kept].astype("<u4").tobytes().decode("utf-32-le").split(" ")[1:]
        if len(self.words) > MEMO:
            self.words.clear()
        at = list(map(self.words.get, words))
        if None in at:
            self._learn(list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None)))
            at = list(map(self.words.get, words))
        at, ends = np.array(at, np.int64), np.cumsum(counts)
        best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lo in range(0, len(texts), SEGMENTS):
            hi = min(lo + SEGMENTS, len(texts))
            rows = self.table[at[ends[lo] - counts[lo] : ends[hi - 1]]]
            best[lo:hi], sure[lo:hi] = nearest(_sums(rows, np.repeat(np.arange(hi - lo), counts[lo:hi]), hi - lo), size[lo:hi], self.seen)
        return best, sure, size

    def segments(self, lines: list[str]) -> list[tuple[str, float, str]]:
        """(language, confidence, text) of every sentence of the lines; one of few letters belongs to the one before it in
        its line, or else to the next, and is left out if its line has no other."""
        return self.pages([lines])[0]

    def pages(self, pages: list[list[str]]) -> list[list[tuple[str, float, str]]]:
        """The segments of each page's lines."""
        parts = [[(i, s) for i, line in enumerate(lines) for s in sentences(line)] for lines in pages]
        texts = [s for part in parts for _, s in part]
        if not texts:
            return [[] for _ in pages]
        best, sure, size = (x.tolist() for x in self.decode(texts))
        out, at = [], 0
        for part in parts:
            to = at + len(part)
            out.append(_joined(part, best[at:to], sure[at:to], size[at:to]))
            at = to
        return out


def _joined(parts: list[tuple[int, str]], best: list[int], sure: list[float], size: list[int]) -> list[tuple[str, float, str]]:
    """The segments of one page from its sentences, each with its line."""
    out: list[tuple[str, float, str]] = []
    waiting, last = "", -1
    for k, (i, s) in enumerate(parts):
        if i != last:
            waiting, last = "", i
        if size[k] >= MIN_LETTERS:
            out.append((LANGUAGES[best[k]], sure[k], (waiting + " " + s).strip()))
            waiting = ""
        elif out and k and parts[k - 1][0] == i and not waiting:
            out[-1] = (*out[-1][:2], out[-1][2] + " " + s)
        else:
            waiting = (waiting + " " + s).strip()
    return out
