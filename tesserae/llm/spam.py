"""Problem 1: pages of repeated keywords, link lists and tags.

Method: pointwise mutual information of neighbouring words from counts over the whole corpus. Words are the TOP most
frequent ones and, for all others, classes by shape and ending, so that the table of neighbours has a fixed size at any
size of the corpus and counts all of it. Copies would make a list's own neighbours frequent: lines are cut into pieces where
their words say so, and each distinct piece of the corpus is counted once, however many rows hold it and whatever stands
around it; neighbours found in one piece only say nothing.

A page is cut into blocks (a long line, short lines that follow each other) of about WINDOW words. The mean PMI of a
block's neighbours is compared with the mean PMI that its words have at other distances: words that share a topic attract each
other anywhere in it, but only sentences bind neighbours more. A block is spam if its neighbours gain less than GAIN by being
neighbours (word salad), or if too many of its neighbours are repeated collocations, pairs of positive PMI that stood in the
block before (keywords, link lists). Short lines that are as many as the page's links to other sites (``links``) must gain
more. An address is one word. Program code (lines of its shape) isn't judged. A page is spam if such blocks hold half of its characters.

Defined results: null, empty and blank pages aren't spam; a block shorter than MIN_WORDS words is never flagged;
garbled pages are judged by their restored text; null links are none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.counts import most_frequent
from tesserae.llm.markup import CODE
from tesserae.plans.shared import materialize

TOP, NAMES, ENDINGS = 768, 7, 247
CLASSES = TOP + 2 + NAMES + ENDINGS  # 1024
SMOOTH = 1e-8  # of all neighbours
LONG_LINE, MIN_WORDS = 20, 12
GAIN, LINKED_GAIN = 1.5, 2.2  # nats
REPEATED, REPEATED_SENTENCES, SHARE = 0.38, 0.65, 0.5
WINDOW, DISTANCES = 256, 6
WORDS, LETTERS, DIGITS = re.compile(r"[^\W\d_]+|\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
ENDED = re.compile(r"[.!?…:](?:[\"'»”’)\]}*_`~]|</?\w+>)*$")  # a sentence's end, perhaps inside marks
URL, LINK = re.compile(r"(?:https?|ftp)://[^\s<>\"|,;]+"), "Xlink"  # the addresses' own class
#: A line without any of these is no code.
CODE_HINT = re.compile(
    r"[(\[{}<;=]|->|&&|\|\||::|^\s*(?:if|elif|else|while|for|class|with|try|return|import|from|select|cd|break|continue|pass|end|fi|done)\b", re.I
)
#: Program code by its shape: calls, indices, blocks, operators between blanks, statements of one word.
CODE_LINE = re.compile(
    CODE.pattern + r"|\w\([^()]*\)|\w\[\w|[{}]\s*$|\s(?:[-+*/%&|<>=!]?=|->|&&|\|\|)\s|\w::\w|^\s*(?:return|else|try|break|continue|pass|end|fi|done)\b[^.,]{0,40}$", re.I
)
WORD_BLOCK = 300_000
CUT_CHARS = 100_000  # of texts cut together
PIECE = 8  # words of a piece, on average


_LETTER, _DIGIT, _END = 1, 2, 3


def _kinds(chars: str) -> np.ndarray:
    """For each character whether it is a word's letter, a digit, a line's end or none of these (0)."""
    kinds = np.zeros(len(chars), np.uint8)
    for kind, shape in ((_LETTER, LETTERS), (_DIGIT, DIGITS), (_END, re.compile("\n"))):
        for m in shape.finditer(chars):
            kinds[m.start() : m.end()] = kind
    return kinds


_KINDS = _kinds("".join(map(chr, range(1 << 16))))


def words_of_lines(text: str) -> tuple[list[str], np.ndarray]:
    """What WORDS finds, numbers as 0, and before which of these words another line begins; told by tables, as the text is the
    whole corpus."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]).tolist():
        kinds[codes == code] = _kinds(chr(code))[0]
    before = np.concatenate([kinds[:0], [0], kinds[:-1]])[: len(kinds)]
    words = ((kinds == _LETTER) | (kinds == _DIGIT)) & (kinds != before)
    codes = np.where(kinds == _LETTER, codes, np.where(kinds == _DIGIT, np.uint32(48), np.uint32(32)))
    lines = np.cumsum(words, dtype=np.int32)[kinds == _END]
    # a number is its first digit, and a word that begins right after another one gets a blank before it
    kept = words | (kinds != _DIGIT)
    beside = (words & (before != 0) & (before != _END))[kept]
    found = np.insert(codes[kept], np.flatnonzero(beside), 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()
    lines = np.unique(lines)
    return found, lines[(lines > 0) & (lines < len(found))]


def pieces(text: str, memo: dict[str, int]) -> Iterator[str]:
    """The lines' words in pieces that end after some neighbours, chosen by a hash of the two: equal runs of words have equal
    pieces in any line, whatever their numbers are (one class). A piece that goes on from another begins with a blank and that
    one's last word, so every neighbour is in one."""
    found, lines = words_of_lines(without_links(text))
    if len(memo) > WORD_BLOCK:
        memo.clear()
    h = np.array(list(map(memo.get, found)), np.float64)  # all of them are exact; new words have none yet
    for i in np.flatnonzero(np.isnan(h)).tolist():
        h[i] = memo[found[i]] = zlib.crc32(found[i].encode())
    h = h.astype(np.int64)
    cut = (h[:-1] * 31 + h[1:]) % 0xFFFFFFFB % PIECE == 0  # at i: after word i + 1, unless that is a line's first or last one
    cut[lines - 1] = False
    cut[lines[lines > 1] - 2] = False
    cuts = np.flatnonzero(cut[:-1]) + 1
    stops = np.concatenate([cuts, lines, [len(found)] if found else cuts[:0]])
    order = stops.argsort(kind="stable")
    start, mark = 0, ""
    for stop, inside in zip(stops[order].tolist(), (order < len(cuts)).tolist(), strict=True):
        yield mark + " ".join(found[start : stop + inside])
        start, mark = stop, " " if inside else ""


def joined(texts: list[str]) -> Iterator[str]:
    """The texts one below the other, about CUT_CHARS characters at a time."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= CUT_CHARS:
            yield "\n".join(part)
            part, n = [], 0
    if part:
        yield "\n".join(part)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    seen: dict[str, None] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["piece"])

    for batch in batches:
        for text in joined(batch.column(0).to_pylist()):  # a piece lies in one line, so texts can be cut together
            seen.update(dict.fromkeys(pieces(text, memo)))
            if len(seen) > WORD_BLOCK:
                yield rows()
                seen.clear()
    yield rows()


def _words(found: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces' words, encoded, and where each piece's begin (one more offset than pieces); a piece that begins with a blank
    has an empty word first."""
    split = pc.split_pattern(found, " ")
    offsets = split.offsets.to_numpy()
    return split.flatten().dictionary_encode(), offsets - offsets[0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        if batch.num_rows:
            words, offsets = _words(batch.column(0))
            at, known = words.indices.to_numpy(), words.dictionary.to_pylist()
            # the word that a piece repeats was counted in the piece before
            starts = offsets[:-1]
            again = starts[at[starts] == known.index("")] + 1 if "" in known else starts[:0]
            n = np.bincount(at, minlength=len(known)) - np.bincount(at[again], minlength=len(known))
            for word, times in zip(known, n.tolist(), strict=True):
                if times:
                    for x in LETTERS.findall(word.lower()):
                        counts[x] += times
        if len(counts) > WORD_BLOCK:
            yield rows()
            counts.clear()
    yield rows()


def without_links(text: str) -> str:
    """The text with one word in place of every address."""
    return URL.sub(LINK, text) if "://" in text else text


class Coder:
    """Words to classes; remembers what it has seen, up to a bound."""

    def __init__(self, top: list[str]) -> None:
        self.top = {w: i for i, w in enumerate(top)}
        self.memo: dict[str, int] = {}

    def _class(self, word: str) -> int:
        low = word.lower()
        if word == LINK:
            code = CLASSES - 1
        elif (i := self.top.get(low)) is not None:
            code = i
        elif word[0].isdigit():
            code = TOP
        elif word[0].isupper():
            code = TOP + 1 + zlib.crc32(low[-2:].encode()) % NAMES
        else:
            code = TOP + 1 + NAMES + zlib.crc32(low[-3:].encode()) % ENDINGS
        if len(self.memo) > WORD_BLOCK:
            self.memo.clear()
        self.memo[word] = code
        return code

    def codes(self, text: str) -> np.ndarray:
        return self.classes(WORDS.findall(text))

    def classes(self, found: list[str]) -> np.ndarray:
        codes = list(map(self.memo.get, found))
        if None in codes:
            codes = [self._class(w) if c is None else c for w, c in zip(found, codes, strict=True)]
        return np.array(codes, np.int64)


def _count_neighbours(top: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = Coder(top), np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if batch.num_rows:
                words, offsets = _words(batch.column(0))
                known = words.dictionary.to_pylist()
                blank = known.index("") if "" in known else -1
                at = words.indices.to_numpy()
                c = coder.classes([w or "0" for w in known])[at]
                apart = np.zeros(len(c), bool)
                apart[offsets[1:-1] - 1] = True
                apart |= at == blank
                table += np.bincount((c[:-1] * CLASSES + c[1:])[~apart[:-1]], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    return count


def fit(pages: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words and the PMI of each pair of classes.

    Both tables have a fixed size; every page is counted, equal pieces of pages once."""
    texts = materialize(pages.where("content is not null").select("content").mapInArrow(_cut, "piece string").distinct(), "pieces")
    words = texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(words, "word", TOP)
    cells = texts.mapInArrow(_count_neighbours(top), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES * CLASSES)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(CLASSES, CLASSES)
    total = max(1.0, counts.sum())
    expected = counts.sum(1)[:, None] * counts.sum(0)[None, :] / total
    # one occurrence of every pair is taken off: a block's own neighbours are no evidence for it
    pmi = np.log((np.maximum(counts - 1, 0) + SMOOTH * total) / (expected + SMOOTH * total))
    return top, pmi.astype(np.float32)


class Judge:
    """Scores pages; made from what ``fit`` returns."""

    def __init__(self, top: list[str], pmi: np.ndarray) -> None:
        self.coder, self.flat = Coder(top), pmi.reshape(-1)

    def gain(self, codes: np.ndarray) -> tuple[float, float]:
        """By how much the mean PMI of the words' neighbours exceeds that of the same words at other distances, and the share
        of neighbours that are repeated collocations."""
        n = len(codes)
        at = codes * CLASSES
        pairs = at[:-1] + codes[1:]
        pmi = self.flat[pairs]
        steps = [2 + k * (n - 3) // (DISTANCES + 1) for k in range(1, DISTANCES + 1)]
        twice = np.concatenate([codes, codes])
        others = self.flat[np.concatenate([at + twice[d : d + n] for d in steps])]
        order = pairs.argsort(kind="stable")
        ordered = pairs[order]
        again = pmi[order[1:]][ordered[1:] == ordered[:-1]]
        return float(pmi.sum() / (n - 1) - others.sum() / len(others)), float((again > 0).sum() / (n - 1))

    def block(self, lines: list[str], kind: str, linked: bool = False) -> float:
        """The share of the block that is spam; kind: ``long``, ``short`` or ``ended`` (sentences)."""
        c = self.coder.codes(without_links(" ".join(lines)))
        n = len(c)
        if n < MIN_WORDS:
            return 0.0
        spam = 0
        for part in np.array_split(c, round(n / WINDOW)) if n > 1.5 * WINDOW else (c,):
            gain, repeated = self.gain(part)
            least = LINKED_GAIN if linked and kind == "short" else GAIN
            most = REPEATED_SENTENCES if kind == "ended" else REPEATED
            if gain < least or repeated >= most:
                spam += len(part)
        return spam / n

    def share(self, text: str, links: int = 0) -> float:
        """The part of the text's characters that lies in spam blocks; ``links``: how many links to other sites the page has."""
        total, found, linked = blocks(text, links)
        spam = sum(n * self.block(lines, kind, linked) for n, kind, lines in found)
        return spam / total if total else 0.0

    def spam(self, text: str, links: int = 0) -> bool:
        """Whether the share is SHARE or more. The largest blocks are judged first, the others only while they can matter."""
        total, found, linked = blocks(text, links)
        left, spam = sum(n for n, _, _ in found), 0.0
        for n, kind, lines in sorted(found, key=lambda b: -b[0]):
            if spam >= SHARE * total or spam + left < SHARE * total:
                break
            spam += n * self.block(lines, kind, linked)
            left -= n
        return total > 0 and spam >= SHARE * total


def blocks(text: str, links: int) -> tuple[int, list[tuple[int, str, list[str]]], bool]:
    """The characters of the text, its blocks (characters, kind, lines) without code, and whether its short lines are as many as
    its links to other sites."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    open_: dict[str, list[str]] = {"short": [], "ended": []}
    out: list[tuple[int, str, list[str]]] = []

    def close() -> None:
        for kind, block in open_.items():
            if block:
                out.append((sum(map(len, block)), kind, block))
                open_[kind] = []

    for line in lines:
        if CODE_HINT.search(line) and CODE_LINE.search(without_links(line)):
            continue
        if line.count(" ") >= LONG_LINE:
            close()
            out.append((len(line), "long", [line]))
        else:
            open_["ended" if ENDED.search(line) else "short"].append(line)
    close()
    linked = 0 < sum(x.count(" ") < LONG_LINE for x in lines) <= links
    return sum(map(len, lines)), out, linked


def links_out(links: list[str | None] | None, domain: str | None) -> int:
    """How many of a page's links lead to other sites."""
    own = (domain or "").lower().removeprefix("www.")
    hosts = [(x or "").partition("//")[2].partition("/")[0].lower().removeprefix("www.") for x in links or ()]
    return sum(1 for h in hosts if h and h != own)
