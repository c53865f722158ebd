"""Problem 2: text that was decoded with the wrong charset.

Method: every chain of (wrong charset, true charset) steps that can be undone in a line gives a candidate, for every line with
a character outside ASCII. Its description length is the size of its zstandard compression with the best of all languages'
dictionaries plus the cost of the chain, -log2 of how often its steps are right in the sample; the shortest wins, and the line
stays as it is unless a chain is shorter. Where only some characters of a line are garbled, the candidates that put back only
what is whole UTF-8 in a charset are among them.

Compressing all candidates of all lines (about 18 in six dictionaries for each) takes ten times what the rest of the pass does.
So all candidates are first described by letter trigrams of the same languages, whose lengths are sums over words and are
remembered by word; a step has to be worth its cost in this description, too, and what it gives isn't compressed otherwise.

Samples quoted between « and » in an otherwise sound line are left. Dictionaries, trigrams and costs come from a bounded sample
of labelled pages. Undone are any number of UTF-8 steps and, after them, at most one step between single-byte charsets.

Defined results: null, empty and blank fields are sound; a field with lines that can be restored only in part is found,
the rest stays; a page is found once for each field; without labelled pages nothing is found.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tesserae.llm.sample import LANGUAGES, labelled_pages

DICTIONARY_BYTES = 24_576
LOST_BITS = 16  # of a character that can't be restored, or that no text has
COST_PAGES = 1_000  # of the sample, on which costs are learned
TRIGRAM_BITS, UNSEEN = 19, 15.0
LINES = 256  # described at once
LONG = 500  # words of a line from which rounding may matter
MEMO = 40_000  # words whose trigram lengths are remembered

# Charsets, and the steps from the one a text was read as to the one it was written in.
SINGLE = ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1252", "latin-1")
CYRILLIC_SETS = ("cp1251", "koi8-r", "cp866", "iso8859-5")
STEPS = [(wrong, "utf-8") for wrong in SINGLE]
STEPS += [(wrong, true) for true in CYRILLIC_SETS for wrong in SINGLE if wrong != true]
STEPS += [(wrong, "cp1252") for wrong in CYRILLIC_SETS]

#: A candidate's step: charsets, and whether only what is whole UTF-8 in the wrong one is put back.
Step = tuple[str, str, bool]
ALL_STEPS: list[Step] = [(w, t, False) for w, t in STEPS] + [(w, "utf-8", True) for w in SINGLE]
_NAMES = {"windows-1251": "cp1251", "windows-1252": "cp1252", "iso-8859-1": "latin-1", "latin1": "latin-1", "iso-8859-5": "iso8859-5", "koi8r": "koi8-r", "ibm866": "cp866"}

LOST, MISSING = "\ufffd", "\x1a"  # a character that can't be restored; its place while a line is undone
_CYR = "а-яёіїєґ"
_SOUND = "\\x09-\\x7eА-Яа-яЁёІіЇїЄєҐґäöüßÄÖÜàâçéèêëîïôùûœæñáíóúÀÉÈÊÇÔŒÑÁÍÓÚÎ¿¡ºª«»“”„‚’‘—–…№©®°·•›‹§±²³½€−×≤≥→←✓' ­ -‏ - ⁠　﻿"
SUSPECT = re.compile(
    f"[^{_SOUND}]|[{_CYR}][А-ЯЁІЇЄҐ]|[a-zA-Z][{_CYR}А-ЯЁ]|[{_CYR}А-ЯЁ][a-zA-Z]|[À-ÿ]{{3}}|[ВГ][·©«»°№§±®º ­²³]|\\?{{3}}"
)
CONTROLS = re.compile("[\x80-\x9f]")
#: A word whose letters all were replaced; where there are several, nothing can be restored.
UNREADABLE = re.compile(r"(?<![^ ])\?{3,}[^\w ?]?(?![^ ])")
#: A quoted sample; the marks may also stand inside it, so the closing one is the first that no letter follows.
QUOTED = re.compile(r"«[^\n]{1,120}?»(?![^\W\d_])")


def _missing(undefined: bytes):  # noqa: ANN202
    """Handles what a charset can't encode or decode: its undefined bytes stand for themselves, other characters are missing."""

    def handle(e: UnicodeError) -> tuple:
        if isinstance(e, UnicodeDecodeError):
            return "".join(map(chr, e.object[e.start : e.end])), e.end
        if not undefined or min(e.object[e.start : e.end]) > "\xff":
            return MISSING.encode() * (e.end - e.start), e.end
        return bytes(ord(ch) if ord(ch) < 256 and ord(ch) in undefined else ord(MISSING) for ch in e.object[e.start : e.end]), e.end

    return handle


def _bytes_of(name: str) -> list[str]:
    """The characters of the bytes from 128 on."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256)]


for _name in SINGLE:
    codecs.register_error("tesserae-" + _name, _missing(bytes(b for b in range(128, 256) if not bytes([b]).decode(_name, "ignore"))))


def _whole() -> dict[str, re.Pattern]:
    """For each charset: characters that are whole UTF-8 sequences in it. In the Cyrillic ones only as a whole run, as their
    letters stand beside each other in sound words, too."""
    out = {}
    for name in SINGLE:
        byte = _bytes_of(name)

        def chars(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(byte[b - 128]) for b in range(lo, hi + 1)) + "]"  # noqa: B023

        more = chars(0x80, 0xBF)
        any_ = f"(?:{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{more}|{chars(0xF0, 0xF4)}{more}{more}{more})+"
        out[name] = re.compile(f"(?<![^\\x00-\\x7f]){any_}(?![^\\x00-\\x7f])" if name in CYRILLIC_SETS else any_)
    return out


_WHOLE = _whole()


def undo(text: str, wrong: str, true: str, partly: bool = False) -> tuple[str, int] | None:
    """The text read as ``wrong`` though written in ``true``, read anew, and the number of characters lost."""
    if partly:

        def put(m: re.Match) -> str:
            try:
                return m[0].encode(wrong, "tesserae-" + wrong).decode("utf-8")
            except UnicodeError:
                return m[0]

        done = _WHOLE[wrong].sub(put, text)
        return (done, 0) if done != text else None
    raw = text.encode(wrong, "tesserae-" + wrong)
    lost = raw.count(MISSING.encode())
    if lost * 4 > len(text):
        return None
    if true == "utf-8":
        done = raw.decode("utf-8", "replace").replace(MISSING, LOST)
        lost = done.count(LOST)
        if lost * 4 > len(done):
            return None
    else:
        done = raw.decode(true, "tesserae-" + true).replace(MISSING, LOST)
    return (done, lost) if done != text else None


# --- models --------------------------------------------------------------------------------------------------------


class Models(NamedTuple):
    """What is fitted on the sample; of fixed size."""

    dictionaries: dict[str, bytes]
    trigrams: tuple[np.ndarray, np.ndarray, np.ndarray]  # hash, language and bits of those seen
    costs: dict[tuple[Step, bool], float]  # bits, by step and whether its wrong charset is the declared one


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the texts, each with blanks around it, and where each text's begin."""
    padded = ["  " + t + " " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes).astype(np.uint32)
    codes[codes == 0xA0] = 32
    return codes, np.concatenate([[0], np.cumsum([len(p) for p in padded])[:-1]])


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all trigrams, along the last axis."""
    h = codes[..., :-2] * np.uint32(0x9E3779B1) + codes[..., 1:-1] * np.uint32(0x85EBCA77) + codes[..., 2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TRIGRAM_BITS)


# For the trigram lengths: the byte of each character in each charset (MISSING for none), and the character of each byte.
_TO_BYTE = np.full((len(SINGLE), 1 << 16), ord(MISSING), np.uint8)
_OF_BYTE = np.zeros((len(SINGLE), 256), np.uint32)
for _k, _name in enumerate(SINGLE):
    _TO_BYTE[_k, :128] = np.arange(128)
    _OF_BYTE[_k, :128] = np.arange(128)
    _OF_BYTE[_k, 128:] = [ord(ch) for ch in _bytes_of(_name)]
    _TO_BYTE[_k, _OF_BYTE[_k, 128:]] = np.arange(128, 256)
    _OF_BYTE[_k, ord(MISSING)] = ord(LOST)
#: The first steps: those between single bytes are told by tables, those of UTF-8 word by word.
_PLAIN = [k for k, (_, true, _) in enumerate(ALL_STEPS) if true != "utf-8"]
_PLAIN_FROM = np.array([SINGLE.index(ALL_STEPS[k][0]) for k in _PLAIN])
_PLAIN_TO = np.array([SINGLE.index(ALL_STEPS[k][1]) for k in _PLAIN])


def trigram_bits(texts: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, language and bits (after its first two characters) of each trigram in the texts."""
    out = []
    for k, lang in enumerate(LANGUAGES):
        words = Counter(w for t in texts.get(lang, ()) for w in t.replace("\n", " ").split(" "))
        seen: Counter = Counter()
        context: Counter = Counter()
        for w, n in words.items():
            p = "  " + re.sub("[0-9]", "0", w.replace("\u00a0", " ")) + " "
            for i in range(len(p) - 2):
                seen[p[i : i + 3]] += n
                context[p[i : i + 2]] += n
        grams = list(seen)
        if grams:
            # hashed one by one: a gram stands in the middle of what _hashes puts around it
            at = _hashes(_codes(grams)[0])[2::6][: len(grams)]
            bits = [min(UNSEEN, -log2(seen[g] / (context[g[:2]] + 1))) for g in grams]
            out.append((at.astype(np.int32), np.full(len(at), k, np.int8), np.array(bits, np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.float32))


def dictionaries(texts: list[tuple[str, str]]) -> dict[str, bytes]:
    """A dictionary for each language from the lines of its texts that are sound, the last ones being nearest."""
    out = {}
    by = defaultdict(list)
    for lang, text in texts:
        if not SUSPECT.search(text):
            by[lang] += [x for x in text.split("\n") if len(x) > 40]
    for lang in LANGUAGES:
        lines = list(dict.fromkeys(x.strip() for x in by[lang]))
        if len(lines) > 50:
            try:
                out[lang] = zstandard.train_dictionary(DICTIONARY_BYTES, [x.encode() for x in lines], k=200, d=8).as_bytes()[-DICTIONARY_BYTES:]
                continue
            except zstandard.ZstdError:
                pass
        if lines:
            out[lang] = "\n".join(lines).encode()[-DICTIONARY_BYTES:]
    return out


def fit(sample: list[tuple[str, str, str | None]], declared: list[str | None] | None = None) -> Models | None:
    """Models of (language, text) rows, ``declared`` being the charsets that the pages name; None without rows."""
    texts = [(row[0], row[1]) for row in sample]
    found = dictionaries(texts)
    if not found:
        return None
    by = defaultdict(list)
    for lang, text in texts:
        if not SUSPECT.search(text):
            by[lang].append(text)
    trigrams = trigram_bits(by)
    flat = {(step, same): log2(20 * len(ALL_STEPS)) for step in ALL_STEPS for same in (False, True)}
    first = Repairer(Models(found, trigrams, flat))
    counts, total = Counter(), 0
    pages = list(zip(texts, declared or [None] * len(texts), strict=True))
    for (_, text), name in pages[:: max(1, len(pages) // COST_PAGES)]:
        for _, chain in first.lines(text, name).values():
            counts.update((step, step[0] == charset(name)) for step in chain)
        total += text.count("\n") + 1
    costs = {key: -log2((counts[key] + 0.5) / (total + 1)) for key in flat}
    return Models(found, trigrams, costs)


def charset(name: str | None) -> str | None:
    """One name for each charset."""
    low = (name or "").strip().lower()
    return _NAMES.get(low, low) or None


class Repairer:
    """Restores lines; holds a compressor for each language's dictionary and the trigram lengths of words seen before."""

    def __init__(self, models: Models) -> None:
        self.costs = models.costs
        self.trigrams = np.full((1 << TRIGRAM_BITS, len(LANGUAGES)), UNSEEN, np.float32)
        np.minimum.at(self.trigrams, models.trigrams[:2], models.trigrams[2])
        self.compressors = []
        for data in models.dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.least = np.array([min(self.costs[step, same] for same in (False, True)) for step in ALL_STEPS], np.float32)
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, len(ALL_STEPS) + 1, len(LANGUAGES)), np.float32)
        self.most = np.zeros((1024, len(ALL_STEPS)), np.float32)  # what each step gains at most, in any language

    def length(self, text: str) -> int:
        """Bits of the text with the best dictionary."""
        data = text.encode("utf-8", "replace")
        return 8 * min(len(c.compress(data)) for c in self.compressors)

    def _sums(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of the texts in the codes' last axis, by text and language."""
        bits = self.trigrams[_hashes(codes)]
        # a trigram over two texts' border begins in the one before: these are left out
        bits[..., starts[1:] - 2, :] = bits[..., starts[1:] - 1, :] = 0
        return np.add.reduceat(bits, starts, axis=-2)

    def _learn(self, words: list[str]) -> None:
        """Trigram lengths of new words: as they are, and after each step."""
        n = len(self.words)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.most = np.concatenate([self.most, np.zeros_like(self.most)])
        part = self.table[n : n + len(words)]
        codes, starts = _codes(words)
        own = self._sums(codes, starts)
        part[:, 0] = own
        raw = _TO_BYTE[:, np.minimum(codes, 0xFFFF)]
        part[:, [k + 1 for k in _PLAIN]] = self._sums(_OF_BYTE[_PLAIN_TO[:, None], raw[_PLAIN_FROM]], starts).transpose(1, 0, 2)
        # UTF-8 is only where a leading byte and another one stand together; elsewhere all is lost
        pairs = np.add.reduceat((raw[:, :-1] >= 0xC2) & (raw[:, 1:] >= 0x80) & (raw[:, 1:] < 0xC0), starts, axis=1)
        texts, places = [], []
        for k, (wrong, true, partly) in enumerate(ALL_STEPS):
            if true == "utf-8":
                part[:, k + 1] = own if partly else 2 * UNSEEN * np.diff(np.append(starts, len(codes)))[:, None]
                for i in np.flatnonzero(pairs[SINGLE.index(wrong)]).tolist():
                    done = undo(words[i], wrong, true, partly)
                    if done:
                        texts.append(done[0])
                        places.append((i, k + 1))
        if texts:
            i, k = np.array(places).T
            part[i, k] = self._sums(*_codes(texts))
        self.most[n : n + len(words)] = (part[:, :1] - part[:, 1:]).max(2)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))

    def _places(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the tables have the lines' words outside ASCII, and where each line's begin."""
        split = [[w for w in line.split(" ") if not w.isascii()] for line in lines]
        if len(self.words) > MEMO:
            self.words.clear()
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.words))
        if new:
            self._learn(new)
        at = np.array([self.words[w] for words in split for w in words])
        return at, np.concatenate([[0], np.cumsum([len(words) for words in split])[:-1]])

    def gains(self, lines: list[str]) -> np.ndarray:
        """For each line and step, the bits by which the trigrams of what the step gives are shorter."""
        at, starts = self._places(lines)
        best = np.add.reduceat(self.table.reshape(len(self.table), -1)[at], starts, axis=0).reshape(len(lines), -1, len(LANGUAGES)).min(2)
        return best[:, :1] - best[:, 1:]

    def worth(self, lines: list[str]) -> np.ndarray:
        """For each line and step, whether it gains what it costs at least. A line gains no more than its words do, each in the
        language where it gains most; where even that is too little, nothing else is summed."""
        at, starts = self._places(lines)
        out = np.add.reduceat(self.most[at], starts, axis=0) >= self.least - 1  # a bit for what rounding may take
        out[np.diff(np.append(starts, len(at))) > LONG] = True
        likely = np.flatnonzero(out.any(1))
        if len(likely):
            out[likely] = self.gains([lines[i] for i in likely]) >= self.least
        return out

    def candidates(self, line: str, steps: list[Step]) -> dict[str, tuple[tuple[Step, ...], int]]:
        """Every text that undoing a chain gives, with the chain and the characters it lost; ``steps``: the first ones to try."""
        out: dict[str, tuple[tuple[Step, ...], int]] = {}
        level = [(line, (), 0, steps)]
        while level:
            deeper = []
            for text, chain, lost, tried in level:
                for step in tried:
                    if (done := undo(text, *step)) is None or done[0] == line or done[0] in out:
                        continue
                    out[done[0]] = (*chain, step), lost + done[1]
                    # a text read wrongly twice shrinks each time it is undone, so this ends
                    if step[1] == "utf-8" and len(done[0]) < len(text) and not done[0].isascii():
                        deeper.append((done[0], (*chain, step), lost + done[1]))
            worth = self.gains([x[0] for x in deeper]) >= self.least if deeper else ()
            level = [(*x, [ALL_STEPS[k] for k in np.flatnonzero(row)]) for x, row in zip(deeper, worth, strict=True) if row.any()]
        return out

    def best(self, line: str, steps: list[Step], name: str | None) -> tuple[str, tuple[Step, ...]]:
        """The candidate of least description length, and its chain (none: the line as it is)."""
        size, out, used = self.length(line), line, ()
        for text, (chain, lost) in self.candidates(line, steps).items():
            cost = LOST_BITS * (lost + len(CONTROLS.findall(text))) + sum(self.costs[step, step[0] == name] for step in chain)
            if cost < size and (n := self.length(text) + cost) < size:
                size, out, used = n, text, chain
        return out, used

    def lines(self, text: str, declared: str | None = None) -> dict[int, tuple[str, tuple[Step, ...]]]:
        """The lines that are garbled: their numbers, the text as it was, the chain."""
        return self.fields([(text, declared)])[0]

    def fields(self, texts: list[tuple[str, str | None]]) -> list[dict[int, tuple[str, tuple[Step, ...]]]]:
        """The garbled lines of each (text, declared charset)."""
        split = [[] if text.isascii() else text.split("\n") for text, _ in texts]
        places: dict[str, list[tuple[int, int]]] = {}
        for f, lines in enumerate(split):
            for i, line in enumerate(lines):
                if not line.isascii():
                    places.setdefault(line, []).append((f, i))
        out: list[dict[int, tuple[str, tuple[Step, ...]]]] = [{} for _ in texts]
        distinct = list(places)
        for lo in range(0, len(distinct), LINES):
            part = distinct[lo : lo + LINES]
            worth = self.worth(part)
            for at in np.flatnonzero(worth.any(1)).tolist():
                steps = [ALL_STEPS[k] for k in np.flatnonzero(worth[at])]
                known: dict[str | None, tuple[str, tuple[Step, ...]]] = {}
                for f, i in places[part[at]]:
                    name = charset(texts[f][1])
                    if name not in known:
                        known[name] = self.best(part[at], steps, name)
                        if known[name][1] and not self._outside(part[at], known[name][1]):
                            known[name] = part[at], ()
                    if known[name][1]:
                        out[f][i] = known[name]
        for f, found in enumerate(out):
            if found:
                self._again(split[f], found)
            if split[f] or "???" in texts[f][0]:
                for i, line in enumerate(split[f] or texts[f][0].split("\n")):
                    if i not in found and "???" in line and len(UNREADABLE.findall(line)) > 1:
                        found[i] = line, ()
        return out

    def _again(self, lines: list[str], found: dict[int, tuple[str, tuple[Step, ...]]]) -> None:
        """The other lines of a garbled field: a chain that is known there has no cost any more, it only may not be longer."""
        known = [chain for chain, _ in Counter(chain for _, chain in found.values()).most_common()]
        known += [((*chain[0][:2], not chain[0][2]), *chain[1:]) for chain in known if chain[0][1] == "utf-8"]
        rest = [i for i, line in enumerate(lines) if i not in found and not line.isascii()]
        if not rest:
            return
        gains = self.gains([lines[i] for i in rest])
        firsts = [ALL_STEPS.index(chain[0]) for chain in known]
        for i, gain in zip(rest, gains, strict=True):
            size = None
            for chain, k in zip(known, firsts, strict=True):
                if gain[k] <= 0:
                    continue
                done, lost = lines[i], 0
                for step in chain:
                    if (more := undo(done, *step)) is not None:
                        done, lost = more[0], lost + more[1]
                size = self.length(lines[i]) if size is None else size
                if done != lines[i] and self.length(done) + LOST_BITS * (lost + len(CONTROLS.findall(done))) <= size and self._outside(lines[i], chain):
                    found[i] = done, chain
                    break

    def _outside(self, line: str, chain: tuple[Step, ...]) -> bool:
        """Whether undoing the chain also shortens what stands outside the quoted samples."""
        bare = QUOTED.sub("", line)
        if bare == line:
            return True
        done, lost = bare, 0
        for step in chain:
            if (next_ := undo(done, *step)) is not None:
                done, lost = next_[0], lost + next_[1]
        return done != bare and self.length(done) < self.length(bare)

    def texts(self, texts: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
        """Each (text, declared charset) with its garbled lines restored, and how many there were."""
        out = []
        for (text, _), found in zip(texts, self.fields(texts), strict=True):
            if found:
                lines = text.split("\n")
                for i, (done, _) in found.items():
                    lines[i] = done
                text = "\n".join(lines)
            out.append((text, len(found)))
        return out

    def text(self, text: str, declared: str | None = None) -> tuple[str, int]:
        return self.texts([(text, declared)])[0]


def _repair(batches: Iterator[pa.RecordBatch], models: Models | None) -> Iterator[pa.RecordBatch]:
    repairer = Repairer(models) if models else None
    for batch in batches:
        pages, fields, texts, counts = [], [], [], []
        for at in range(0, batch.num_rows if repairer else 0, 500):
            part = batch.slice(at, 500)
            rows = [
                (page, field, text, declared)
                for page, title, content, declared in zip(*(c.to_pylist() for c in part.columns), strict=True)
                for field, text in (("title", title), ("content", content))
                if text
            ]
            for (page, field, _, _), (done, n) in zip(rows, repairer.texts([row[2:] for row in rows]), strict=True):
                if n:
                    pages.append(page)
                    fields.append(field)
                    texts.append(done)
                    counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pages, pa.int64()), pa.array(fields, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
            ["page_id", "field", "restored", "lines"],
        )


def garbled_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, restored, lines): fields with wrongly decoded lines, the text as it was before and how many lines."""
    sample = labelled_pages(pages)
    models = fit(sample, [row[3] for row in sample])
    rows = pages.select("page_id", "title", "content", "encoding")
    return rows.mapInArrow(lambda batches: _repair(batches, models), "page_id bigint, field string, restored string, lines int")
