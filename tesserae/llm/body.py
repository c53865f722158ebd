"""Problem 5: the main body of a page, without menus, notices, sidebars, bylines, counters and footers.

Method: tree scoring. Paragraphs of ``html_content`` pass points for length and commas to the element around them and
half to the one around that, discounted by link density; the best container and the siblings that go with it are kept
(html_tree.py). The blocks found are the lines of ``content`` in order; where the numbers differ they are aligned by
text. Lines without a block (pages without html_content) are judged by a linear classifier of words and shape whose
labels are the tree scores of a bounded sample of pages.

Defined results: empty lines are no lines; null or blank content has none; a page without any body line keeps none;
without a page that has html_content to learn from, lines without a block count as body if they hold a sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from zlib import crc32

from tesserae.llm.html_tree import main_body, parse

BITS = 15
EPOCHS = 4
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"[.!?…]['\"”»)]*\s*$")


def features(line: str, at: float) -> list[int]:
    """Hashed features of a line: its words, its first and last ones, its shape and its place."""
    text = _SPACE.sub(" ", line).strip()
    words = _WORD.findall(_DIGITS.sub("0", text.lower()))
    out = [*{"w" + w for w in words}, "1" + " ".join(words[:1]), "2" + " ".join(words[:2]), "3" + " ".join(words[:3]), "9" + " ".join(words[-2:])]
    out.append(f"n{min(len(words), 40) // 4}")
    out.append(f"p{bool(SENTENCE.search(text))}{text[:1].isupper()}{text.isupper()}")
    out.append(f"a{int(at * 5)}{len(words) < 6}")
    out.append("whole" + text.lower() if len(words) < 6 else "long")
    mask = (1 << BITS) - 1
    return [crc32(x.encode("utf-8", "replace")) & mask for x in out]


def tree_lines(html: str) -> tuple[list[str], list[bool]]:
    """The lines of a page's blocks and whether each is of the body."""
    blocks = parse(html)
    texts, kept = [], []
    for block, keep in zip(blocks, main_body(blocks), strict=True):
        for line in block.text.split("\n"):
            if line.strip():
                texts.append(line)
                kept.append(keep)
    return texts, kept


def normal(line: str) -> str:
    return _SPACE.sub(" ", line).strip()


def by_tree(lines: list[str], html: str) -> list[bool | None]:
    """For each (non-empty) line of content whether the tree keeps it; None where no block is it."""
    texts, kept = tree_lines(html)
    if len(texts) == len(lines):
        return list(kept)
    out: list[bool | None] = [None] * len(lines)
    for i, j in same_lines([normal(x) for x in lines], [normal(x) for x in texts]):
        out[i] = kept[j]
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (rising in the first place) that rises in the second place, too."""
    ends: list[int] = []  # smallest last second place for each length
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[n], at[n] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def same_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal lines in the same order, in n log n at any length: lines that both texts hold once are anchors; between
    two anchors the first occurrence of a line goes with the first one there, the second with the second, and so on."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    anchors = _rising([(i, where[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in where])
    out = []
    i0 = j0 = 0
    for i1, j1 in [*anchors, (len(a), len(b))]:
        seen: Counter = Counter()
        places = {}
        for j in range(j0, j1):
            seen[b[j]] += 1
            places[b[j], seen[b[j]]] = j
        seen.clear()
        pairs = []
        for i in range(i0, i1):
            seen[a[i]] += 1
            if (j := places.get((a[i], seen[a[i]]))) is not None:
                pairs.append((i, j))
        out += _rising(pairs)
        if i1 < len(a):
            out.append((i1, j1))
        i0, j0 = i1 + 1, j1 + 1
    return out


def fit(sample: list[tuple[str, str, str | None]]) -> dict[int, float]:
    """Weights of an averaged perceptron that tells body lines from others; {} if no page of the sample has a tree."""
    rows = []
    for _, content, html in sample:
        if not html:
            continue
        lines = [x for x in content.split("\n") if x.strip()]
        labels = by_tree(lines, html)
        if any(labels):
            rows += [(features(x, i / len(lines)), y) for i, (x, y) in enumerate(zip(lines, labels, strict=True)) if y is not None]
    weights, drift = [0.0] * (1 << BITS), [0.0] * (1 << BITS)
    step = 1
    for _ in range(EPOCHS):
        wrong = 0
        for fs, y in rows:
            if (sum([weights[f] for f in fs]) > 0) != y:
                wrong += 1
                d = 1.0 if y else -1.0
                for f in fs:
                    weights[f] += d
                    drift[f] += step * d
            step += 1
        if not wrong:
            break
    return {f: w - drift[f] / step for f, w in enumerate(weights) if w or drift[f]}


def body_lines(content: str, html: str | None, weights: dict[int, float], restored: str | None = None) -> list[tuple[int, str, bool]]:
    """(line_no, line, body) of every non-empty line of the content; the text is the restored one where there is one."""
    raw = content.split("\n")
    clear = (restored if restored is not None else content).split("\n")
    at = [i for i, x in enumerate(raw) if x.strip()]
    known = by_tree([raw[i] for i in at], html) if html else [None] * len(at)
    if not any(known):
        known = [None] * len(at)
    out = []
    for k, i in enumerate(at):
        keep = known[k]
        if keep is None:
            line = clear[i]
            if weights:
                keep = sum(weights.get(f, 0.0) for f in features(line, k / len(at))) > 0
            else:
                keep = bool(SENTENCE.search(line)) and len(line) > 60
        out.append((i + 1, clear[i], keep))
    return out
