"""Problems 1, 2 and 3 describe a word once, however often it stands in the pages, and what that gives is the same."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_pages import repairer, sentences  # noqa: F401

from tesserae.llm import encoding, language, spam

ODD = ["", "\n", "a", "İstanbul İ ΑΣ ΑΣ. ΟΔΟΣ one　two", "abc123def 4 ٣٤x\n\n\n5", "😀 x𝐀y ab 𝟘𝟙 z \ud800 w", "½ x²y ·a· été\xa0là", "see http://a.test/b?c=1 and\nftp://d.test now _x__y_", "\r\x85 last"]


@pytest.fixture(scope="module")
def detector():
    rng = random.Random(3)
    return language.Detector(language.fit([(lang, sentences(lang, rng, 6)) for lang in ("ru", "en") for _ in range(60)]))


def test_languages_of_repeated_words(detector, monkeypatch):
    described = []
    one = language.trigrams
    monkeypatch.setattr(language, "trigrams", lambda texts: (described.append(sum(map(len, texts))), one(texts))[1])
    lines = [sentences(lang, random.Random(i), 6) for i in range(20) for lang in ("ru", "en")]
    first = detector.segments(lines)
    assert detector.segments(lines) == first and {x[0] for x in first} == {"ru", "en"}
    assert sum(described) <= sum(map(len, {w for line in lines for w in line.lower().split(" ")}))


def test_decoding_by_words(detector):
    rng = random.Random(8)
    texts = [*(t for t in ODD if t), *(sentences(rng.choice(["ru", "en"]), rng, 2) for _ in range(2_500))]
    best, sure, size = detector.decode(texts)
    want = language.decode(detector.weights, detector.seen, *language.trigrams(texts), len(texts))
    assert (best == want[0]).all() and (size == want[2]).all() and np.abs(sure - want[1]).max() < 1e-5
    pages = [[], ["x"], [texts[-1], texts[-2]], ["\n".join(ODD)]]
    assert detector.pages(pages) == [detector.segments(p) for p in pages] and detector.pages([]) == []


def test_sound_lines_are_not_weighed(repairer, monkeypatch):  # noqa: F811
    weighed = []
    gains = repairer.gains
    monkeypatch.setattr(repairer, "gains", lambda lines: (weighed.extend(lines), gains(lines))[1])
    rng = random.Random(6)
    sound = [sentences("ru", rng, 2) for _ in range(200)]
    words = sorted({w for x in sound for w in x.split(" ")})
    short = [" ".join(rng.sample(words, 3)) for _ in range(200)]
    assert repairer.fields([("\n".join(short), None)]) == [{}] and len(weighed) < 100
    garbled = ["".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in x.encode(true)) for x in sound[:20] for true, wrong in (("utf-8", "cp1251"), ("cp1251", "koi8-r"))]
    lines = [*sound, *garbled, " ".join(garbled * 5), "é ½ Größe"]
    assert (repairer.worth(lines) == (gains(lines) >= repairer.least)).all() and repairer.worth(garbled).any(1).all()


def test_words_by_tables():
    for text in [*ODD, "\n".join(ODD), " ".join(ODD)]:
        lines = [spam.WORDS.findall(x) for x in spam.DIGITS.sub("0", text).split("\n")]
        found, ends = spam.words_of_lines(text)
        want = [x for x in lines if x]
        assert found == [w for x in want for w in x] and ends.tolist() == np.cumsum([len(x) for x in want])[:-1].tolist()
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice(["one", "two", "Three", "7", "vier"]) for _ in range(rng.randint(0, 60))) for _ in range(40))
    alone = [p for line in text.split("\n") for p in spam.pieces(line, {})]
    assert list(spam.pieces(text, {})) == alone and "".join(spam.joined([text] * 3)) == "\n".join([text] * 3)


def test_counts_of_pieces():
    memo: dict[str, int] = {}
    found = sorted({p for x in [*ODD, *(sentences("en", random.Random(i), 8) for i in range(30))] if "\ud800" not in x for p in spam.pieces(x, memo)})
    batches = [pa.RecordBatch.from_arrays([pa.array(found[i : i + 7], pa.string())], ["piece"]) for i in range(0, len(found), 7)] + [pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["piece"])]
    words, pairs = Counter(), Counter()
    for p in found:
        split = spam.WORDS.findall(p)
        words.update(x for w in split[p[0] == " " :] for x in spam.LETTERS.findall(w.lower()))
        codes = spam.Coder(["the", "of"]).codes(p)
        pairs.update((codes[:-1] * spam.CLASSES + codes[1:]).tolist())
    got = [dict(zip(*(c.to_pylist() for c in x.columns), strict=True)) for f in (spam._count_words, spam._count_neighbours(["the", "of"])) for x in f(iter(batches))]
    assert got == [words, pairs] and any(p[0] == " " for p in found)
