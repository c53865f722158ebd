"""Problem 1 where one tag list stands in a third of the rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_pages import PAGES, make, pages, sentences  # noqa: F401

from tesserae.llm import page_pass, spam


@pytest.mark.parametrize("numbered", [False, True])
def test_copied_list_is_spam(spark, numbered):
    rng = random.Random(7)
    letters = "bdfgklmnprstvz"
    words = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(90)]
    tags = ", ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(60))
    rows = []
    for i in range(240):
        content = (f"{i} {tags} {i}" if numbered else tags) if i % 3 == 0 else make(rng, i, "en" if i % 2 else "ru")[0]
        rows.append([i, "title", content, None, f"s{i % 4}", None, "clash", None, None])
    found = {r.page_id for r in page_pass.spam_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == set(range(0, 240, 3))


def test_pieces_hold_every_neighbour():
    rng = random.Random(1)
    found = [rng.choice(["one", "two", "Three", "7", "vier"]) for _ in range(400)]
    cut = list(spam.pieces(" ".join(found), {}))
    pairs = [pair for p in cut for pair in zip(p.split(), p.split()[1:], strict=False)]
    first = [w.replace("7", "0") for w in found]
    assert len(cut) > 1 and pairs == list(zip(first, first[1:], strict=False))
    assert [len(spam.WORDS.findall(p)) for p in cut] == [p.count(" ") + (p[0] != " ") for p in cut]
    assert set(spam.pieces("odd 12 " + " ".join(found), {})) & set(cut)


def test_shapes_of_spam_and_of_code(pages):  # noqa: F811
    judge = spam.Judge(*spam.fit(pages))
    addresses = "\n".join(f"https://shop.test/item?id={i * 37}&ref=top" for i in range(60))
    bare = "\n".join(f"https://shop.test/item-{i * 37}" for i in range(60))
    keywords = "cheap shoes; buy shoes; " * 40
    code = "\n".join(f"if (x[{i}] > {i * 3}) {{ y += load(x[{i}], {i}); }}\nfor (int k = 0; k < {i}; ++k) total -= k * {i};" for i in range(30))
    assert judge.share(addresses) == judge.share(bare) == judge.share(keywords) == 1.0
    assert judge.share(code) == 0.0


def test_links_out():
    assert spam.links_out(None, None) == 0 and spam.links_out([None, "", "/a", "https://www.A.test/x", "http://b.test"], "a.test") == 1
    lines = "\n".join(f"Great page number {i} of mine" for i in range(10))
    judge = spam.Judge([], np.zeros((spam.CLASSES, spam.CLASSES), np.float32))
    judge.gain = lambda codes: (2.0, 0.0)
    assert judge.share(lines, 0) == judge.share(lines, 9) == 0.0 and judge.share(lines, 10) == 1.0
