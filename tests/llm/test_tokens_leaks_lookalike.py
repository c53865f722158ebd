from __future__ import annotations

import unicodedata
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import leaks, lookalike, tokens

VOCABULARY = Path(tokens.TOKENIZERS) / tokens.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return tokens.load_ranks(str(VOCABULARY))


@needs_vocabulary
def test_encoding_is_exact(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, "   ", "\n\n a\t", "<|endoftext|> is text", "Привет, мир! 123", "a" * 3000, "ж" * 1500, "don't I'll 🛩️ ✅", "same", "same", "ünïcödé " * 400, "\u0000﻿"]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in tokens.encoded(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.encoded(df.where("false")).collect() == []


@needs_vocabulary
@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merges_agree(ranks, piece):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = enc.encode_single_token(piece) if piece in ranks else None
    got = tokens.merge(piece, ranks)
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in got) == piece if len(piece) < 3 else True
    assert want is None or got == (want,)
    assert tokens._merge_long(piece, ranks) == got


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 50_000), min_size=1, max_size=4).map(tuple), max_size=80))
def test_lexicon_round_trip(tmp_path_factory, words):
    path = tmp_path_factory.mktemp("lexicon") / "x.bin"
    path.write_bytes(tokens.compile_lexicon(words))
    lexicon = tokens.Lexicon(str(path))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    for w in words:
        for other in (w + b"x", w[:-1], b"\xff" + w):
            assert lexicon.get(other) == words.get(other)


def test_lexicon_shares_suffixes():
    words = {f"{a}{b}ing".encode(): (1,) for a in "abcdefgh" for b in "klmn"}
    data = np.frombuffer(tokens.compile_lexicon(words), np.int32)
    assert data[2] - 1 == 6  # states: the root, one after the first letter, and the shared "ing"


ITEM = "Около двух лет старый сервер хранил новый индекс корпуса, а завод медленно строил длинный канал для точного прибора и быстрого театра без всякого плана, потому что никто не знал про тот отчёт о редком термине".split()


def near(i, n=1):
    return [w + "x" if k in range(i, len(ITEM), n) else w for k, w in enumerate(ITEM)]


def test_leaks(spark):
    item = " ".join(ITEM)
    assert len(ITEM) >= 30
    docs = {
        1: "До этого. " + item + " И после этого.",
        2: "a b c " + " ".join(ITEM[5:17]) + " d e f",  # twelve in a row
        3: "a b c " + " ".join(ITEM[5:16]) + " d e f",  # eleven
        4: item.upper().replace(" ", "\n  ").replace(",", " - ,!"),
        5: item.replace("о", "o").replace("е", "е​").replace("й", "й"),  # looks the same
        6: " ".join(near(6, 10)),  # one in ten replaced
        7: " ".join(near(3, 5)),  # one in five replaced
        8: None, 9: "", 10: " \n ", 11: " ".join(reversed(ITEM)),
        12: "слово " * 20_000 + item,
    }
    df = spark.createDataFrame([(k, v, 5) for k, v in docs.items()], "doc_id bigint, text string, item_id bigint")
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (10, item, "x"), (11, "too short", "x")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, items).collect()}
    assert got == {(d, i) for d in (1, 2, 4, 5, 6, 12) for i in (7, 10)}
    assert leaks.leaked_items(df.where("false"), items).collect() == []
    assert leaks.leaked_items(df, items.where("false")).collect() == []


def brute_passage(same):
    n = len(same)
    for a in range(n):
        for b in range(a + 12, n + 1):
            wrong = (b - a) - sum(same[a:b])
            if wrong == 0 or (b - a >= 24 and wrong * 10 <= b - a):
                return True
    return False


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([True] * 9 + [False]), max_size=60))
def test_passages_against_brute_force(same):
    assert leaks.passage(np.array(same, bool)) == brute_passage(same)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=0, max_size=30), st.lists(st.integers(0, 30), min_size=7, max_size=7), st.lists(st.integers(0, 30), max_size=30))
def test_winnowing_finds_every_run_of_seven(before, shared, after):
    mix = np.random.default_rng(1).integers(1, 2**63, 40, dtype=np.uint64)
    a, b = shingles(mix, before + shared + after), shingles(mix, shared)
    assert a & b


def shingles(mix, words):
    h = leaks.shingles(mix[np.array(words, np.int64)])
    return {int(h[i]) for i in leaks.winnow(h)}


LOOKS = {
    1: "Точный прибор: файл fi-1", 2: "Точный прибор: файл ﬁ‐1", 3: "Tочный при​бор: фaйл fi-1", 4: "Точный прибор: файл ｆｉ－１",
    5: "Точный прибор: файл fi-2", 6: "Точный прибор: файл fi-1", 7: None, 8: "", 9: "​  ", 10: "​",
    11: "ёлка", 12: "елка", 13: "ёлка", 14: "café", 15: "café", 16: "cafe", 17: "a" * 40_000, 18: "а" * 40_000, 19: "one. two", 20: "one; two",
}


def same_look(a, b):
    table = str.maketrans(lookalike.look_map() | lookalike.JOINED)
    form = lambda t: unicodedata.normalize("NFC", t.translate(table)).strip()
    return form(a) == form(b) != ""


@pytest.mark.parametrize("small", [500_000, 0])
def test_lookalikes(spark, monkeypatch, small):
    monkeypatch.setattr(lookalike, "BROADCAST_ROWS", small)
    rows = [(k, v, "clash") for k, v in LOOKS.items()] + [(100 + i, "copies of one text", "c") for i in range(300)] + [(500, "cоpies of one text", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    texts = {k: v for k, v, _ in rows}
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if texts[a] and texts[b] and texts[a] != texts[b] and same_look(texts[a], texts[b])}
    assert {(1, 2), (1, 3), (1, 4), (3, 4), (11, 13), (14, 15), (17, 18), (100, 500)} <= want
    got = [(r.doc_a, r.doc_b) for r in lookalike.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r.doc_id: r for r in lookalike.one_form(df).collect()}
    assert len(forms) == len(rows) and forms[7].form is None and forms[8].form == ""
    assert forms[1].form == forms[2].form == forms[3].form == forms[4].form == LOOKS[1]  # the text stored twice
    assert forms[500].form == "copies of one text" and forms[500].changed and not forms[100].changed
    assert lookalike.lookalike_pairs(df.where("false")).collect() == []
