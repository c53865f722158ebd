from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from tesserae.llm import frequency, lines

PAGES = "page_id bigint, url string, domain string, content string, term string"
POSTINGS = "term string, doc_id bigint, frequency int, positions array<int>, cf string"


def test_terms_against_counters(spark):
    texts = ["Ab ab ab-CD жЖж ß", "", "  ", None, "ab 12 É-é", "ab", "ab", "ab", "x" * 50_000 + " y"]
    pages = spark.createDataFrame([(i, "u", "d", t, "clash") for i, t in enumerate(texts)], PAGES)
    rows = [("Ab", 1, 2, [1, 2]), ("Ab", 1, 2, [1, 2]), ("ab", 1, None, [5]), ("ab", 2, -1, None), (None, 3, 1, [0]), ("zz", 4, 0, []), ("zz", None, 3, [1])]
    postings = spark.createDataFrame([(*r, "x") for r in rows], POSTINGS)
    got = {(r.origin, r.term): (r.cf, r.df, r.mark) for r in frequency.marked_terms(pages, postings).collect()}
    cf, df = Counter(), Counter()
    for t in texts:
        if t is not None:
            words = re.findall(frequency.TERM, t.lower())
            cf.update(words)
            df.update(set(words))
    n = sum(t is not None for t in texts)
    for w in cf:
        mark = "common" if 4 * df[w] > n else "rare" if df[w] <= 2 and cf[w] <= 4 else None
        assert got.pop(("pages", w)) == (cf[w], df[w], mark)
    assert got.pop(("postings", "ab")) == (3, 2, "common")
    assert got.pop(("postings", "zz"))[0] == 3
    assert not got


def test_terms_of_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    postings = spark.createDataFrame([], POSTINGS)
    assert frequency.marked_terms(pages, postings).collect() == []


def test_blocks_flush(spark, monkeypatch):
    ids = set()
    pages = spark.createDataFrame([(i, "u", "d", f"w{i % 7} w{i} w{i}", "") for i in range(60)], PAGES)
    for r in frequency.term_frequencies(pages, spark.createDataFrame([], POSTINGS)).collect():
        assert r.cf == (2 if int(r.term[1:]) > 6 else sum((i % 7 == int(r.term[1:])) for i in range(60)) + 2)
        ids.add(r.term_id)
    assert len(ids) == 60  # one integer for each term


def brute(rows):
    occ, urls = defaultdict(list), defaultdict(set)
    for page, url, domain, content in rows:
        if domain is None or content is None:
            continue
        for i, line in enumerate(content.split("\n"), 1):
            form = lines.normal_line(line)
            if len(form) >= 20:
                occ[domain, form].append((page, i))
                urls[domain, form].add(url)
    return {x for k, v in occ.items() if len(urls[k]) >= 6 for x in v}


def test_repeated_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["share", "this", "page", "cookies", "Правила", "сайта", "menü", "x"]
    common = [" ".join(rng.choice(words, 6)) + f" {i}" for i in range(8)] + ["short", "Twenty characters ok", "ж" * 20, "y" * 3000]
    rows = []
    for i in range(160):
        text = [str(rng.choice(common)) + str(rng.choice(["", " ", "\t", "\r", "\xa0"])) for _ in range(6)]
        text = [t.upper() if rng.random() < 0.2 else t.replace(" ", "\xa0 ") if rng.random() < 0.2 else t for t in text]
        text.insert(3, f"a line of its own, {i} of them, unique")
        # one site holds a third of all pages, urls repeat
        rows.append((i, None if i == 7 else f"u{i % 50}", [None, "big", "big", "a", "b"][i % 5], None if i == 3 else "\n".join(text)))
    rows += [(900, "u", "big", ""), (901, "u", "big", " \n\n"), *rows[:2]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, domain string, content string, line string")
    got = {(r.page_id, r.line_no) for r in lines.repeated_lines(df).collect()}
    assert got == brute(rows) and got
    unique = df.dropDuplicates(["page_id"])
    cleaned = {r.page_id: r for r in lines.without_repeated_lines(unique).collect()}
    by_id = {r[0]: r for r in rows}
    assert len(cleaned) == len(by_id) and cleaned[3].content is None
    gone = brute(by_id.values())
    for page, row in cleaned.items():
        content = by_id[page][3]
        if content is not None:
            assert row.content == "\n".join(x for i, x in enumerate(content.split("\n"), 1) if (page, i) not in gone)
    assert lines.repeated_lines(df.where("false")).collect() == []


def test_chunks_are_equal_wherever_a_line_stands():
    a = ["Some line that is repeated on many pages of the site".encode(), b"x" * 25]
    h1, o1 = lines.chunk_hashes([b"before it another one", *a])
    h2, o2 = lines.chunk_hashes([*a, "нечто иное".encode()])
    assert list(h1[o1[1] : o1[2]]) == list(h2[o2[0] : o2[1]])
    assert list(h1[o1[2] : o1[3]]) == list(h2[o2[1] : o2[2]])
    long = [bytes(np.random.default_rng(1).integers(97, 123, 4000, dtype=np.uint8))]
    h, o = lines.chunk_hashes(long)
    assert 20 < len(h) < 200 and o[-1] == len(h)


def test_most_frequent(spark):
    from tesserae.llm.counts import most_frequent

    df = spark.createDataFrame([(f"w{i:02d}", 2**i) for i in range(20)] + [("tie a", 3), ("tie b", 3)], "word string, n bigint")
    assert most_frequent(df, "word", 5) == ["w15", "w16", "w17", "w18", "w19"]
    assert len(most_frequent(df, "word", 19)) == 18  # the ties stay together
    assert len(most_frequent(df, "word", 100)) == 22
    assert most_frequent(df.where("false"), "word", 5) == [] and most_frequent(df.where("n = 3"), "word", 1) == []
