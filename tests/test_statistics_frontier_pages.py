from __future__ import annotations

import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import frontier, zipf
from tesserae.sources import config, lines, pages
from tesserae.streaming.ingest import append_postings, event_windows


def freq(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "term string, frequency bigint")


def test_ranks_fit_and_growth(spark):
    counts = {f"t{i:03d}": max(1, 1000 // i) for i in range(1, 201)}
    ranked = zipf.rank_frequency(freq(spark, **counts)).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 201))
    assert [(r.term, r.frequency) for r in ranked] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    x, y = np.log([r.rank for r in ranked]), np.log([r.frequency for r in ranked])
    slope, intercept = np.polyfit(x, y, 1)
    fit = zipf.zipf_fit(zipf.rank_frequency(freq(spark, **counts))).first()
    assert math.isclose(fit.s, -slope, rel_tol=1e-9) and math.isclose(fit.c, math.exp(intercept), rel_tol=1e-9)
    grown = zipf.vocabulary_growth(freq(spark, **counts)).orderBy("size").collect()
    assert len(grown) == 100 and grown[1].tokens == 1500
    f = np.array(sorted(counts.values()))
    n = len(f)
    assert math.isclose(zipf.gini(freq(spark, **counts)).first().gini, float(((2 * np.arange(1, n + 1) - n - 1) * f).sum() / (n * f.sum())), rel_tol=1e-9)
    p = f / f.sum()
    assert math.isclose(zipf.entropy(freq(spark, **counts)).first().entropy, float(-(p * np.log2(p)).sum()), rel_tol=1e-9)
    assert zipf.report(freq(spark, **counts)).count() == 1


def test_degenerate_statistics(spark):
    none, one = freq(spark, a=1).where("false"), freq(spark, a=5)
    assert zipf.entropy(none).first().entropy == 0.0 and zipf.gini(none).first().gini == 0.0 and zipf.gini(one).first().gini == 0.0
    assert zipf.zipf_fit(zipf.rank_frequency(one)).first().r2 == 0.0
    assert zipf.concentration(zipf.rank_frequency(one)).first().top10 is None
    assert zipf.type_token_ratio(none).first().ratio == 0.0
    assert zipf.frequency_statistics(none).first().total == 0


def test_zipf_words(spark):
    df = spark.createDataFrame([('The (cat), "sat" a an! the...',), (None,), ("",)], "content string")
    assert {r.term: r.frequency for r in zipf.term_frequencies(df).collect()} == {"the": 2, "cat": 1, "sat": 1, "an": 1}


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://A.test/X#y",), ("a.test:80/b",), (None,)], "url string")
    assert [r[0] for r in df.select(frontier.normalize_url(F.col("url"))).collect()] == ["http://a.test/x", "http://a.test:80/b", None]
    r = spark.createDataFrame([("http://a.test/d/e?q", x) for x in ("f", "/g", "//b.test/h", "https://c.test/")], "b string, l string")
    assert [x[0] for x in r.select(frontier.resolve(F.col("b"), F.col("l"))).collect()] == ["http://a.test/d/f", "http://a.test/g", "http://b.test/h", "https://c.test/"]


def test_crawl(spark):
    p = spark.createDataFrame([("http://a.test/1", ["/2", "/3", ""]), ("http://a.test/2", ["/1", "/4"]), ("http://a.test/4", ["/5"]), ("http://a.test/3", None)], "url string, links array<string>")
    start = spark.createDataFrame([("http://A.test/1",), ("http://a.test/1#x",), (None,)], "url string")
    got = {r.url[-1]: r.depth for r in frontier.crawl(p, start, 2).collect()}
    assert got == {"1": 0, "2": 1, "3": 1, "4": 2}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nDisallow: /\n# note\nUser-agent: bot\nUser-agent: other\nDisallow: /tmp\nAllow: /x\nDisallow:\n"
    rules = frontier.parse_robots(spark.createDataFrame([("a.test", text), ("e.test", ""), ("n.test", None)], "domain string, text string"))
    assert sorted(map(tuple, rules.collect())) == [("a.test", "*", "/"), ("a.test", "*", "/private"), ("a.test", "bot", "/tmp"), ("a.test", "other", "/tmp")]
    urls = spark.createDataFrame([("http://a.test/tmp/x",), ("http://A.test/private",), ("http://a.test/ok",), ("http://b.test/tmp",)], "url string")
    assert sorted(r.url[-6:] for r in frontier.allowed(urls, rules, "bot").collect()) == ["est/ok", "st/tmp"]
    assert [r.url for r in frontier.allowed(urls, rules, "bot", strict=True).collect()] == ["http://b.test/tmp"]


def test_queue_and_failed(spark):
    f = spark.createDataFrame([("http://a/1", 2, 1, "pending"), ("HTTP://a/1", 1, 5, "queued"), ("http://a/2", 1, 3, "pending"), ("http://a/3", 0, 4, None)], "url string, depth int, seq bigint, state string")
    assert [(r.url[-1], r.depth) for r in frontier.queue(f).collect()] == [("2", 1), ("1", 1)]
    assert frontier.mark_failed(f, f.limit(1).select("url")).where("state = 'failed'").count() == 2
    assert {r.state for r in frontier.frontier_statistics(f).collect()} == {"pending", "queued", "unknown"}


def test_store(spark):
    t = lambda d: datetime(2024, 1, d)
    p = spark.createDataFrame([(1, "u", t(1), True), (2, "u", t(3), False), (3, "u", t(2), None), (4, None, t(1), None), (5, None, None, True)], "page_id bigint, url string, crawled_at timestamp, processed boolean")
    up = {r.page_id: r.created_at for r in pages.upsert(p).collect()}
    assert set(up) == {2, 4, 5} and up[2] == t(1)
    new = spark.createDataFrame([(9, "u", t(9), True)], p.schema)
    assert {r.page_id for r in pages.upsert(p, new).collect()} == {9, 4, 5}
    assert pages.unprocessed(p).count() == 3
    assert pages.mark_processed(p, p.where("page_id = 2")).where("processed").count() == 3
    assert [r.page_id for r in pages.find(p, skip=1, limit=2).collect()] == [2, 3]
    assert pages.updated(p, F.col("url") == "u", processed=F.lit(True)).where("processed").count() == 4
    assert pages.deleted(p, F.col("url") == "u").count() == 2
    assert pages.upsert(p.where("false")).count() == 0


HTML = """<html><head><title>Page &amp; title</title><meta name="Author" content="me"><script>var a='</p>';</script></head><body><nav><a href="/n">menu</a></nav>
<main><h1>Head</h1><p>First paragraph, long enough to be counted as the text of the page, with a <a href="/in?x=1">link</a>.</p>
<p>Second paragraph, which also is here so that there are more than a hundred characters.</p><a href="mailto:x@y">m</a><a href="/p.pdf">p</a></main>
<footer>foot</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "http://a.test/d/", HTML), (2, None, ""), (3, "x", None), (4, "http://de.wikipedia.org/wiki/X", '<div id="mw-content-text"><p>Text one</p><table><tr><td>t</td></tr></table><a href="/wiki/Y">y</a><a href="/wiki/F:Z">z</a></div>')], "page_id bigint, url string, html_content string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].parser == "generic" and got[1].title == "Head" and got[1].metadata == {"author": "me"}
    assert got[1].links == ["http://a.test/n", "http://a.test/in?x=1"]
    assert "First paragraph" in got[1].content and "menu" not in got[1].content and "foot" not in got[1].content
    assert got[4].parser == "wiki" and got[4].links == ["http://de.wikipedia.org/wiki/Y"]
    assert df.select(pages.html_title(F.col("html_content"))).first()[0] == "Page & title"
    assert df.select(pages.detect_encoding(F.lit("text/html; charset=KOI8-R"), F.col("html_content"))).first()[0] == "koi8-r"


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first line\n\nsecond line\n")
    got = lines.read_lines(spark, f"file://{tmp_path}/a.txt").orderBy("doc_id").collect()
    assert [(r.doc_id, r.title, r.url[-7:], r.content) for r in got] == [(0, "Document 1", "a.txt#1", "first line"), (1, "Document 2", "a.txt#2", "second line")]
    (tmp_path / "stop.txt").write_text("The\nand\n\nthe\n")
    assert lines.read_stop_words(spark, f"file://{tmp_path}/stop.txt") == ("and", "the")
    assert [r.word for r in lines.read_words(spark, f"file://{tmp_path}/a.txt").collect()] == ["first", "line", "second", "line"]
    docs = spark.createDataFrame([(1, " T\n1 ", "u", "a\r\nb"), (2, None, "u", "c"), (3, "x", "u", ""), (4, "x", "u", None)], "doc_id bigint, title string, url string, content string")
    assert [(r.doc_id, r.line) for r in lines.export_lines(docs).orderBy("doc_id").collect()] == [(1, "T 1. a b"), (2, ". c")]
    assert [r.line_id for r in lines.export_with_metadata(docs).orderBy("doc_id").collect()] == [0, 1]
    lines.write_csv(docs.select("doc_id", "title"), f"file://{tmp_path}/csv")
    lines.write_json(docs, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 4


def test_config(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    config.save({"db": {"host": "${HOST:localhost}", "ports": ["${PORT}"]}}, path)
    c = config.load(path, {"PORT": "1"})
    assert config.get(c, "db.host") == "localhost" and config.get(c, "db.ports") == ["1"] and config.get(c, "db.none", 3) == 3


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd"), (2, "ab")], "doc_id bigint, content string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id bigint, content string").parquet(f"file://{tmp_path}/in")
    append_postings(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").where("term = 'ab'").count() == 2
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "x", 1.0), (datetime(2024, 1, 1, 0, 50), "x", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.total) for r in event_windows(events).collect()] == [(2, 3.0)]
