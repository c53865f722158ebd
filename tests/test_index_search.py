from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.functions.text import TokenizerConfig
from tesserae.operators.index import Index
from tesserae.operators.search import Search, latency_histogram, latency_summary, pattern_search, preview, string_snippet

SCHEMA = "doc_id bigint, title string, url string, content string"


def index(spark, *contents, config=None):
    docs = spark.createDataFrame([(i, f"Title {i}", f"http://x.test/{i}", c) for i, c in enumerate(contents)], SCHEMA)
    return Index.build(docs, config) if config else Index.build(docs)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_statistics(spark):
    s = index(spark, "word1 word2 word3", "word2 word3 word4", "word3 word4 word5").statistics().first()
    assert (s.docs, s.terms, s.postings, s.avg_doc_length, s.avg_term_frequency, s.top_term, s.top_df) == (3, 5, 9, 3.0, 1.8, "word3", 3)
    empty = Index.empty(spark).statistics().first()
    assert (empty.docs, empty.terms, empty.postings, empty.top_term) == (0, 0, 0, None)


def test_frequencies(spark):
    ix = index(spark, "word word word repeat repeat", "word repeat another")
    assert [ix.term_frequency(t).first().cf for t in ("word", "repeat", "another", "missing")] == [4, 3, 1, 0]
    p = ix.find_postings("repeat").where("doc_id = 0").first()
    assert (p.tf, p.positions) == (2, [3, 4])


def test_first_url_wins_and_dirt(spark):
    docs = spark.createDataFrame([(5, "b", "u", "x y"), (3, "a", "u", "first one"), (7, None, None, None), (8, "n", None, ""), (9, "t", "v", "first")], SCHEMA).withColumn("term", F.lit("clash"))
    ix = Index.build(docs)
    assert ids(ix.docs) == [3, 7, 8, 9]
    assert ids(Search(ix).matching("first")) == [3, 9]
    assert ids(Search(ix).matching("!first")) == [7, 8]
    assert [r.violations for r in ix.validate().collect()] == [0, 0, 0, 0]


def test_save_load_export(spark, tmp_path):
    ix = index(spark, "Test content for saving", "Another test content", config=TokenizerConfig(min_bytes=3))
    ix.save(f"file://{tmp_path}/ix")
    again = Index.load(spark, f"file://{tmp_path}/ix")
    assert again.config.min_bytes == 3
    assert sorted(map(tuple, again.postings.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, ix.postings.select("term", "doc_id", "tf").collect()))
    assert again.document_by_url("http://x.test/1").first().title == "Title 1"
    assert again.document_by_position(1).first().doc_id == 1
    assert again.export().first().line == "another\t1\tTitle 1\t1"


def test_add(spark):
    ix = index(spark, "one two")
    more = spark.createDataFrame([(8, "t", "http://x.test/0", "ignored"), (9, "t", "http://x.test/9", "two three")], SCHEMA)
    assert ids(Search(ix.add(more)).matching("two")) == [0, 9]


CARS = ("красный автомобиль быстрый", "синий автомобиль медленный", "красный мотоцикл быстрый")
UNI = ("Московский авиационный институт основан в 1930 году", "Авиационный институт в Москве называется МАИ", "Московский институт авиационный технический")


@pytest.mark.parametrize(
    ("docs", "query", "want"),
    [
        (CARS, "красный && автомобиль", [0]),
        (CARS, "красный || синий", [0, 1, 2]),
        (CARS, "автомобиль && !красный", [1]),
        (CARS, "нет", []),
        (CARS, "!нет", [0, 1, 2]),
        (("кошки собаки домашние животные", "кошки тигры дикие животные", "собаки волки дикие животные"), "(кошки || собаки) && домашние", [0]),
        (UNI, '"Московский авиационный институт"', [0]),
        (UNI, '"московский институт" / 2', [0, 2]),
        (UNI, '"московский институт" / 1', [2]),
        (UNI, '"институт московский" / 5', []),
        (UNI, '""', []),
    ],
)
def test_search(spark, docs, query, want):
    assert ids(Search(index(spark, *docs)).matching(query)) == want


def test_properties(spark):
    ix = index(spark, "a1 b1 c1", "a1 c1 b1", "b1 c1", "", None, "a1 a1 b1")
    s = Search(ix)
    everything = {0, 1, 2, 3, 4, 5}
    for q in ("a1", "a1 && b1", '"a1 b1"', '"a1 b1" / 2'):
        assert set(ids(s.matching(q))) | set(ids(s.matching(f"!({q})"))) == everything
        assert not set(ids(s.matching(q))) & set(ids(s.matching(f"!({q})")))
    assert ids(s.matching("!(a1 || b1)")) == ids(s.matching("!a1 && !b1"))
    near = [set(ids(s.matching(f'"a1 b1" / {n}'))) for n in (0, 1, 2)]
    assert near[0] <= near[1] <= near[2] <= set(ids(s.matching("a1 && b1")))


def test_service(spark):
    s = Search(index(spark, *CARS))
    r = s.search("красный", limit=1)
    assert (r.syntax_valid, r.total_found, r.doc_ids) == (True, 2, [0])
    bad = s.search("invalid query!")
    assert not bad.syntax_valid and bad.error_message
    none = s.search("нет")
    assert (none.total_found, none.doc_ids) == (0, [])
    assert s.statistics().where("valid").count() == 2
    s.reset_statistics()
    assert not s.log
    assert s.count("автомобиль") == 2 and s.exists("мотоцикл") and not s.exists("нет")
    assert s.document_matches("красный", 2).first().matches and not s.document_matches("красный", 1).first().matches
    batch = s.batch(["красный", "broken &&", "!красный"]).collect()
    assert sorted((r.query_id, r.doc_id) for r in batch) == [(0, 0), (0, 2), (2, 1)]
    assert s.batch(["&&"]).collect() == []
    assert [r.position for r in s.term_positions("быстрый", 0).collect()] == [2]


def test_suggest_similar_snippet(spark):
    s = Search(index(spark, "apple application applet approval app", "banana berry blueberry blackberry", "application software app mobile", None))
    assert [r.term for r in s.suggest("APP", 5).collect()] == ["app", "apple", "applet", "application", "approval"]
    assert s.suggest("").collect() == []
    assert [(r.doc_id, r.shared) for r in s.similar(0).collect()] == [(2, 2)]
    snips = {r.doc_id: r.snippet for r in s.snippets("software", 1).collect()}
    assert snips[2] == "application [software] app..."
    assert snips[1].startswith("banana") and snips[3] == ""


def test_patterns_and_previews(spark):
    rows = spark.createDataFrame([(1, "Индекс", None), (2, None, "новый ИНДЕКС"), (3, None, None)], "page_id int, title string, content string")
    assert [r.page_id for r in pattern_search(rows, "индекс").orderBy("page_id").collect()] == [1, 2]
    assert [r.page_id for r in pattern_search(rows, "!индекс").collect()] == [3]
    assert [r.page_id for r in pattern_search(rows, "нов && индекс").collect()] == [2]
    one = spark.createDataFrame([("x" * 60 + "Needle" + "y" * 60,)], "c string")
    assert one.select(string_snippet(F.col("c"), "needle")).first()[0] == "..." + "x" * 50 + "Needle" + "y" * 50 + "..."
    assert one.select(string_snippet(F.col("c"), "none")).first()[0] == ("x" * 60 + "Needle" + "y" * 34)
    assert one.select(preview(F.col("c"), 3)).first()[0] == "xxx..."


def test_latency(spark):
    t = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 40, None or 100)], "v double")
    s = latency_summary(t, "v").first()
    assert (s.n, s.min, s.max, s["median"]) == (5, 1.0, 100.0, 3.0)
    even = latency_summary(t.where("v < 100"), "v").first()
    assert even["median"] == 3.0
    h = {r.bin: (r.start, r["count"]) for r in latency_histogram(t, "v").collect()}
    assert h == {0: (1, 3), 3: (34, 1), 9: (100, 1)}
