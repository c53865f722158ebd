from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import stem, text
from tesserae.operators.index import token_positions, token_rows, token_statistics


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string")


def tokens(spark, s, cfg=text.DEFAULT):
    return spark.createDataFrame([(s,)], "c string").select(text.tokens(F.col("c"), cfg)).first()[0]


def test_tokens_and_positions(spark):
    got = token_positions(rows(spark, "This is a simple test", "foo-bar's x_y 42", "École", "", "...", None)).orderBy("doc_id", "byte_pos").collect()
    assert [(r.doc_id, r.term, r.byte_pos) for r in got] == [
        (0, "this", 0), (0, "is", 5), (0, "simple", 10), (0, "test", 17), (1, "foo", 0), (1, "bar", 4), (1, "42", 14), (2, "école", 0),
    ]
    ascii_fold = token_positions(rows(spark, "École"), text.TokenizerConfig(fold="ascii")).first()
    assert (ascii_fold.term, ascii_fold.byte_len) == ("École", 6)


def test_long_runs_are_cut(spark):
    got = token_positions(rows(spark, "a" * 60, "b" * 51)).orderBy("doc_id", "byte_pos").collect()
    assert [(len(r.term), r.byte_pos) for r in got] == [(51, 0), (9, 51), (51, 0)]
    assert tokens(spark, "ж" * 26) == []  # 52 bytes
    assert tokens(spark, "ж") == ["ж"]  # two bytes


def test_options(spark):
    cfg = text.TokenizerConfig(remove_numbers=True).with_stop_words("the", "and").without_stop_words("and")
    assert tokens(spark, "The 42 abc7 and x1", cfg) == ["abc", "and"]
    assert text.TokenizerConfig.load(cfg.save()) == cfg
    assert tokens(spark, None) is None


def test_statistics(spark):
    s = token_statistics(rows(spark, "ab cd ab", "", None, "xyz")).first()
    assert (s.total_tokens, s.unique_tokens, s.avg_token_bytes, s.tokens_per_document) == (4, 3, 9 / 4, 1.0)
    empty = token_statistics(rows(spark, "x").where("false")).first()
    assert (empty.total_tokens, empty.avg_token_bytes, empty.tokens_per_document) == (0, 0.0, 0.0)


def test_clashing_extra_columns(spark):
    df = rows(spark, "ab cd").withColumn("term", F.lit("x")).withColumn("ord", F.lit(9))
    assert [(r.ord, r.term) for r in token_rows(df).collect()] == [(0, "ab"), (1, "cd")]


def brute(s: str) -> list[tuple[str, int]]:
    stop = set(" \t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    out, run, start, at = [], "", 0, 0
    for ch in s + " ":
        if ch in stop or len(run) == 51:
            size = len(run.lower().encode())
            if run and size >= 2 and (size <= 50 or len(run.lower()) == 51):
                out.append((run.lower(), start))
            run, start = "", at
        if ch in stop:
            start = at + len(ch.encode())
        else:
            run += ch
        at += len(ch.encode())
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abzé жЯ.-_'0\n\t" + "q" * 3, max_size=130), min_size=1, max_size=20))
def test_tokens_like_a_byte_loop(spark, texts):
    got = token_positions(rows(spark, *texts)).orderBy("doc_id", "byte_pos").collect()
    want = [(i, *x) for i, s in enumerate(texts) for x in brute(s)]
    assert [(r.doc_id, r.term, r.byte_pos) for r in got] == want


def test_strings(spark):
    one = spark.createDataFrame([("Zoé A.B..C \t",)], "s string")
    s = F.col("s")
    got = one.select(
        text.byte_find(s, "A"), text.byte_find(s, ""), text.byte_find(s, "?"), text.byte_substr(s, 0, 2).cast("string"), text.split_on(s, "."),
        text.trim(s), text.byte_insert(s, 3, "__").cast("binary"), text.byte_erase(s, 0, 5).cast("string"), text.is_alpha(F.lit("Zoé")), text.is_digit(F.lit("")),
        text.is_delimiter(F.lit("-")), text.is_punctuation(F.lit("«")), text.is_alnum(F.lit("a1")),
    ).first()
    assert list(got)[:6] == [5, -1, -1, "Zo", ["Zoé A", "B", "", "C \t"], "Zoé A.B..C"]
    assert list(got)[7:] == ["A.B..C \t", True, False, True, False, True]


def test_compatibility_stems(spark):
    pairs = {"a": "a", "Cat": "cat", "hello": "hello", "planet": "plane", "testing": "testi", "word123": "word1", "": ""}
    df = spark.createDataFrame([(w,) for w in pairs], "word string")
    assert {r[0]: bytes(r[1]).decode() for r in df.select("word", stem.stem_bytes(F.col("word"))).collect()} == pairs
    s = stem.stem_statistics(df).first()
    assert (s.processed, s.changed, s.bytes_removed) == (7, 4, 5)
    assert stem.stem_statistics(df.where("false")).first().ratio == 1.0


def test_russian_stems(spark):
    pairs = {
        "студенты": "студент", "СтУдЕнТы": "студент", "книгами": "книг", "красивая": "красив", "красивейший": "красив", "важнейшими": "важн", "читающий": "чита",
        "читала": "чита", "вышедши": "вышедш", "бегавшие": "бега", "он": "он", "а": "а", "": "", "hello": "hello", "word123": "word123", "ёлка": "елк",
        "надёжность": "надежн", "длинный": "длин", "радость": "радост", "учиться": "уч", "сделав": "сдела", "территория": "территор",
    }
    df = spark.createDataFrame([(w,) for w in pairs], "word string")
    got = {r[0]: r[1] for r in df.select("word", stem.stem_russian(F.col("word"))).collect()}
    wrong = {w: (got[w], s) for w, s in pairs.items() if got[w] != s}
    assert not wrong
