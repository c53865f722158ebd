"""Problem 10: texts that look the same but differ in their characters.

Method: in SQL, characters are mapped to one look-alike each (full-width and joined forms, kinds of blanks and hyphens,
letters of other scripts; invisible ones go), texts are grouped under the accent-sensitive collation UNICODE, under
which composed and combining accents are equal, each class gets a canonical member (of the texts in it the one most
often stored, then the smallest), and the member is joined back to every document.

Defined results: null texts and texts that show nothing keep themselves as form and take no part in pairs; е and ё,
digits, words and punctuation stay different; plain copies are in one class and form no pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize

# Fixed values. Look-alike letters: each of the first string is drawn as the letter below it in the second.
CYRILLIC = "АВЕКМНОРСТУХІЈЅЁЇаеорсухіјѕёїһԁԛԝ"
CYRILLIC_AS = "ABEKMHOPCTYXIJSËÏaeopcyxijsëïhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ"
GREEK_AS = "ABEZHIKMNOPTYXaovp"
# Kinds of blanks, kinds of hyphens, and what can't be seen.
SPACES = "\t               　"
HYPHENS = "‐‑‒⁃﹣"
INVISIBLE = (
    "­͏؜᠎​‌‍‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤︎️﻿\r"
)
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# The full-width forms lie in one block, in the order of ASCII.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
WIDE_AS = "".join(map(chr, range(0x21, 0x7F)))


def look_map() -> dict[str, str]:
    """Single characters and what they look like; what can't be seen maps to nothing."""
    pairs = dict(zip(CYRILLIC + GREEK + WIDE, CYRILLIC_AS + GREEK_AS + WIDE_AS, strict=True))
    return pairs | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(INVISIBLE, "")


def look(text: Column) -> Column:
    """The text with every character replaced by the one it looks like, blanks at the ends off."""
    single = {k: v for k, v in look_map().items() if v}
    text = F.translate(text, "".join(single) + INVISIBLE, "".join(single.values()))
    for joined, parts in JOINED.items():
        text = F.replace(text, F.lit(joined), F.lit(parts))
    # the short u is the only composed letter whose base has a look-alike and that has no composed form there
    text = F.replace(F.replace(text, F.lit("ў"), F.lit("y\u0306")), F.lit("Ў"), F.lit("Y\u0306"))
    return F.trim(text)


PAIR_ROWS = 20_000  # rows of one class that meet one task
SALTS = 16
BROADCAST_ROWS = 500_000  # of two short keys: about 40 MB


def _unsteady() -> str:
    """Blanks, accents and other marks, and characters that show nothing."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cc", "Cf", "Zs", "Zl", "Zp"))]
    runs, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        if b != a + 1:
            runs.append((start, a))
            start = b
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]+"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # what the collation may leave out: texts that look the same agree in all else
    table, unsteady = str.maketrans(look_map() | JOINED), re.compile(_unsteady())
    for batch in batches:
        ids, steady, keys = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            looks = text.translate(table)
            if not looks.isspace() and looks:
                ids.append(doc)
                bare = unsteady.sub("", looks if looks.isascii() else unicodedata.normalize("NFD", looks))
                steady.append(int.from_bytes(blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
                keys.append(md5(text.encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(steady, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "steady", "text_key"]
        )


def _members(documents: DataFrame) -> DataFrame:
    """(doc_id, class_key, text_key) of documents that look like another document with a different text.

    A hash of the steady letters first sets aside all documents without a partner, so that only candidate texts are
    shuffled and collated, each distinct text once."""
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = materialize(texts.mapInArrow(_keys, "doc_id bigint, steady bigint, text_key binary"), "p10-keys")
    mixed = rows.groupBy("steady").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("steady")
    first = materialize(rows.join(mixed, "steady", "left_semi").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")), "p10-first")
    texts = _join_small(texts, first, ["doc_id"]).select("text_key", F.collate(look(F.col("text")), "UNICODE").alias("look"))
    same = Window.partitionBy("look")
    classes = texts.select("text_key", F.min("text_key").over(same).alias("class_key"), F.count(F.lit(1)).over(same).alias("texts")).where("texts > 1")
    classes = materialize(classes.drop("texts"), "p10-classes")
    return _join_small(rows, classes, ["text_key"]).select("doc_id", "class_key", "text_key")


def _join_small(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with a written table of candidates, which holds each key once: it goes to every task if it is small, else
    both are shuffled, the key salted by document, as copies of one text may be many."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    if keys == ["doc_id"]:
        return rows.join(table, keys)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents with different texts that look the same.

    Plain copies (however many) form no pair and leave before the join unless a different text looks like them; within
    a class only pairs of different texts are formed, which are the result itself. The rows of a large class are spread over as
    many tasks as its size asks for, each of which meets the class's other rows."""
    rows = materialize(_members(documents), "p10-members")
    sizes = rows.groupBy("class_key").agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).cast("int").alias("parts"))
    rows = rows.join(sizes, "class_key")
    left = rows.select(F.col("doc_id").alias("doc_a"), "class_key", F.col("text_key").alias("text_a"), F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    right = rows.select(F.col("doc_id").alias("doc_b"), "class_key", F.col("text_key").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["class_key", "part"]).where("text_a <> text_b and doc_a < doc_b").select("doc_a", "doc_b")


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_doc, texts, documents): each document that looks like one with a different text, the class it is in (named
    by its smallest document), and how many different texts and documents the class has: the pairs without expanding them."""
    rows = _members(documents)
    texts = rows.groupBy("class_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    classes = texts.groupBy("class_key").agg(F.min("doc_id").alias("class_doc"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("documents"))
    # copies of one text share its row: a class's members are spread before they meet it
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(classes, ["class_key", "salt"]).select("doc_id", "class_doc", "texts", "documents")


def one_form(documents: DataFrame) -> DataFrame:
    """(doc_id, form, changed): every document with the canonical text of its class; documents that look alike are equal."""
    rows = _members(documents)
    sizes = rows.groupBy("class_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    best = sizes.groupBy("class_key").agg(F.min_by("doc_id", F.struct(-F.col("n"), F.col("text_key"))).alias("doc_id"))
    forms = documents.join(best, "doc_id").select("class_key", F.col("text").alias("form"))
    to = rows.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
    salted = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    to = to.join(salted, ["class_key", "salt"]).select("doc_id", "form")
    joined = documents.select("doc_id", "text").join(to, "doc_id", "left")
    form = F.coalesce("form", "text")
    return joined.select("doc_id", form.alias("form"), (~form.eqNullSafe(F.col("text"))).alias("changed"))
