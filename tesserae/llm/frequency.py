"""Problem 4: how often every distinct term occurs, in how many records, and a mark on the rare and the common.

Method: blocks of records are counted where they lie (one row per block and term leaves the block), the rows are
spread over identifier ranges by a hash of the term, and every range numbers its terms and sums the blocks' counts
in arrays by that number. The number of the range and the number inside it form the term's global integer.

Defined results: null content is no record; empty or blank content is a record without terms; null terms are left
out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.shared import shuffle_partitions

# The characters of a term, and the marks.
TERM = "[0-9a-z\u00df-\u00f6\u00f8-\u024f\u0400-\u04ff]+"
RARE_DF, RARE_CF, COMMON = 2, 4, 4

BLOCK_TERMS = 400_000  # distinct terms held by a block before its counts leave it
RANGE_ROWS = 100_000  # rows of the input for each identifier range
BLOCKS = "origin string, term string, cf bigint, df bigint"


def _rows(origin: str, cf: Counter, df: Counter) -> pa.RecordBatch:
    terms = list(cf)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([origin] * len(terms), pa.string()),
            pa.array(terms, pa.string()),
            pa.array(list(cf.values()), pa.int64()),
            pa.array([df[t] for t in terms], pa.int64()),
        ],
        ["origin", "term", "cf", "df"],
    )


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(TERM).findall
    cf, df = Counter(), Counter()
    for batch in batches:
        for text in batch.column(0):
            terms = find(text.as_py().lower())
            cf.update(terms)
            df.update(set(terms))
            if len(cf) > BLOCK_TERMS:
                yield _rows("pages", cf, df)
                cf, df = Counter(), Counter()
    yield _rows("pages", cf, df)


def _posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cf, df = Counter(), Counter()
    for batch in batches:
        for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cf[term] += n
            df[term] += 1
        if len(cf) > BLOCK_TERMS:
            yield _rows("postings", cf, df)
            cf, df = Counter(), Counter()
    yield _rows("postings", cf, df)


def _sum_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[tuple[str, str], int] = {}
    cf, df = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        codes = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), np.int64, batch.num_rows)
        while len(ids) > len(cf):
            cf, df = np.concatenate([cf, np.zeros_like(cf)]), np.concatenate([df, np.zeros_like(df)])
        np.add.at(cf, codes, batch.column(2).to_numpy())
        np.add.at(df, codes, batch.column(3).to_numpy())
    n, first = len(ids), TaskContext.get().partitionId() << 32
    keys = list(ids)
    for i in range(0, n, 50_000):
        part = keys[i : i + 50_000]
        m = len(part)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(i, i + m) + first),
                pa.array([k[0] for k in part], pa.string()),
                pa.array([k[1] for k in part], pa.string()),
                pa.array(cf[i : i + m]),
                pa.array(df[i : i + m]),
            ],
            ["term_id", "origin", "term", "cf", "df"],
        )


def term_frequencies(pages: DataFrame, postings: DataFrame) -> DataFrame:
    """(term_id, origin, term, cf, df): every term of ``pages.content`` and of the postings with both counts.

    Postings equal in term, doc_id and positions count once (of differing frequencies the largest); a frequency that
    is null or below 1 stands for the number of positions."""
    spark = pages.sparkSession
    texts = pages.select("content").where(F.col("content").isNotNull()).mapInArrow(_text_blocks, BLOCKS)
    term = F.lower("term")
    freq = F.when(F.col("frequency") >= 1, F.col("frequency")).otherwise(F.coalesce(F.array_size("positions"), F.lit(0)))
    once = (
        postings.where(F.col("term").isNotNull())
        .select("term", term.alias("lterm"), "doc_id", "positions", freq.cast("bigint").alias("f"))
        .repartition("lterm", "doc_id")
        .groupBy("lterm", "doc_id", "term", "positions")
        .agg(F.max("f").alias("f"))
        .groupBy("lterm", "doc_id")
        .agg(F.sum("f").alias("f"))
    )
    counted = once.select(F.col("lterm"), "f").mapInArrow(_posting_blocks, BLOCKS)
    # as many ranges as the data need: a range's dictionary is held by one task
    ranges = max(shuffle_partitions(spark), (pages.count() + postings.count()) // RANGE_ROWS)
    return (
        texts.unionByName(counted)
        .repartition(ranges, "origin", "term")
        .mapInArrow(_sum_range, "term_id bigint, origin string, term string, cf bigint, df bigint")
    )


def marked_terms(pages: DataFrame, postings: DataFrame) -> DataFrame:
    """(origin, term, cf, df, n, mark) of every term; mark is ``common``, ``rare`` or null."""
    totals = (
        pages.where(F.col("content").isNotNull())
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("pages").alias("origin"), "n")
        .unionByName(
            postings.where(F.col("term").isNotNull())
            .agg(F.countDistinct("doc_id").alias("n"))
            .select(F.lit("postings").alias("origin"), "n")
        )
    )
    mark = F.when(COMMON * F.col("df") > F.col("n"), "common").when((F.col("df") <= RARE_DF) & (F.col("cf") <= RARE_CF), "rare")
    # two rows at any size
    return term_frequencies(pages, postings).join(F.broadcast(totals), "origin").withColumn("mark", mark)
