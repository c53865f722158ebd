"""Problem 7: lines that stand in many documents of one site.

Method: the normalised lines form one byte stream per batch; a rolling (gear) hash over the last 16 bytes cuts it
where the hash's top bits are zero, records end a chunk as well, so equal lines have equal chunks wherever they
stand. Distinct urls are counted per site and chunk, a line is a candidate if its heaviest chunk is repeated, and
the exact count of whole lines follows on the candidates only.

Defined results: null domain or content takes no part; a null url is one url of its own; lines whose normal form is
shorter than MIN_CHARS are never repeated; repeated rows of one url count once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize

MIN_CHARS, MIN_URLS = 20, 6  # fixed by the problem
CUT_BITS = 6  # a cut every 64 bytes on average
SALTS = 16
BLANKS = re.compile("[ \t\r\u00a0]+")
LINES = "page_id bigint, domain string, url bigint, line_no int, line binary, chunks array<bigint>"

_rng = np.random.default_rng(7)
_GEAR = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: str) -> str:
    return BLANKS.sub(" ", line).strip(" ").lower()


def chunk_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all chunks of all lines, and where each line's chunks begin (one more offset than lines)."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    ends = np.cumsum([len(x) for x in lines])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(lines) + 1, np.int64)
    value = _GEAR[data]
    rolling = value.copy()
    for step in (1, 2, 4, 8):  # after these the hash covers 16 bytes
        rolling[step:] += rolling[:-step] << np.uint64(step)
    position = np.arange(len(data)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    cut = ((rolling >> np.uint64(64 - CUT_BITS)) == 0) & (position >= 15)  # windows that lie inside their line
    cut[ends[ends > 0] - 1] = True
    stops = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], stops[:-1]])
    # polynomial hash of each chunk: sum of value * base^(offset from the chunk's start)
    within = np.arange(len(data)) - np.repeat(starts, stops - starts)
    powers = np.ones(int(within.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _BASE, np.uint64), out=powers[1:])
    hashes = np.add.reduceat(value * powers[within], starts)
    return hashes, np.concatenate([[0], np.searchsorted(stops, ends, side="right")])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows, texts = [], []
            for page, domain, url, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for i, line in enumerate(BLANKS.sub(" ", content).lower().split("\n"), 1):
                    line = line.strip(" ")
                    if len(line) >= MIN_CHARS:
                        rows.append((page, domain, url, i))
                        texts.append(line.encode("utf-8", "surrogatepass"))
            hashes, offsets = chunk_hashes(texts)
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int32()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64))),
                ],
                ["page_id", "domain", "url", "line_no", "line", "chunks"],
            )


def _urls_at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys that stand with at least n distinct urls: distinct first, then counted, so no hot key meets one task."""
    return df.select(*keys, "url").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("urls")).where(F.col("urls") >= n)


def _with_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows whose keys are hot. The keys of a big site are salted; the hot side holds each key once for each salt."""
    hot = hot.select(*keys, "urls", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return df.withColumn("salt", F.pmod(F.col("page_id"), F.lit(SALTS)).cast("int")).join(hot, [*keys, "salt"]).drop("salt")


def repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(page_id, line_no, domain, urls): every occurrence of a line repeated within its domain, with its number of urls."""
    texts = pages.where(F.col("domain").isNotNull() & F.col("content").isNotNull()).select(
        "page_id", "domain", F.xxhash64(F.coalesce("url", F.lit("\0"))).alias("url"), "content"
    )
    lines = materialize(texts.mapInArrow(_lines, LINES), "p7-lines")
    chunks = _urls_at_least(lines.select("domain", "url", F.explode("chunks").alias("chunk")), ["domain", "chunk"], min_urls)
    heaviest = lines.withColumn("chunk", F.array_max("chunks")).drop("chunks")  # the same one in every copy of the line
    candidates = _with_hot(heaviest, chunks, ["domain", "chunk"]).drop("urls", "chunk")
    exact = _urls_at_least(candidates, ["domain", "line"], min_urls)
    return _with_hot(candidates, exact, ["domain", "line"]).select("page_id", "line_no", "domain", "urls")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for content, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if content is not None and gone:
                drop = set(gone)
                content = "\n".join(x for i, x in enumerate(content.split("\n"), 1) if i not in drop)
            texts.append(content)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([len(x or ()) for x in batch.column(2).to_pylist()], pa.int32())],
            ["page_id", "content", "lines_cut"],
        )


def without_repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(page_id, content, lines_cut): every page, its repeated lines cut; null content stays null."""
    gone = repeated_lines(pages, min_urls).groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))  # a page's own lines only
    joined = pages.select("page_id", "content").join(gone, "page_id", "left")
    return joined.select("page_id", "content", "gone").mapInArrow(_cut, "page_id bigint, content string, lines_cut int")
