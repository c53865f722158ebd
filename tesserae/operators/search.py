"""Search over an index: matching, ranking, counting, snippets, suggestions, similar documents."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.operators.index import Index
from tesserae.plans import query as ql
from tesserae.plans.compile import compile_query

SNIPPET_BYTES = 200
HISTOGRAM_BINS = 10


def _positions(term: str) -> Column:
    return F.get(F.filter("hits", lambda h: h.term == term), 0).positions


def flags(index: Index, terms: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """One row for each document that holds any of the terms, with each term's positions (empty where it lacks it).

    The terms reach the scan of the postings as a filter; what is shuffled is only their postings."""
    hits = index.postings.where(F.col("term").isin(*terms)).groupBy("doc_id")
    # a list of the document's own postings of these terms: it hashes, where an aggregate of arrays would sort
    rows = hits.agg(F.collect_list(F.struct("term", "positions")).alias("hits"))
    named = {t: f"p{i}" for i, t in enumerate(terms)}
    rows = rows.select("doc_id", *[_positions(t).alias(c) for t, c in named.items()])
    return rows, {t: F.coalesce(F.col(c), F.array().cast("array<int>")) for t, c in named.items()}


@dataclass
class SearchResult:
    query: str
    syntax_valid: bool
    error_message: str = ""
    hits: DataFrame | None = None
    total_found: int = 0
    time_ms: float = 0.0
    rows: list = field(default_factory=list)

    @property
    def doc_ids(self) -> list[int]:
        return [r["doc_id"] for r in self.rows]


class Search:
    def __init__(self, index: Index) -> None:
        self.index = index
        self.log: list[tuple[str, bool, float]] = []

    def match(self, node: ql.Node) -> DataFrame:
        """(doc_id) of the documents that match; the collection is joined only if a document without any term could."""
        terms = ql.terms_of(node)
        docs = self.index.docs.select("doc_id")
        if not terms:
            return docs.where(F.lit(ql.matches_nothing(node)))
        rows, positions = flags(self.index, terms)
        if ql.matches_nothing(node):
            rows = docs.join(rows, "doc_id", "left")
        return rows.where(compile_query(node, positions)).select("doc_id")

    def matching(self, text: str, *, keywords: bool = False) -> DataFrame:
        node = ql.parse_keywords(text) if keywords else ql.parse(text)
        return self.match(ql.optimize(node))

    def detailed(self, text: str) -> DataFrame:
        """(doc_id, score, matches), best first: every hit scores 1.0, so the order is that of ids."""
        return self.matching(text).select("doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("matches")).orderBy(F.desc("score"), "doc_id")

    def top(self, text: str, n: int) -> DataFrame:
        return self.detailed(text).limit(n)

    def count(self, text: str) -> int:
        return self.matching(text).count()

    def exists(self, text: str) -> bool:
        return not self.matching(text).isEmpty()

    def document_matches(self, text: str, doc_id: int) -> DataFrame:
        """(matches) for one document; the id reaches the postings' scan."""
        one = Search(Index(self.index.docs.where(F.col("doc_id") == doc_id), self.index.postings.where(F.col("doc_id") == doc_id), self.index.config))
        return one.matching(text).agg((F.count(F.lit(1)) > 0).alias("matches"))

    def search(self, text: str, limit: int = 100) -> SearchResult:
        """Never raises on bad syntax. Total and best hits come from one job: the total is taken over all matches."""
        began = time.perf_counter()
        try:
            found = self.matching(text)
        except ql.QuerySyntaxError as e:
            took = (time.perf_counter() - began) * 1000
            self.log.append((text, False, took))
            return SearchResult(text, False, str(e), time_ms=took)
        total = found.agg(F.count(F.lit(1)).alias("total_found"))
        best = found.select("doc_id", F.lit(1.0).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)
        rows = total.join(F.broadcast(best), how="left").orderBy("doc_id").collect()  # one row beside at most limit rows
        hits = [r for r in rows if r["doc_id"] is not None]
        took = (time.perf_counter() - began) * 1000
        self.log.append((text, True, took))
        return SearchResult(text, True, "", best, rows[0]["total_found"] if rows else 0, took, hits)

    def batch(self, queries: list[str]) -> DataFrame:
        """(query_id, doc_id) of all valid queries in one job: one read of all their terms' postings."""
        parsed = []
        for i, text in enumerate(queries):
            try:
                parsed.append((i, ql.optimize(ql.parse(text))))
            except ql.QuerySyntaxError:
                continue
        spark = self.index.docs.sparkSession
        if not parsed:
            return spark.createDataFrame([], "query_id int, doc_id bigint")
        terms = list(dict.fromkeys(t for _, node in parsed for t in ql.terms_of(node)))
        rows, positions = flags(self.index, terms)
        if any(ql.matches_nothing(node) for _, node in parsed):
            rows = self.index.docs.select("doc_id").join(rows, "doc_id", "left")
        ids = F.array(*[F.when(compile_query(node, positions), F.lit(i)) for i, node in parsed])
        return rows.select(F.explode(F.array_compact(ids)).alias("query_id"), "doc_id")

    def term_positions(self, term: str, doc_id: int) -> DataFrame:
        return self.index.postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).select(F.explode("positions").alias("position"))

    def suggest(self, prefix: str, k: int = 10, by: str = "term") -> DataFrame:
        """(term, df) of terms that begin with the prefix, by name or by document frequency; an empty prefix has none."""
        if not prefix:
            return self.index.term_stats.select("term", "df").limit(0)
        found = self.index.postings.where(F.col("term").startswith(prefix.lower())).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return found.orderBy("term").limit(k) if by == "term" else found.orderBy(F.desc("df"), "term").limit(k)

    def similar(self, doc_id: int, k: int = 10) -> DataFrame:
        """(doc_id, shared): documents with most terms in common with this one."""
        own = self.index.postings.where(F.col("doc_id") == doc_id).select("term")
        others = self.index.postings.where(F.col("doc_id") != doc_id).join(own, "term", "left_semi")
        return others.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "doc_id").limit(k)

    def snippets(self, text: str, context: int = 10) -> DataFrame:
        """(doc_id, snippet) of every document: a window of tokens around the first hit, hits in brackets; without a hit the
        beginning of the text."""
        try:
            terms = ql.terms_of(ql.parse(text))
        except ql.QuerySyntaxError:
            terms = []
        words = tokens(F.col("content"), self.index.config)
        hit = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
        first = F.array_position(F.transform("ts", lambda t: F.array_contains(hit, t)), True)
        n = F.size("ts")
        lo, hi = F.greatest(F.lit(1), F.col("m") - context), F.least(n, F.col("m") + context)
        marked = F.transform(F.slice("ts", lo, hi - lo + 1), lambda t: F.when(F.array_contains(hit, t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
        window = F.concat(F.when(lo > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(hi < n, "...").otherwise(""))
        start = F.concat(F.substring("content", 1, SNIPPET_BYTES), F.when(F.length("content") > SNIPPET_BYTES, "...").otherwise(""))
        rows = self.index.docs.select("doc_id", "content", F.coalesce(words, F.array().cast("array<string>")).alias("ts")).withColumn("m", first)
        return rows.select("doc_id", F.when(n == 0, "").when(F.col("m") > 0, window).otherwise(start).alias("snippet"))

    def with_metadata(self, hits: DataFrame, metadata: DataFrame) -> DataFrame:
        """Hits with title and url; hits without metadata stay."""
        return hits.join(metadata.select("doc_id", "title", "url"), "doc_id", "left")

    def statistics(self) -> DataFrame:
        """The log of this object's searches: (query, valid, time_ms)."""
        return self.index.docs.sparkSession.createDataFrame(self.log, "query string, valid boolean, time_ms double")

    def reset_statistics(self) -> None:
        self.log.clear()


def result_bitmaps(hits: DataFrame) -> DataFrame:
    """(bucket, bitmap, n): a result set as bits, one row for each range of ids, to be kept or combined."""
    at = F.bitmap_bit_position("doc_id")
    rows = hits.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bitmap"))
    return rows.withColumn("n", F.bitmap_count("bitmap"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id) in one of two result sets and not in the other."""
    return a.select("doc_id").unionByName(b.select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")


# --- pattern search over stored pages ------------------------------------------------------------------------------


def pattern(p: str, *columns: str) -> Column:
    """Whether any of the columns holds the pattern, in any case; a missing column doesn't."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike("(?iu)" + p), F.lit(False)) for c in columns or ("title", "content")])


def pattern_search(rows: DataFrame, text: str) -> DataFrame:
    """The small grammar: patterns joined by && or ||, one pattern, or none of it after !."""
    how, parts = ql.parse_simple(text)
    if how == "not":
        return rows.where(~pattern(parts[0]))
    cond = [pattern(p) for p in parts]
    return rows.where(reduce((lambda a, b: a | b) if how == "or" else (lambda a, b: a & b), cond)) if cond else rows.where(F.lit(False))


def string_snippet(content: Column, needle: str, around: int = 50, otherwise: int = 100) -> Column:
    """The first literal hit with its surroundings, in any case; else the beginning."""
    at = F.locate(needle.lower(), F.lower(content))
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(content), at + len(needle) + around - 1)
    hit = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(content, start, stop - start + 1), F.when(stop < F.length(content), "...").otherwise(""))
    return F.when(at > 0, hit).otherwise(F.substring(content, 1, otherwise))


def preview(content: Column, n: int = 150) -> Column:
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))).otherwise(content)


def latency_summary(times: DataFrame, column: str) -> DataFrame:
    """(n, min, max, median): the upper median. Its aggregate holds each distinct time once with its count."""
    t = times.where(F.col(column).isNotNull()).select(F.col(column).alias("t"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min"), F.max("t").alias("max"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t DESC)").alias("median"))


def latency_histogram(times: DataFrame, column: str) -> DataFrame:
    """(bin, start, count): bins of (max - min + 1) / 10 + 1 whole units from the smallest time; empty ones are left out."""
    t = times.where(F.col(column).isNotNull()).select(F.floor(column).alias("t"))
    edge = t.agg(F.min("t").alias("lo"), F.expr("(max(t) - min(t) + 1) div 10 + 1").alias("width"))
    binned = t.join(F.broadcast(edge)).select(F.expr("(t - lo) div width").alias("bin"), "lo", "width")  # one row beside
    return binned.groupBy("bin").agg(F.first(F.col("lo") + F.col("bin") * F.col("width")).alias("start"), F.count(F.lit(1)).alias("count"))
