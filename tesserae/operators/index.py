"""The inverted index as DataFrames: documents, postings, term statistics.

Documents: (doc_id, title, url, content); the first of a url stays (null urls all stay). Postings: (term, doc_id, tf,
positions), positions being ordinals over the kept tokens. Null content has no tokens; such documents belong to the
collection all the same."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import DEFAULT, TokenizerConfig, kept, normalize, segments, tokens
from tesserae.plans.shared import shared_dir, written


def first_of_url(docs: DataFrame) -> DataFrame:
    """One document for each url, the one with the smallest id."""
    first = docs.where("url is not null").groupBy("url").agg(F.min("doc_id").alias("doc_id"))
    kept_ids = first.select("doc_id").unionByName(docs.where("url is null").select("doc_id"))
    return docs.join(kept_ids, "doc_id", "left_semi")


def token_rows(docs: DataFrame, cfg: TokenizerConfig = DEFAULT, text: str = "content") -> DataFrame:
    """(doc_id, ord, term): no shuffle, ordinals come from the position in the token array."""
    return docs.select("doc_id", F.posexplode(tokens(F.col(text), cfg)).alias("ord", "term"))


def token_positions(docs: DataFrame, cfg: TokenizerConfig = DEFAULT, text: str = "content") -> DataFrame:
    """(doc_id, byte_pos, byte_len, term): tokens with the byte offset and length of their raw form."""
    parts = docs.select("doc_id", F.posexplode(segments(F.col(text))).alias("i", "raw")).withColumn("byte_len", F.octet_length("raw"))
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("byte_pos", F.coalesce(F.sum("byte_len").over(order), F.lit(0)))
    parts = parts.where(~F.substring("raw", 1, 1).rlike("[\\t\\n\\x0B\\f\\r !-/:-@\\[-`{-~]")).withColumn("term", normalize(F.col("raw"), cfg))
    return parts.where(kept(F.col("term"), cfg)).select("doc_id", "byte_pos", "byte_len", "term")


def postings_of(docs: DataFrame, cfg: TokenizerConfig = DEFAULT) -> DataFrame:
    """(term, doc_id, tf, positions): a document is one row, so its postings are made inside it, without a shuffle. Its tokens
    are sorted by term and place; where a term begins, the places up to the next one are its positions."""
    placed = F.transform(tokens(F.col("content"), cfg), lambda t, i: F.struct(t.alias("term"), i.alias("ord")))
    rows = docs.select("doc_id", F.sort_array(placed).alias("s")).where(F.size("s") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i).term != F.get("s", i - 1).term))
    rows = rows.withColumn("at", first).withColumn("places", F.col("s.ord")).withColumn("terms", F.transform("at", lambda i: F.get("s", i).term))
    end = lambda k: F.coalesce(F.get("at", k + 1), F.size("places"))
    post = F.transform("at", lambda i, k: F.struct(F.get("terms", k).alias("term"), F.slice("places", i + 1, end(k) - i).alias("positions")))
    rows = rows.select("doc_id", F.explode(post).alias("p"))
    return rows.select("p.term", "doc_id", F.size("p.positions").alias("tf"), "p.positions")


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    config: TokenizerConfig = DEFAULT

    @staticmethod
    def build(docs: DataFrame, config: TokenizerConfig = DEFAULT) -> Index:
        docs = first_of_url(docs.select("doc_id", "title", "url", "content"))
        return Index(docs, postings_of(docs, config), config)

    @staticmethod
    def empty(spark: SparkSession) -> Index:
        docs = spark.createDataFrame([], "doc_id bigint, title string, url string, content string")
        return Index(docs, postings_of(docs))

    @property
    def terms(self) -> DataFrame:
        return self.postings.select("term").distinct()

    @property
    def term_stats(self) -> DataFrame:
        return term_statistics(self.postings)

    def add(self, docs: DataFrame) -> Index:
        """The index with more documents; urls that are there already stay as they are."""
        new = docs.join(self.docs.select("url"), "url", "left_anti").select("doc_id", "title", "url", "content")
        return Index(self.docs.unionByName(first_of_url(new)), self.postings.unionByName(postings_of(first_of_url(new), self.config)), self.config)

    def find_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def term_frequency(self, term: str) -> DataFrame:
        return self.find_postings(term).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("cf"))

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def document_by_url(self, url: str) -> DataFrame:
        return self.docs.where(F.col("url") == url)

    def document_by_position(self, position: int) -> DataFrame:
        return self.docs.orderBy("doc_id").offset(position).limit(1)

    def statistics(self) -> DataFrame:
        """(docs, terms, postings, avg_doc_length, avg_term_frequency, top_term, top_df): lengths are distinct terms of a
        document, the mean of term frequency is postings by terms, ties go to the smaller term."""
        per_term = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        words = per_term.agg(
            F.count(F.lit(1)).alias("terms"),
            F.coalesce(F.sum("df"), F.lit(0)).alias("postings"),
            F.min(F.struct((-F.col("df")).alias("n"), "term")).alias("top"),
        )
        docs = self.docs.agg(F.count(F.lit(1)).alias("docs"))
        both = docs.join(F.broadcast(words))  # one row each
        return both.select(
            "docs", "terms", "postings",
            F.coalesce(F.try_divide("postings", "docs"), F.lit(0.0)).alias("avg_doc_length"),
            F.coalesce(F.try_divide("postings", "terms"), F.lit(0.0)).alias("avg_term_frequency"),
            F.col("top.term").alias("top_term"),
            (-F.col("top.n")).alias("top_df"),
        )

    def validate(self) -> DataFrame:
        """(check, violations): repeated ids and urls, postings without a document, frequencies that differ from positions."""
        checks = [
            ("duplicate ids", self.docs.groupBy("doc_id").count().where("count > 1")),
            ("duplicate urls", self.docs.where("url is not null").groupBy("url").count().where("count > 1")),
            ("postings without document", self.postings.join(self.docs, "doc_id", "left_anti")),
            ("frequency differs from positions", self.postings.where(F.col("tf") != F.size("positions"))),
        ]
        rows = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, d in checks]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def optimized(self, partitions: int | None = None) -> DataFrame:
        """Postings range-partitioned and sorted by term and document, as they are written."""
        keys = ("term", "doc_id")  # a frequent term fills several partitions
        by = self.postings.repartitionByRange(partitions, *keys) if partitions else self.postings.repartitionByRange(*keys)
        return by.sortWithinPartitions("term", "doc_id")

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.optimized().write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.docs.sparkSession
        spark.createDataFrame([(self.config.save(),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        config = TokenizerConfig.load(spark.read.json(f"{path}/config").first()["config"])
        return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), config)

    def saved(self, name: str = "index") -> Index:
        """The index written to the shared folder and read again, so that queries read postings and not texts."""
        path = f"{shared_dir(self.docs.sparkSession)}/{name}-{uuid.uuid4().hex}"
        self.save(path)
        written(self.docs.sparkSession, path)
        return Index.load(self.docs.sparkSession, path)

    def export(self) -> DataFrame:
        """(line): terms in order, under each its documents with title and frequency."""
        rows = self.postings.join(self.docs.select("doc_id", "title"), "doc_id")
        lines = rows.select("term", "doc_id", F.concat_ws("\t", "term", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.col("tf").cast("string")).alias("line"))
        return lines.orderBy("term", "doc_id").select("line")


def build_statistics(docs: DataFrame, cfg: TokenizerConfig = DEFAULT) -> DataFrame:
    """(processed, skipped, tokens, unique_tokens) of a build: documents kept, documents whose url was there already, and
    their tokens. To be written with sources.lines.write_json or write_csv."""
    kept_docs = first_of_url(docs)
    words = token_rows(kept_docs, cfg).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("unique_tokens"))
    counts = kept_docs.agg(F.count(F.lit(1)).alias("processed")).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("given"))))  # one row each
    return counts.join(F.broadcast(sums)).select("processed", (F.col("given") - F.col("processed")).alias("skipped"), "tokens", "unique_tokens")


def token_statistics(docs: DataFrame, cfg: TokenizerConfig = DEFAULT, text: str = "content") -> DataFrame:
    """(total_tokens, unique_tokens, avg_token_bytes, tokens_per_document); documents without tokens count."""
    words = token_rows(docs, cfg, text).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sums = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"),
        F.count(F.lit(1)).alias("unique_tokens"),
        F.coalesce(F.sum(F.octet_length("term") * F.col("n")), F.lit(0)).alias("bytes"),
    )
    both = docs.agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(sums))  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("total_tokens", "unique_tokens", ratio("bytes", "total_tokens").alias("avg_token_bytes"), ratio("total_tokens", "docs").alias("tokens_per_document"))
