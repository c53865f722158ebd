"""Line corpora, url lists, stop words, word files; and what is written back as lines, CSV or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize


def dense_ids(rows: DataFrame, *order: str, name: str = "doc_id") -> DataFrame:
    """Ids 0, 1, ... in the given order, without one task that holds all rows: a range-partitioned sort, numbered by the
    sizes of its partitions."""
    # written once: both branches below, and any repeated task, must see the same partitions
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(inside) + F.col("_n0") - 1).drop("_part", "_n0")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, url, content): each non-empty line of a file or of a folder's files is a document; titles and urls
    carry its number, from 1. Lines of one file keep their order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("content"))
    # inside a split rows come in order; the counter only orders lines of one split
    raw = raw.withColumn("at", F.monotonically_increasing_id()).where("content <> ''")
    rows = dense_ids(raw, "file", "block", "at")
    return rows.select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id") + 1).alias("title"), F.concat("file", F.lit("#"), F.col("doc_id") + 1).alias("url"), "content"
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def read_stop_words(spark: SparkSession, path: str, *, fold: bool = True) -> tuple[str, ...]:
    """One word a line. A stop list is a small fixed file; it becomes part of the tokenizer's configuration."""
    word = F.trim(F.lower("value") if fold else F.col("value"))
    return tuple(r[0] for r in spark.read.text(path).select(word.alias("w")).where("w <> ''").distinct().orderBy("w").collect())


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word file, several on a line."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), "\\s+")).alias("word")).where("word <> ''")


def document_line(title: Column, content: Column) -> Column:
    """``title. content`` on one line; null where there is no content."""
    flat = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\n\r", " "))
    return F.when(F.length(F.coalesce(content, F.lit(""))) > 0, F.concat(flat(title), F.lit(". "), flat(content)))


def export_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of documents with content."""
    return docs.select("doc_id", document_line(F.col("title"), F.col("content")).alias("line")).where("line is not null")


def export_with_metadata(docs: DataFrame) -> DataFrame:
    """(line_id, doc_id, title, url, line): lines with dense ids beside their metadata."""
    lines = docs.select("doc_id", "title", "url", document_line(F.col("title"), F.col("content")).alias("line")).where("line is not null")
    return dense_ids(lines, "doc_id", name="line_id").select("line_id", "doc_id", "title", "url", "line")


def results_json(query: str, results: DataFrame, total: int) -> DataFrame:
    """(json): one object for each result inside of which query and total are repeated, so that no row holds all results."""
    return results.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(total).alias("total_results"), F.struct("*").alias("result"))).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
