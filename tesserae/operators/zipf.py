"""Rank-frequency statistics of a collection: counts, ranks, fits, concentration, entropy, growth.

Frequencies are one row for each term. Ranks of a large vocabulary come from a range-partitioned sort whose partitions are
numbered by their sizes, so no window holds all terms in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import zipf_tokens
from tesserae.plans.shared import materialize

GROWTH_POINTS = 100


def term_frequencies(docs: DataFrame, text: str = "content") -> DataFrame:
    """(term, frequency) by the word splitter of the statistics; null or empty documents have none."""
    return docs.where(F.length(text) > 0).select(F.explode(zipf_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def _numbered(rows: DataFrame, *order: Column, running: str | None = None) -> DataFrame:
    """rows with ``rank`` (1, 2, ...) and, if asked, the running sum of a column, over the whole order."""
    # written once: both branches below, and any repeated task, must see the same partitions
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranks")
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(running).alias("s")] if running else [])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = parts.groupBy("part").agg(*sums)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), *([F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0")] if running else []))
    inside = Window.partitionBy("part").orderBy(*order)
    out = parts.join(F.broadcast(offsets), "part").withColumn("rank", F.row_number().over(inside) + F.col("n0"))
    if running:
        out = out.withColumn("running", F.sum(running).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("s0"))
    return out.drop("part", "n0", "s0")


def rank_frequency(freq: DataFrame) -> DataFrame:
    """(rank, term, frequency) by falling frequency, ties by term."""
    return _numbered(freq, F.desc("frequency"), F.asc("term")).select("rank", "term", "frequency")


def _line(x: Column, y: Column, *names: str) -> list[Column]:
    slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
    r2 = F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(y, x))
    return [slope.alias(names[0]), intercept.alias(names[1]), r2.alias(names[2])]


def zipf_fit(ranked: DataFrame, *by: str) -> DataFrame:
    """(s, c, slope, intercept, r2): the line of ln frequency on ln rank."""
    fit = ranked.groupBy(*by).agg(*_line(F.log(F.col("rank").cast("double")), F.log(F.col("frequency").cast("double")), "slope", "intercept", "r2"))
    return fit.select(*by, (-F.col("slope")).alias("s"), F.exp("intercept").alias("c"), "slope", "intercept", "r2")


def zipf_fit_by(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """A fit for each value of the key; ranks inside a key are a window over that key's vocabulary."""
    words = docs.where(F.length(text) > 0).select(key, F.explode(zipf_tokens(F.col(text))).alias("term"))
    freq = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("frequency"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("frequency"), "term"))
    return zipf_fit(freq.withColumn("rank", rank), key)


def frequency_statistics(freq: DataFrame) -> DataFrame:
    f = F.col("frequency")
    return freq.agg(
        F.coalesce(F.sum(f), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"), F.max(f).alias("max"), F.min(f).alias("min"),
        F.avg(f).alias("mean"), F.expr("percentile(frequency, 0.5)").alias("median"), F.stddev_pop(f).alias("std"),
    )


def concentration(ranked: DataFrame) -> DataFrame:
    """(top10, top100): shares of the most frequent terms; null below ten terms."""
    total = F.sum("frequency")
    share = lambda n: F.when(F.count(F.lit(1)) >= 10, F.try_divide(F.sum(F.when(F.col("rank") <= n, F.col("frequency")).otherwise(0)), total))
    return ranked.agg(share(10).alias("top10"), share(100).alias("top100"))


def vocabulary_growth(freq: DataFrame, points: int | None = GROWTH_POINTS) -> DataFrame:
    """(size, tokens, ratio) after each rank, the first points (all if None)."""
    rows = _numbered(freq, F.desc("frequency"), F.asc("term"), running="frequency")
    rows = rows if points is None else rows.where(F.col("rank") <= points)
    return rows.select(F.col("rank").alias("size"), F.col("running").alias("tokens"), (F.col("rank") / F.col("running")).alias("ratio"))


def entropy(freq: DataFrame) -> DataFrame:
    """(entropy) in bits, 0 without terms: log2 N less the mean of log2 f weighted by f."""
    f = F.col("frequency")
    return freq.agg(F.coalesce(F.log2(F.sum(f).cast("double")) - F.sum(f * F.log2(f.cast("double"))) / F.sum(f), F.lit(0.0)).alias("entropy"))


def gini(freq: DataFrame) -> DataFrame:
    """(gini) of the frequencies, 0 for fewer than two terms."""
    up = _numbered(freq, F.asc("frequency"), F.asc("term"))
    n, total = F.count(F.lit(1)), F.sum("frequency")
    weighted = 2 * F.sum(F.col("rank") * F.col("frequency")) - (n + 1) * total
    return up.agg(F.when(n > 1, F.try_divide(weighted.cast("double"), (n * total).cast("double"))).otherwise(0.0).alias("gini"))


def mandelbrot(ranked: DataFrame, a: float = 1.0, b: float = 2.7) -> DataFrame:
    """(rank, frequency, expected): total / (rank + b)^a."""
    total = ranked.agg(F.sum("frequency").alias("total"))
    return ranked.join(F.broadcast(total)).select("rank", "frequency", (F.col("total") / F.pow(F.col("rank") + b, F.lit(a))).alias("expected"))


def heaps(n: Column, k: float = 10.0, beta: float = 0.5) -> Column:
    return F.lit(k) * F.pow(n, F.lit(beta))


def heaps_fit(growth: DataFrame) -> DataFrame:
    """(beta, k): the line of log10 size on log10 tokens."""
    fit = growth.agg(*_line(F.log10(F.col("tokens").cast("double")), F.log10(F.col("size").cast("double")), "beta", "log_k", "r2"))
    return fit.select("beta", F.pow(F.lit(10.0), "log_k").alias("k"))


def type_token_ratio(freq: DataFrame) -> DataFrame:
    return freq.agg(F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum("frequency")), F.lit(0.0)).alias("ratio"))


def frequency_buckets(freq: DataFrame) -> DataFrame:
    """(bucket, terms, tokens): terms that occur once, twice, 3-10, 11-100, 101-1000 times and more."""
    f = F.col("frequency")
    bucket = F.when(f == 1, "1").when(f == 2, "2").when(f <= 10, "3-10").when(f <= 100, "11-100").when(f <= 1000, "101-1000").otherwise("1001+")
    return freq.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("terms"), F.sum(f).alias("tokens"))


def report(freq: DataFrame) -> DataFrame:
    """One row: the statistics of the text report."""
    ranked = rank_frequency(freq)
    out = frequency_statistics(freq)
    for other in (zipf_fit(ranked), concentration(ranked), entropy(freq), gini(freq), type_token_ratio(freq)):
        out = out.join(F.broadcast(other))  # one row each
    return out
