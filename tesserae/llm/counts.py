"""The most frequent of counted keys, without sending every partition's best to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize

STEPS = 16  # buckets for each doubling of a count


def most_frequent(counted: DataFrame, key: str, at_most: int) -> list[str]:
    """At most ``at_most`` keys of (key, n), sorted: all those above a count that is the lowest to leave so few.

    A histogram of the counts' logarithms (some hundred rows at any size) gives the count; only the keys above it are
    collected. Keys of equal count stay together, so the choice doesn't depend on partitions."""
    table = materialize(counted.select(key, "n", F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int").alias("b")), "counts")
    least, total = None, 0
    for bucket, n in sorted(table.groupBy("b").count().collect(), reverse=True):
        total += n
        if total > at_most:
            break
        least = bucket
    if least is None:
        return []
    return sorted(r[0] for r in table.where(F.col("b") >= least).select(key).collect())
