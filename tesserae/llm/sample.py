"""A bounded sample of labelled pages, from which the small models (dictionaries, classifiers) are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages and the spellings of their labels (first two letters of tags, three-letter codes, names).
LANGUAGES = ("ru", "en", "uk", "de", "fr", "es")
SPELLINGS = {
    "rus": "ru", "russian": "ru",
    "eng": "en", "english": "en",
    "ukr": "uk", "ukrainian": "uk",
    "deu": "de", "ger": "de", "german": "de",
    "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "spanish": "es",
}
SAMPLE_PAGES = 3_000  # bound of the sample; what is fitted doesn't grow with the data


def label(language: Column) -> Column:
    """The two-letter code a label names, null if it names none of the languages."""
    name = F.lower(F.trim(language))
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    base = F.regexp_extract(name, "^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(base.isin(*LANGUAGES), base).otherwise(spelled[name])


def labelled_pages(pages: DataFrame, size: int = SAMPLE_PAGES) -> list[tuple[str, str, str | None, str | None]]:
    """(language, content, html_content, encoding) of about ``size`` labelled pages: those whose id's hash is below a bound that
    follows from the number of pages, so that what is sampled keeps its size when the data grow."""
    bound = int(2**31 * min(1.0, size / max(1, pages.count())))
    rows = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(2**31)) < bound)
    rows = rows.select("page_id", label(F.col("language")).alias("lang"), "content", "html_content", "encoding")
    table = rows.where("lang is not null and length(trim(content)) > 0").drop("page_id").toArrow()
    return sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: (r[0], r[1]))
