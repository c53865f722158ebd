"""Queries of the training-data operators, by problem, and the SQL that some of them equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class _Lazy:
    """A module of this package, imported when it is first used, so that a library that lacks takes only its own queries."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __getattr__(self, key: str):  # noqa: ANN204
        return getattr(importlib.import_module("tesserae.llm." + self.name), key)

    def there(self) -> bool:
        try:
            importlib.import_module("tesserae.llm." + self.name)
        except ImportError:
            return False
        return True


encoding, frequency, leaks, lines = _Lazy("encoding"), _Lazy("frequency"), _Lazy("leaks"), _Lazy("lines")
lookalike, markup, page_pass, tokens = _Lazy("lookalike"), _Lazy("markup"), _Lazy("page_pass"), _Lazy("tokens")
#: The module of each problem.
MODULES = {1: page_pass, 2: encoding, 3: page_pass, 4: frequency, 5: page_pass, 6: markup, 7: lines, 8: tokens, 9: leaks, 10: lookalike}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.spam_pages(_pages(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.spam_shares(_pages(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_fields(_pages(spark, sf_dir)).select("page_id", "field")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_fields(_pages(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.relabelled_pages(_pages(spark, sf_dir))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.page_languages(_pages(spark, sf_dir))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.page_segments(_pages(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.page_lines(_pages(spark, sf_dir)).where("not body").select("page_id", "line_no")


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pass.page_bodies(_pages(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_kinds(_pages(spark, sf_dir))


def p6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.host_wrappers(_pages(spark, sf_dir))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_pages(_pages(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = frequency.marked_terms(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "postings"))
    return terms.where("mark is not null").select("origin", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = frequency.marked_terms(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "postings"))
    return terms.select("origin", "term", "cf", "df")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, sf_dir, "pages")).select("page_id", "line_no")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(_table(spark, sf_dir, "pages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_classes(_table(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.one_form(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """The queries of all problems whose modules can be imported."""
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
    return {name: f for name, f in found.items() if MODULES[int(name[1 : name.index("_")])].there()}


# Fixed values of the problems, as in the operators.
_TERM = "[0-9a-z\\x{00DF}-\\x{00F6}\\x{00F8}-\\x{024F}\\x{0400}-\\x{04FF}]+"
_COUNTS = f"""
WITH page_terms AS (
  SELECT page_id, unnest(regexp_extract_all(lower(content), '{_TERM}')) AS term FROM pages WHERE content IS NOT NULL
), once AS (
  SELECT lower(term) AS term, doc_id, positions,
         max(CASE WHEN frequency >= 1 THEN frequency ELSE coalesce(len(positions), 0) END) AS f
  FROM postings WHERE term IS NOT NULL GROUP BY term, doc_id, positions
), counts AS (
  SELECT 'pages' AS origin, term, count(*) AS cf, count(DISTINCT page_id) AS df FROM page_terms GROUP BY term
  UNION ALL
  SELECT 'postings', term, CAST(sum(f) AS BIGINT), count(DISTINCT doc_id) FROM once GROUP BY term
), totals AS (
  SELECT 'pages' AS origin, count(*) AS n FROM pages WHERE content IS NOT NULL
  UNION ALL
  SELECT 'postings', count(DISTINCT doc_id) FROM postings WHERE term IS NOT NULL
)"""


def _look_sql() -> str:
    """The look-alike form of documents.text in SQL; composition stands for the collation's equality."""
    single = {k: v for k, v in lookalike.look_map().items() if v}
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    form = f"translate(text, {quote(''.join(single) + lookalike.INVISIBLE)}, {quote(''.join(single.values()))})"
    for joined, parts in (lookalike.JOINED | {"ў": "y\u0306", "Ў": "Y\u0306"}).items():
        form = f"replace({form}, {quote(joined)}, {quote(parts)})"
    return f"trim(nfc_normalize({form}), ' ')"


_LINES = """
WITH lines AS (
  SELECT page_id, domain, url, unnest(string_split(content, chr(10))) AS line,
         CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no
  FROM pages WHERE content IS NOT NULL
), normal AS (
  SELECT page_id, domain, url, line_no, line,
         lower(trim(regexp_replace(line, '[ ' || chr(9) || chr(13) || chr(160) || ']+', ' ', 'g'), ' ')) AS form FROM lines
), repeated AS (
  SELECT domain, form FROM normal WHERE domain IS NOT NULL AND length(form) >= 20 GROUP BY domain, form HAVING count(DISTINCT url) >= 6
)"""


def oracle_sql() -> dict[str, str]:
    looks = f"WITH looks AS (SELECT doc_id, text, {_look_sql()} AS look FROM documents WHERE text IS NOT NULL)"
    found = {
        "p10_found": looks
        + """ SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM looks a JOIN looks b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id WHERE a.look <> ''""",
        "p10_classes": looks
        + """ SELECT doc_id, min(doc_id) OVER w AS class_doc, texts, count(*) OVER w AS documents
FROM looks JOIN (SELECT look, count(DISTINCT text) AS texts FROM looks WHERE look <> '' GROUP BY look HAVING count(DISTINCT text) > 1) USING (look) WINDOW w AS (PARTITION BY look)""",
        "p10_forms": looks
        + """, texts AS (SELECT look, text, count(*) AS n FROM looks WHERE look <> '' GROUP BY look, text),
best AS (SELECT look, first(text ORDER BY n DESC, md5(text)) AS form FROM texts GROUP BY look)
SELECT doc_id, coalesce(form, text) AS form, coalesce(form, text) IS DISTINCT FROM text AS changed
FROM documents LEFT JOIN looks USING (doc_id, text) LEFT JOIN best USING (look)""",
        "p7_clean": _LINES
        + """, cut AS (SELECT n.page_id, n.line_no, n.line, r.form IS NOT NULL AS gone FROM normal n LEFT JOIN repeated r ON r.domain = n.domain AND r.form = n.form),
kept AS (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS content, CAST(count(*) FILTER (gone) AS INTEGER) AS lines_cut FROM cut GROUP BY page_id)
SELECT page_id, kept.content, coalesce(lines_cut, 0) AS lines_cut FROM pages LEFT JOIN kept USING (page_id)""",
        "p4_counts": _COUNTS + " SELECT origin, term, cf, df FROM counts",
        "p4_found": _COUNTS
        + """, marked AS (
  SELECT origin, term, CASE WHEN 4 * df > n THEN 'common' WHEN df <= 2 AND cf <= 4 THEN 'rare' END AS mark
  FROM counts JOIN totals USING (origin))
SELECT origin, term, mark FROM marked WHERE mark IS NOT NULL""",
        "p7_found": _LINES + """
SELECT page_id, line_no FROM normal JOIN repeated USING (domain, form)""",
    }
    return {name: sql for name, sql in found.items() if name in queries()}
