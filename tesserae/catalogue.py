"""The library's queries by name, and the SQL each equals where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import stem, text
from tesserae.operators import frontier, search, zipf
from tesserae.operators.index import Index, build_statistics, first_of_url, token_positions, token_rows, token_statistics
from tesserae.plans import query as ql
from tesserae.plans.shared import is_written, shared_dir, written
from tesserae.sources import lines, pages
from tesserae.streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_docs as documents."""
    return _table(spark, sf_dir, "index_docs").withColumnRenamed("id", "doc_id")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").alias("content"))


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.build(_docs(spark, sf_dir))


_SAVED: dict[tuple[str, str], str] = {}


def _search(spark: SparkSession, sf_dir: str) -> search.Search:
    """Searches read saved postings; a folder's index is written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if not is_written(spark, _SAVED.get(key, "")):
        path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        _index(spark, sf_dir).save(path)
        written(spark, path)
        _SAVED[key] = path
    return search.Search(Index.load(spark, _SAVED[key]))


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def take(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return take


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL pieces. Delimiters are spelled out: white space classes differ between engines. -----------------------------

_RUN = "[^\\x09\\x0A\\x0B\\x0C\\x0D !-/:-@\\[-`{-~]{1,51}"


def _tok(table: str, key: str, column: str, fold: str = "lower(raw)") -> str:
    """A token CTE: (doc_id, i, term), i the place of the raw run."""
    keep = "strlen(term) >= 2 AND (strlen(term) <= 50 OR length(term) = 51)"
    return (
        f"tok AS (SELECT doc_id, i, term FROM (SELECT doc_id, i, {fold} AS term FROM (SELECT {key} AS doc_id, "
        f"unnest(regexp_extract_all({column}, '{_RUN}')) AS raw, generate_subscripts(regexp_extract_all({column}, '{_RUN}'), 1) AS i FROM {table} WHERE {column} IS NOT NULL)) WHERE {keep})"
    )


_IDOCS = (
    "idocs AS (SELECT id AS doc_id, title, url, content FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM index_docs) WHERE rn = 1 OR url IS NULL)"
)
_IDX = f"WITH {_IDOCS}, {_tok('idocs', 'doc_id', 'content')}, o AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, term FROM tok)"
_POST = _IDX + ", post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, list(ord ORDER BY ord) AS positions FROM o GROUP BY term, doc_id)"
_TOKENS = f"WITH {_tok('documents', 'doc_id', 'text')}"


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM o WHERE term = '{term}')"


def _bool_sql(where: str) -> str:
    return f"{_IDX} SELECT doc_id FROM idocs WHERE {where}"


# --- text ----------------------------------------------------------------------------------------------------------


@_add("tokenize", f"{_TOKENS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, term FROM tok")
def _(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(_corpus(spark, d))


@_add("tokenize_ascii", f"WITH {_tok('documents', 'doc_id', 'text', "translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} SELECT term, count(*) AS n FROM tok GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(_corpus(spark, d), text.TokenizerConfig(fold="ascii")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "tokenize_positions",
    f"""WITH seg AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}|[\\x09\\x0A\\x0B\\x0C\\x0D !-/:-@\\[-`{{-~]+')) AS raw,
  generate_subscripts(regexp_extract_all(text, '{_RUN}|[\\x09\\x0A\\x0B\\x0C\\x0D !-/:-@\\[-`{{-~]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, raw, CAST(strlen(raw) AS INTEGER) AS byte_len, coalesce(sum(strlen(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_pos FROM seg)
SELECT doc_id, CAST(byte_pos AS BIGINT) AS byte_pos, byte_len, lower(raw) AS term FROM placed
WHERE regexp_matches(raw, '^{_RUN}$') AND strlen(lower(raw)) >= 2 AND (strlen(lower(raw)) <= 50 OR length(lower(raw)) = 51)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return token_positions(_corpus(spark, d))


@_add(
    "token_stats",
    f"""{_TOKENS} SELECT count(*) AS total_tokens, count(DISTINCT term) AS unique_tokens, round(sum(strlen(term)) / count(*), 6) AS avg_token_bytes,
  round(count(*) / (SELECT count(*) FROM documents), 6) AS tokens_per_document FROM tok""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = token_statistics(_corpus(spark, d))
    return s.withColumn("avg_token_bytes", F.round("avg_token_bytes", 6)).withColumn("tokens_per_document", F.round("tokens_per_document", 6))


@_add("stopword_filter", f"{_TOKENS} SELECT term, count(*) AS n FROM tok WHERE term NOT IN (SELECT word FROM stop_words WHERE word IS NOT NULL) GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    # a fixed list of a few dozen words becomes part of the configuration
    words = [r[0] for r in _table(spark, d, "stop_words").where("word is not null").distinct().collect()]
    return token_rows(_corpus(spark, d), text.DEFAULT.with_stop_words(*words)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "stopword_builtin",
    f"""{_TOKENS} SELECT term, count(*) AS n FROM tok WHERE term NOT IN ({', '.join(repr(w) for w in text.RUSSIAN_STOP_WORDS)}) GROUP BY term""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(_corpus(spark, d), text.DEFAULT.with_stop_words(*text.RUSSIAN_STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_add("remove_numbers", f"WITH {_tok('documents', 'doc_id', 'text', "regexp_replace(lower(raw), '[0-9]', '', 'g')")} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM tok GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(_corpus(spark, d), text.TokenizerConfig(remove_numbers=True))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"))


_ZIPF = """WITH w AS (SELECT doc_id, source, lang, unnest(regexp_split_to_array(lower(text), '[\\x09\\x0A\\x0B\\x0C\\x0D ]+')) AS t FROM documents WHERE length(text) > 0),
zt AS (SELECT doc_id, source, lang, trim(t, '.,!?;:"''()[]{}') AS term FROM w WHERE length(t) > 2),
freq AS (SELECT term, count(*) AS frequency FROM zt GROUP BY term),
ranked AS (SELECT row_number() OVER (ORDER BY frequency DESC, term) AS rank, term, frequency FROM freq)"""


@_add("zipf_tokenize", _ZIPF + " SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM zt GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = _corpus(spark, d).where("length(content) > 0").select("doc_id", F.explode(text.zipf_tokens(F.col("content"))).alias("term"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"))


@_add("word_set", "SELECT id AS doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2))) AS words FROM index_docs WHERE content IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("content is not null").select("doc_id", F.size(text.word_set(F.col("content"))).cast("bigint").alias("words"))


@_add(
    "string_functions",
    """SELECT id AS doc_id, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up,
  CASE WHEN strpos(title, ':') > 0 THEN strlen(substr(title, 1, strpos(title, ':') - 1)) ELSE -1 END AS colon, len(string_split(title, ' ')) AS parts,
  replace(title, ' ', '_') AS replaced, starts_with(title, 'Как') AS begins, suffix(title, '1') AS ends, regexp_matches(title, '^[0-9]+$') AS digits, trim(title, ' ') AS trimmed
FROM index_docs WHERE title IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return _docs(spark, d).where(t.isNotNull()).select(
        "doc_id", text.lower_ascii(t).alias("low"), text.upper_ascii(t).alias("up"), text.byte_find(t, ":").cast("bigint").alias("colon"),
        F.size(text.split_on(t, " ")).cast("bigint").alias("parts"), text.replace_all(t, " ", "_").alias("replaced"), t.startswith("Как").alias("begins"),
        t.endswith("1").alias("ends"), text.is_digit(t).alias("digits"), F.btrim(t, F.lit(" ")).alias("trimmed"),
    )


_STEM = "CASE WHEN strlen(w) < 3 THEN strlen(w) WHEN strlen(w) > 6 THEN strlen(w) - 2 WHEN strlen(w) = 6 THEN 5 ELSE strlen(w) END"


@_add("stem_code", f"WITH w AS (SELECT DISTINCT term AS w FROM postings WHERE term IS NOT NULL) SELECT w AS word, upper(substr(hex(encode(CASE WHEN strlen(w) < 3 THEN w ELSE translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END)), 1, 2 * ({_STEM}))) AS stem FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "postings").where("term is not null").select(F.col("term").alias("word")).distinct()
    return words.select("word", F.hex(stem.stem_bytes(F.col("word"))).alias("stem"))


@_add(
    "stem_stats",
    f"""WITH w AS (SELECT DISTINCT term AS w FROM postings WHERE term IS NOT NULL), s AS (SELECT w, strlen(w) AS a, {_STEM} AS b FROM w)
SELECT count(*) AS processed, count(*) FILTER (b <> a OR (a >= 3 AND w <> translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS changed,
  CAST(sum(a - b) AS BIGINT) AS bytes_removed, round(sum(b) / sum(a), 6) AS ratio FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "postings").where("term is not null").select(F.col("term").alias("word")).distinct()
    return stem.stem_statistics(words).withColumn("ratio", F.round("ratio", 6))


@_add("stem_russian")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "postings").where("term is not null").select(F.lower("term").alias("word")).distinct()
    return words.select("word", stem.stem_russian(F.col("word")).alias("stem"), stem.should_stem(F.col("word")).alias("long_enough"))


# --- index ---------------------------------------------------------------------------------------------------------


@_add("postings", _POST + " SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_join(F.col("positions").cast("array<string>"), " ")
    return _index(spark, d).postings.select("term", "doc_id", "tf", at.alias("positions"))


@_add("term_df_cf", _POST + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).term_stats


@_add("all_terms", _IDX + " SELECT DISTINCT term FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms


@_add("term_lookup", _POST + " SELECT doc_id, tf FROM post WHERE term = 'индекс'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).find_postings("индекс").select("doc_id", "tf")


@_add("term_positions", _IDX + " SELECT doc_id, ord AS position FROM o WHERE term = 'авторов'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).find_postings("авторов").select("doc_id", F.explode("positions").alias("position"))


@_add("term_frequency_of", _IDX + " SELECT count(*) AS cf FROM o WHERE term = 'сервер'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).term_frequency("сервер")


@_add(
    "index_stats",
    _POST + """, s AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS docs FROM idocs)
SELECT docs, (SELECT count(*) FROM s) AS terms, (SELECT CAST(sum(df) AS BIGINT) FROM s) AS postings, round((SELECT sum(df) FROM s) / docs, 6) AS avg_doc_length,
  round((SELECT sum(df) / count(*) FROM s), 6) AS avg_term_frequency, (SELECT term FROM s ORDER BY df DESC, term LIMIT 1) AS top_term, (SELECT max(df) FROM s) AS top_df FROM n""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _index(spark, d).statistics()
    return s.withColumn("avg_doc_length", F.round("avg_doc_length", 6)).withColumn("avg_term_frequency", F.round("avg_term_frequency", 6))


@_add(
    "index_validate",
    """SELECT * FROM (VALUES ('duplicate ids', 0::BIGINT), ('duplicate urls', 0::BIGINT), ('postings without document', 0::BIGINT), ('frequency differs from positions', 0::BIGINT)) v("check", violations)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).validate()


@_add(
    "stored_postings_validate",
    """SELECT 'postings without document' AS "check", count(*) AS violations FROM postings WHERE doc_id NOT IN (SELECT id FROM index_docs)
UNION ALL SELECT 'frequency differs from positions', count(*) FROM postings WHERE frequency IS DISTINCT FROM len(positions)
UNION ALL SELECT 'repeated postings', count(*) FROM (SELECT term, doc_id FROM postings GROUP BY term, doc_id HAVING count(*) > 1)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    post, docs = _table(spark, d, "postings"), _docs(spark, d)
    n = F.count(F.lit(1)).alias("violations")
    checks = {
        "postings without document": post.join(docs, "doc_id", "left_anti"),
        "frequency differs from positions": post.where(~F.col("frequency").eqNullSafe(F.array_size("positions"))),
        "repeated postings": post.groupBy("term", "doc_id").count().where("count > 1"),
    }
    rows = [x.agg(n).select(F.lit(name).alias("check"), "violations") for name, x in checks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@_add("doc_by_url", f"WITH {_IDOCS} SELECT doc_id, title, content FROM idocs WHERE url = 'file://lines/b0.txt#2'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).document_by_url("file://lines/b0.txt#2").select("doc_id", "title", "content")


@_add("doc_by_id", f"WITH {_IDOCS} SELECT doc_id, title, url FROM idocs WHERE doc_id = 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).document(4).select("doc_id", "title", "url")


@_add("dedup_url", f"WITH {_IDOCS} SELECT doc_id, url FROM idocs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return first_of_url(_docs(spark, d)).select("doc_id", "url")


@_add("index_export", _POST + " SELECT concat_ws(chr(9), term, CAST(post.doc_id AS VARCHAR), coalesce(title, ''), CAST(tf AS VARCHAR)) AS line FROM post JOIN idocs USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).export()


@_add("index_saved_lookup", _POST + " SELECT doc_id, tf FROM post WHERE term = 'корпус'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).saved().find_postings("корпус").select("doc_id", "tf")


@_add("build_stats", _IDX + " SELECT (SELECT count(*) FROM idocs) AS processed, (SELECT count(*) FROM index_docs) - (SELECT count(*) FROM idocs) AS skipped, count(*) AS tokens, count(DISTINCT term) AS unique_tokens FROM o")
def _(spark: SparkSession, d: str) -> DataFrame:
    return build_statistics(_docs(spark, d).select("doc_id", "title", "url", "content"))


@_add("postings_sorted", _POST + " SELECT term, doc_id, tf FROM post")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).optimized().select("term", "doc_id", "tf")


# --- queries -------------------------------------------------------------------------------------------------------

_PHRASE2 = "EXISTS (SELECT 1 FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.ord = a.ord + 1 WHERE a.doc_id = idocs.doc_id AND a.term = 'по' AND b.term = 'словам')"
_PHRASE3 = "EXISTS (SELECT 1 FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.ord = a.ord + 1 JOIN o c ON c.doc_id = a.doc_id AND c.ord = a.ord + 2 WHERE a.doc_id = idocs.doc_id AND a.term = 'по' AND b.term = 'словам' AND c.term = 'авторов')"
_NEAR = "EXISTS (SELECT 1 FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.ord BETWEEN a.ord AND a.ord + 4 WHERE a.doc_id = idocs.doc_id AND a.term = 'корпус' AND b.term = 'новый')"

#: name: (query, the same as a SQL condition on idocs)
BOOLEAN = {
    "bool_term": ("индекс", _has("индекс")),
    "bool_and": ("новый && индекс", f"{_has('новый')} AND {_has('индекс')}"),
    "bool_or": ("сервер || корпус", f"{_has('сервер')} OR {_has('корпус')}"),
    "bool_not": ("!и", f"NOT ({_has('и')})"),
    "bool_and_not": ("индекс && !новый", f"{_has('индекс')} AND NOT ({_has('новый')})"),
    "bool_nested": ("(новый || старый) && !(индекс || корпус) && !!и", f"({_has('новый')} OR {_has('старый')}) AND NOT ({_has('индекс')} OR {_has('корпус')}) AND {_has('и')}"),
    "bool_implicit_and": ("Новый индекс # comment", f"{_has('новый')} AND {_has('индекс')}"),
    "bool_hyphen": ("по-словам", _PHRASE2),
    "phrase2": ('"По словам"', _PHRASE2),
    "phrase3": ('"по словам авторов"', _PHRASE3),
    "proximity": ('"корпус новый" / 4', _NEAR),
    "bool_phrase_not": ('"по словам" && !индекс', f"{_PHRASE2} AND NOT ({_has('индекс')})"),
    "bool_missing": ("несуществующее || индекс", _has("индекс")),
}


def _boolean(q: str) -> Query:
    return lambda spark, d: _search(spark, d).matching(q)


for _name, (_q, _where) in BOOLEAN.items():
    _add(_name, _bool_sql(_where))(_boolean(_q))


@_add("bool_keywords", _bool_sql(f"{_has('новый')} AND NOT ({_has('индекс')})"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).matching("новый AND NOT индекс", keywords=True)


@_add("count_results", f"{_IDX} SELECT count(*) AS n FROM idocs WHERE {BOOLEAN['bool_nested'][1]}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).matching(BOOLEAN["bool_nested"][0]).agg(F.count(F.lit(1)).alias("n"))


@_add("exists", f"{_IDX} SELECT count(*) > 0 AS found FROM idocs WHERE {_PHRASE3}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).matching('"по словам авторов"').agg((F.count(F.lit(1)) > 0).alias("found"))


@_add("document_matches", f"{_IDX} SELECT count(*) > 0 AS matches FROM idocs WHERE doc_id = 2 AND {_has('корпус')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).document_matches("корпус", 2)


@_add("topn", f"{_IDX} SELECT doc_id, 1.0::DOUBLE AS score, 1 AS matches FROM idocs WHERE {_has('индекс')} ORDER BY doc_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).top("индекс", 10)


_BATCH = ["индекс", "новый && !старый", "broken &&", '"по словам"', "!и"]


@_add(
    "batch_search",
    _IDX + f""" SELECT 0 AS query_id, doc_id FROM idocs WHERE {_has('индекс')} UNION ALL SELECT 1, doc_id FROM idocs WHERE {_has('новый')} AND NOT ({_has('старый')})
UNION ALL SELECT 3, doc_id FROM idocs WHERE {_PHRASE2} UNION ALL SELECT 4, doc_id FROM idocs WHERE NOT ({_has('и')})""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).batch(_BATCH)


@_add("analyze_query", """SELECT 'красный && !!(синий || "очень красный")' AS original_query, 'красный синий очень' AS terms, 5 AS complexity, true AS is_valid, '(красный && (синий || "очень красный"))' AS parse_tree, '' AS error_message""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = ql.analyze('красный && !!(синий || "очень красный")')
    row = (a["original_query"], " ".join(a["terms"]), a["complexity"], a["is_valid"], a["parse_tree"], a["error_message"])
    return spark.createDataFrame([row], "original_query string, terms string, complexity int, is_valid boolean, parse_tree string, error_message string")


@_add("search_detailed", f"{_IDX} SELECT doc_id, 1.0::DOUBLE AS score, 1 AS matches FROM idocs WHERE {_has('сервер')} OR {_has('корпус')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).detailed("сервер || корпус")


@_add("result_bitmap", f"{_IDX} SELECT CAST(CASE WHEN doc_id > 0 THEN (doc_id - 1) // 32768 + 1 ELSE doc_id // 32768 END AS BIGINT) AS bucket, count(*) AS n FROM idocs WHERE {_has('индекс')} GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.result_bitmaps(_search(spark, d).matching("индекс")).select("bucket", "n")


@_add("bool_xor", _bool_sql(f"({_has('новый')}) <> ({_has('индекс')})"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    return search.symmetric_difference(s.matching("новый"), s.matching("индекс"))


# --- services ------------------------------------------------------------------------------------------------------


@_add("suggest_prefix", _POST + " SELECT term, count(*) AS df FROM post WHERE starts_with(term, 'ин') GROUP BY term ORDER BY df DESC, term LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).suggest("ИН", 10, by="df")


@_add("similar_docs", _POST + " SELECT doc_id, count(*) AS shared FROM post WHERE doc_id <> 0 AND term IN (SELECT term FROM post WHERE doc_id = 0) GROUP BY doc_id ORDER BY shared DESC, doc_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).similar(0, 10)


@_add(
    "snippet",
    _IDX + """, d AS (SELECT doc_id, content, coalesce((SELECT list(term ORDER BY ord) FROM o WHERE o.doc_id = idocs.doc_id), []) AS ts FROM idocs),
m AS (SELECT *, coalesce((SELECT min(ord) + 1 FROM o WHERE o.doc_id = d.doc_id AND term IN ('авторов', 'корпус')), 0) AS m, len(ts) AS n FROM d)
SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN m > 0 THEN (CASE WHEN greatest(1, m - 2) > 1 THEN '...' ELSE '' END) ||
  array_to_string(list_transform(list_slice(ts, greatest(1, m - 2), least(n, m + 2)), lambda t: CASE WHEN t IN ('авторов', 'корпус') THEN '[' || t || ']' ELSE t END), ' ') ||
  (CASE WHEN least(n, m + 2) < n THEN '...' ELSE '' END)
  ELSE substr(content, 1, 200) || (CASE WHEN length(content) > 200 THEN '...' ELSE '' END) END AS snippet FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).snippets("авторов || корпус", 2)


@_add("metadata_join", f"{_IDX} SELECT doc_id, title, url FROM idocs WHERE {_has('индекс')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    return s.with_metadata(s.matching("индекс"), s.index.docs).select("doc_id", "title", "url")


_REGEX = {
    "regex_term": ("индекс[а-я]*", "hit('индекс[а-я]*')"),
    "regex_and": ("нов[ыо] && словар", "hit('нов[ыо]') AND hit('словар')"),
    "regex_or": ("сервер || museum", "hit('сервер') OR hit('museum')"),
    "regex_not": ("!индекс", "NOT hit('индекс')"),
}


def _pattern_query(q: str) -> Query:
    return lambda spark, d: search.pattern_search(_table(spark, d, "pages"), q).select("page_id")


for _name, (_q, _where) in _REGEX.items():
    _cond = _where.replace("hit('", "(coalesce(regexp_matches(title, '(?i)").replace("')", "'), false) OR coalesce(regexp_matches(content, '(?i)§'), false))")
    # the pattern stands twice: in the title's and in the content's test
    import re as _re

    _cond = _re.sub(r"regexp_matches\(title, '\(\?i\)(.*?)'\), false\) OR coalesce\(regexp_matches\(content, '\(\?i\)§'", r"regexp_matches(title, '(?i)\1'), false) OR coalesce(regexp_matches(content, '(?i)\1'", _cond)
    _add(_name, f"SELECT page_id FROM pages WHERE {_cond}")(_pattern_query(_q))


@_add(
    "string_snippet",
    """WITH p AS (SELECT page_id, content, length(content) AS n, strpos(lower(content), 'корпус') AS hit FROM pages WHERE content IS NOT NULL)
SELECT page_id, CASE WHEN hit > 0 THEN (CASE WHEN greatest(1, hit - 50) > 1 THEN '...' ELSE '' END) || substr(content, greatest(1, hit - 50), least(n, hit + 55) - greatest(1, hit - 50) + 1) ||
  (CASE WHEN least(n, hit + 55) < n THEN '...' ELSE '' END) ELSE substr(content, 1, 100) END AS snippet FROM p""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").where("content is not null").select("page_id", search.string_snippet(F.col("content"), "Корпус").alias("snippet"))


@_add("preview", "SELECT page_id, CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS preview FROM pages WHERE content IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").where("content is not null").select("page_id", search.preview(F.col("content")).alias("preview"))


# --- statistics ----------------------------------------------------------------------------------------------------


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return zipf.term_frequencies(_corpus(spark, d))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@_add("term_frequency", _ZIPF + " SELECT term, frequency FROM freq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d)


@_add("rank_frequency", _ZIPF + " SELECT rank, term, frequency FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return zipf.rank_frequency(_freq(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


_FIT = "round(-regr_slope(ln(frequency), ln(rank)), 6) AS s, round(exp(regr_intercept(ln(frequency), ln(rank))), 4) AS c, round(regr_r2(ln(frequency), ln(rank)), 6) AS r2"


@_add("zipf_fit", f"{_ZIPF} SELECT {_FIT} FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return zipf.zipf_fit(zipf.rank_frequency(_freq(spark, d))).select(F.round("s", 6).alias("s"), F.round("c", 4).alias("c"), F.round("r2", 6).alias("r2"))


@_add(
    "zipf_fit_by_source",
    f"{_ZIPF}, f AS (SELECT coalesce(source, '-') AS source, term, count(*) AS frequency FROM zt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY frequency DESC, term) AS rank FROM f) SELECT source, {_FIT} FROM r GROUP BY source",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = _corpus(spark, d).withColumn("source", F.coalesce("source", F.lit("-")))
    return zipf.zipf_fit_by(docs, "source").select("source", F.round("s", 6).alias("s"), F.round("c", 4).alias("c"), F.round("r2", 6).alias("r2"))


@_add(
    "freq_stats",
    _ZIPF + """ SELECT CAST(sum(frequency) AS BIGINT) AS total, count(*) AS "unique", max(frequency) AS "max", min(frequency) AS "min", round(avg(frequency), 6) AS mean,
  CAST(median(frequency) AS DOUBLE) AS median, round(stddev_pop(frequency), 6) AS std FROM freq""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.frequency_statistics(_freq(spark, d)), "mean", "std")


@_add("top_share", _ZIPF + " SELECT round(sum(frequency) FILTER (rank <= 10) / sum(frequency), 6) AS top10, round(sum(frequency) FILTER (rank <= 100) / sum(frequency), 6) AS top100 FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.concentration(zipf.rank_frequency(_freq(spark, d))), "top10", "top100")


_GROWTH = ", g AS (SELECT rank AS size, CAST(sum(frequency) OVER (ORDER BY rank) AS BIGINT) AS tokens FROM ranked)"


@_add("vocab_growth", _ZIPF + _GROWTH + " SELECT CAST(size AS BIGINT) AS size, tokens, round(size / tokens, 6) AS ratio FROM g WHERE size <= 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.vocabulary_growth(_freq(spark, d)).withColumn("size", F.col("size").cast("bigint")), "ratio")


@_add("heaps_fit", _ZIPF + _GROWTH + " SELECT round(regr_slope(log10(size), log10(tokens)), 6) AS beta, round(pow(10, regr_intercept(log10(size), log10(tokens))), 6) AS k FROM g WHERE size <= 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.heaps_fit(zipf.vocabulary_growth(_freq(spark, d))), "beta", "k")


@_add("heaps_expected", _ZIPF + " SELECT round(10 * sqrt(sum(frequency)), 6) AS expected FROM freq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d).agg(F.round(zipf.heaps(F.sum("frequency")), 6).alias("expected"))


@_add("entropy", _ZIPF + ", t AS (SELECT sum(frequency) AS n FROM freq) SELECT round(-sum(frequency / n * log2(frequency / n)), 6) AS entropy FROM freq, t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.entropy(_freq(spark, d)), "entropy")


@_add("gini", _ZIPF + ", a AS (SELECT frequency, row_number() OVER (ORDER BY frequency, term) AS i, count(*) OVER () AS n FROM freq) SELECT round(sum((2 * i - n - 1) * frequency) / (any_value(n) * sum(frequency)), 6) AS gini FROM a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.gini(_freq(spark, d)), "gini")


@_add("mandelbrot", _ZIPF + " SELECT rank, frequency, round((SELECT sum(frequency) FROM freq) / (rank + 2.7), 4) AS expected FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = zipf.mandelbrot(zipf.rank_frequency(_freq(spark, d)))
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "frequency", F.round("expected", 4).alias("expected"))


@_add("type_token_ratio", _ZIPF + " SELECT round(count(*) / sum(frequency), 6) AS ratio FROM freq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.type_token_ratio(_freq(spark, d)), "ratio")


@_add(
    "freq_buckets",
    _ZIPF + """ SELECT CASE WHEN frequency = 1 THEN '1' WHEN frequency = 2 THEN '2' WHEN frequency <= 10 THEN '3-10' WHEN frequency <= 100 THEN '11-100' WHEN frequency <= 1000 THEN '101-1000' ELSE '1001+' END AS bucket,
  count(*) AS terms, CAST(sum(frequency) AS BIGINT) AS tokens FROM freq GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return zipf.frequency_buckets(_freq(spark, d))


@_add(
    "page_stats",
    """SELECT count(*) AS total, count(*) FILTER (processed) AS processed, count(*) FILTER (NOT coalesce(processed, false)) AS unprocessed, count(DISTINCT domain) AS domains,
  CAST(sum(content_length) AS BIGINT) AS total_bytes, round(avg(content_length), 6) AS mean_bytes, round(sum(content_length) / 1048576, 6) AS megabytes FROM pages""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pages.statistics(_table(spark, d, "pages")), "mean_bytes", "megabytes")


@_add("pages_by_domain", "SELECT domain, count(*) AS pages FROM pages WHERE domain IS NOT NULL GROUP BY domain")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.domains(_table(spark, d, "pages"))


@_add("latency_stats", 'SELECT count(*) AS n, min(value) AS "min", max(value) AS "max", (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS c FROM events WHERE value IS NOT NULL) WHERE r = c // 2 + 1) AS median FROM events WHERE value IS NOT NULL')
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.latency_summary(_table(spark, d, "events"), "value")


@_add(
    "latency_hist",
    """WITH e AS (SELECT CAST(floor(value) AS BIGINT) AS t FROM events WHERE value IS NOT NULL), x AS (SELECT min(t) AS lo, (max(t) - min(t) + 1) // 10 + 1 AS width FROM e)
SELECT CAST((t - lo) // width AS BIGINT) AS bin, CAST(any_value(lo) + CAST((t - lo) // width AS BIGINT) * any_value(width) AS BIGINT) AS start, count(*) AS "count" FROM e, x GROUP BY (t - lo) // width""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.latency_histogram(_table(spark, d, "events"), "value")


@_add("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(_table(spark, d, "events")).withColumn("total", F.round("total", 4))


@_add(
    "zipf_report",
    _ZIPF + """ SELECT (SELECT CAST(sum(frequency) AS BIGINT) FROM freq) AS total, (SELECT count(*) FROM freq) AS "unique", round(-regr_slope(ln(frequency), ln(rank)), 6) AS s,
  round((SELECT count(*) / sum(frequency) FROM freq), 6) AS ratio, round(sum(frequency) FILTER (rank <= 10) / sum(frequency), 6) AS top10 FROM ranked""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zipf.report(_freq(spark, d)).select("total", "unique", "s", "ratio", "top10"), "s", "ratio", "top10")


# --- pages ---------------------------------------------------------------------------------------------------------

_NORM = "lower(CASE WHEN regexp_matches(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(url, '#.*$', '') ELSE 'http://' || regexp_replace(url, '#.*$', '') END)"


@_add("url_normalize", f"SELECT page_id, {_NORM} AS normal FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", frontier.normalize_url(F.col("url")).alias("normal"))


@_add(
    "page_upsert",
    """SELECT page_id, url, f AS created_at FROM (SELECT page_id, url, min(crawled_at) OVER (PARTITION BY url) AS f, row_number() OVER (PARTITION BY url ORDER BY coalesce(crawled_at, TIMESTAMP '0001-01-01') DESC, page_id DESC) AS r FROM pages WHERE url IS NOT NULL) WHERE r = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.upsert(_table(spark, d, "pages")).where("url is not null").select("page_id", "url", "created_at")


@_add("page_find", "SELECT page_id, url FROM pages WHERE status = 'failed' ORDER BY page_id LIMIT 5 OFFSET 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.find(_table(spark, d, "pages"), where=F.col("status") == "failed", skip=2, limit=5).select("page_id", "url")


@_add("page_delete", "SELECT count(*) AS n FROM pages WHERE NOT coalesce(status = 'failed', false)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.deleted(_table(spark, d, "pages"), F.col("status") == "failed").agg(F.count(F.lit(1)).alias("n"))


@_add("mark_processed", "SELECT count(*) FILTER (coalesce(processed, false) OR status = 'failed') AS n FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages")
    return pages.mark_processed(p, p.where("status = 'failed'")).agg(F.count_if(F.coalesce("processed", F.lit(False))).alias("n"))


@_add("unprocessed_pages", "SELECT page_id FROM pages WHERE NOT coalesce(processed, false)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.unprocessed(_table(spark, d, "pages")).select("page_id")


@_add("min_length_filter", "SELECT page_id FROM pages WHERE length(content) >= 1000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.long_enough(_table(spark, d, "pages")).select("page_id")


@_add(
    "page_document",
    """SELECT page_id, coalesce(domain, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS domain, coalesce(title, '') AS title, length(coalesce(content, '')) AS content_length,
  coalesce(encoding, 'utf-8') AS encoding, coalesce(status, 'downloaded') AS status, coalesce(processed, false) AS processed FROM pages""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = pages.page_document(_table(spark, d, "pages"))
    return p.select("page_id", "domain", "title", F.col("content_length").cast("bigint").alias("content_length"), "encoding", "status", "processed")


@_add(
    "html_title",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html_content, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\x09\\x0A\\x0D ]+', ' ', 'g')) AS title
FROM pages WHERE html_content IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").where("html_content is not null").select("page_id", pages.html_title(F.col("html_content")).alias("title"))


@_add(
    "html_links",
    """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html_content, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages WHERE html_content IS NOT NULL)
WHERE length(trim(link)) > 0 AND NOT regexp_matches(lower(link), '^(?:#|javascript:|mailto:|tel:)') AND NOT regexp_matches(lower(link), '\\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|tar|gz|jpg|jpeg|png|gif)$') GROUP BY page_id, link""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _table(spark, d, "pages").where("html_content is not null").select("page_id", F.explode(pages.html_links(F.col("html_content"))).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@_add("encoding_detect", """SELECT page_id, lower(coalesce(nullif(regexp_extract(content_type, '(?i)charset=["'']?([\\w-]+)', 1), ''), nullif(regexp_extract(html_content, '(?i)<meta[^>]+charset=["'']?([\\w-]+)', 1), ''), 'utf-8')) AS charset FROM pages""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", pages.detect_encoding(F.col("content_type"), F.col("html_content")).alias("charset"))


@_add("pages_of_domain", "SELECT page_id, url FROM pages WHERE domain = 'erforin-19.test'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.by_domain(_table(spark, d, "pages"), "erforin-19.test").select("page_id", "url")


@_add(
    "parser_dispatch",
    """SELECT page_id, CASE WHEN regexp_matches(h, '(^|[.])wikipedia[.]org$') THEN 'wiki' WHEN regexp_matches(h, '(^|[.])habr[.]com$') THEN 'blog' WHEN regexp_matches(h, '(^|[.])stackoverflow[.]com$') THEN 'qa' ELSE 'generic' END AS parser
FROM (SELECT page_id, lower(split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':', 1)) AS h FROM pages WHERE html_content IS NOT NULL)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(_table(spark, d, "pages")).select("page_id", "parser")


@_add("page_extract")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(_table(spark, d, "pages"))


# --- frontier ------------------------------------------------------------------------------------------------------


@_add(
    "frontier_queue",
    f"""SELECT url, depth, seq FROM (SELECT {_NORM} AS url, depth, seq, row_number() OVER (PARTITION BY {_NORM} ORDER BY depth, seq) AS r FROM frontier WHERE state IN ('pending', 'queued')) WHERE r = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return frontier.queue(_table(spark, d, "frontier"))


@_add("frontier_stats", f"SELECT coalesce(state, 'unknown') AS state, count(DISTINCT {_NORM}) AS urls, min(depth) AS min_depth, max(depth) AS max_depth FROM frontier GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return frontier.frontier_statistics(_table(spark, d, "frontier"))


@_add(
    "frontier_level",
    f"""WITH p AS (SELECT {_NORM} AS url, links FROM pages WHERE url IS NOT NULL), s AS (SELECT DISTINCT {_NORM} AS url FROM frontier WHERE depth = 0 AND url IS NOT NULL),
x AS (SELECT unnest(links) AS url FROM s JOIN p USING (url)), n AS (SELECT DISTINCT {_NORM} AS url FROM x WHERE length(url) > 0)
SELECT url, 1 AS depth FROM n WHERE url NOT IN (SELECT url FROM s)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages")
    start = frontier.seeds(_table(spark, d, "frontier").where("depth = 0").select("url"))
    return frontier.expand(start, p, start, 3).select("url", "depth")


@_add(
    "frontier_crawl",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT u AS url, {_NORM.replace('url', 'l')} AS link FROM (SELECT {_NORM} AS u, unnest(links) AS l FROM pages WHERE url IS NOT NULL) WHERE length(l) > 0),
c(url, depth) AS (SELECT DISTINCT {_NORM}, 0 FROM frontier WHERE depth = 0 AND url IS NOT NULL UNION SELECT p.link, depth + 1 FROM c JOIN p ON p.url = c.url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM c GROUP BY url""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages")
    return frontier.crawl(p, _table(spark, d, "frontier").where("depth = 0").select("url"), 3)


_PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"


@_add(
    "robots_allowed",
    f"""WITH r AS (SELECT DISTINCT lower(domain) AS host, prefix FROM robots_rules WHERE agent IN ('*', 'SearchEngineBot/1.0') AND length(prefix) > 0 AND prefix <> '/')
SELECT seq, url FROM frontier WHERE NOT EXISTS (SELECT 1 FROM r WHERE host = lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AND starts_with({_PATH}, prefix))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return frontier.allowed(_table(spark, d, "frontier"), _table(spark, d, "robots_rules"), "SearchEngineBot/1.0").select("seq", "url")


# --- sinks ---------------------------------------------------------------------------------------------------------


@_add(
    "export_lines",
    """SELECT id AS doc_id, trim(replace(replace(coalesce(title, ''), chr(10), ' '), chr(13), '')) || '. ' || trim(replace(replace(content, chr(10), ' '), chr(13), '')) AS line
FROM index_docs WHERE length(content) > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return lines.export_lines(_docs(spark, d))


@_add("export_metadata", "SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS line_id, id AS doc_id, title, url FROM index_docs WHERE length(content) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.export_with_metadata(_docs(spark, d))
    return rows.select(F.col("line_id").cast("bigint").alias("line_id"), "doc_id", "title", "url")


@_add(
    "results_json",
    f"""{_IDX}, hits AS (SELECT doc_id, title FROM idocs WHERE {_has('индекс')}) SELECT json_object('query', 'индекс', 'total_results', (SELECT count(*) FROM hits), 'result', CASE WHEN title IS NULL THEN json_object('doc_id', doc_id) ELSE json_object('doc_id', doc_id, 'title', title) END)::VARCHAR AS json FROM hits""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    hits = s.with_metadata(s.matching("индекс"), s.index.docs).select("doc_id", "title")
    return lines.results_json("индекс", hits, hits.count())


@_add("store_fields", "SELECT column_name AS field FROM (DESCRIBE SELECT * FROM pages)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pages.fields(_table(spark, d, "pages")).select("field")


@cache
def flagship_query() -> str:
    return "(новый || старый) && !музей"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search.Search(Index.build(_docs(spark, d))).top(flagship_query(), 10)
