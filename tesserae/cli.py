"""Command line: index, search, stem, zipf, export."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.functions.stem import stem_russian, stem_statistics
from tesserae.operators import zipf
from tesserae.operators.index import Index
from tesserae.operators.search import Search
from tesserae.plans.query import analyze
from tesserae.sources import lines


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="build an index from a file of lines")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--export")
    p.add_argument("--stats", action="store_true")
    p = sub.add_parser("search", help="answer a query from an index")
    p.add_argument("--index", required=True)
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--analyze", action="store_true")
    p = sub.add_parser("stem", help="stem words of a file or of the command line")
    p.add_argument("--word", nargs="*", default=[])
    p.add_argument("--file")
    p.add_argument("--stats", action="store_true")
    p = sub.add_parser("zipf", help="rank statistics of a file of lines")
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--top-terms", type=int, default=50)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    if a.command == "index":
        index = Index.build(lines.read_lines(spark, a.input))
        index.save(a.output)
        index = Index.load(spark, a.output)
        if a.stats:
            index.statistics().show(truncate=False)
        if a.export:
            index.export().write.mode("overwrite").text(a.export)
    elif a.command == "search":
        search = Search(Index.load(spark, a.index))
        for query in a.query or iter(lambda: input("> ").strip(), ""):
            if a.analyze:
                print(analyze(query))
            found = search.search(query, a.limit)
            print(f"{query}: {found.total_found} documents" if found.syntax_valid else f"{query}: {found.error_message}")
            for row in found.rows:
                print(f"  {row['doc_id']}")
    elif a.command == "stem":
        words = lines.read_words(spark, a.file) if a.file else spark.createDataFrame([(w,) for w in a.word], "word string")
        words.select("word", stem_russian(F.col("word")).alias("stem")).show(1000, truncate=False)
        if a.stats:
            stem_statistics(words).show()
    else:
        freq = zipf.term_frequencies(lines.read_lines(spark, a.input))
        ranked = zipf.rank_frequency(freq)
        ranked.orderBy("rank").limit(a.top_terms).show(a.top_terms, truncate=False)
        zipf.report(freq).show(truncate=False)
        if a.output:
            lines.write_csv(ranked.orderBy("rank"), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
