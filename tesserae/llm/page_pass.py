"""Problems 1, 3 and 5 over the pages table: models first, then one pass that restores, judges and parts each page."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm import body, encoding, language, spam
from tesserae.llm.sample import label, labelled_pages

MIN_LANGUAGE_CHARS = 200  # fixed by problem 3


class Models:
    """What is fitted before the pass; small and of fixed size."""

    def __init__(self, pages: DataFrame, *, lines: bool = False, languages: bool = False) -> None:
        sample = labelled_pages(pages)
        self.encoding = encoding.fit(sample, [row[3] for row in sample])
        self.top, self.pmi = spam.fit(pages)
        self.weights = body.fit([row[:3] for row in sample]) if lines or languages else {}
        self.detector = None
        if languages:
            texts = [(lang, "\n".join(x for _, x, keep in body.body_lines(text, html, self.weights) if keep)) for lang, text, html, _ in sample]
            self.detector = language.fit(texts)


def _pass(models: Models, schema: pa.Schema, per_pages: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """per_pages(rows, restored texts, tools) gives rows of the result; pages that are spam are given only to judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {
            "repairer": encoding.Repairer(models.encoding) if models.encoding else None,
            "judge": spam.Judge(models.top, models.pmi),
            "weights": models.weights,
            "detector": language.Detector(models.detector) if models.detector is not None else None,
        }
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns = defaultdict(list)
                rows = [row for row in batch.slice(at, 500).to_pylist() if row["content"] and not row["content"].isspace()]
                texts = [(row["content"], row["encoding"]) for row in rows]
                if tools["repairer"]:
                    texts = tools["repairer"].texts(texts)
                for out in per_pages(rows, [restored for restored, _ in texts], tools):
                    for name, value in zip(schema.names, out, strict=True):
                        columns[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def _each(per_page: Callable) -> Callable:
    """Page by page: per_page(row, restored text, tools)."""

    def run(rows: list[dict], texts: list[str], tools: dict) -> Iterator[tuple]:
        for row, restored in zip(rows, texts, strict=True):
            yield from per_page(row, restored, tools)

    return run


_SPAM = pa.schema([("page_id", pa.int64()), ("share", pa.float64())])
_LINES = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32()), ("body", pa.bool_())])
_BODY = pa.schema([("page_id", pa.int64()), ("body", pa.string())])
_LANGS = pa.schema([("page_id", pa.int64()), ("lang", pa.string()), ("chars", pa.int32()), ("confidence", pa.float64()), ("labelled", pa.string()), ("languages", pa.int32())])
_SEGMENTS = pa.schema([("page_id", pa.int64()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("text", pa.string())])


def _share(row: dict, restored: str, tools: dict) -> list[tuple]:
    return [(row["page_id"], tools["judge"].share(restored, spam.links_out(row["links"], row["domain"])))]


def _body(row: dict, restored: str, tools: dict) -> list[tuple[int, str, bool]] | None:
    if tools["judge"].spam(restored, spam.links_out(row["links"], row["domain"])):
        return None
    return body.body_lines(row["content"], row["html_content"], tools["weights"], restored)


def _lines(row: dict, restored: str, tools: dict) -> list[tuple]:
    return [(row["page_id"], i, keep) for i, _, keep in _body(row, restored, tools) or ()]


def _text(row: dict, restored: str, tools: dict) -> list[tuple]:
    lines = _body(row, restored, tools)
    return [] if lines is None else [(row["page_id"], "\n".join(x for _, x, keep in lines if keep))]


def _segments(rows: list[dict], texts: list[str], tools: dict) -> list[list[tuple[str, float, str]]]:
    """The segments of each page; their words are described once for all pages given."""
    if not tools["detector"]:
        return [[] for _ in rows]
    bodies = [_body(row, restored, tools) or () for row, restored in zip(rows, texts, strict=True)]
    return tools["detector"].pages([[x for _, x, keep in lines if keep] for lines in bodies])


def _languages(rows: list[dict], texts: list[str], tools: dict) -> Iterator[tuple]:
    for row, found in zip(rows, _segments(rows, texts, tools), strict=True):
        chars: dict[str, int] = defaultdict(int)
        sure: dict[str, float] = defaultdict(float)
        for lang, confidence, text in found:
            chars[lang] += len(text)
            sure[lang] += confidence * len(text)
        large = sum(n >= MIN_LANGUAGE_CHARS for n in chars.values())
        for x in sorted(chars):
            yield row["page_id"], x, chars[x], sure[x] / chars[x], row["label"], large


def _segment_rows(rows: list[dict], texts: list[str], tools: dict) -> Iterator[tuple]:
    for row, found in zip(rows, _segments(rows, texts, tools), strict=True):
        for i, (lang, sure, text) in enumerate(found, 1):
            yield row["page_id"], i, lang, sure, sure < language.AMBIGUOUS, text


def _run(pages: DataFrame, models: Models, schema: pa.Schema, per_pages: Callable, ddl: str, *columns: str) -> DataFrame:
    return pages.where("content is not null").select("page_id", "content", "encoding", "domain", "links", *columns).mapInArrow(_pass(models, schema, per_pages), ddl)


def spam_shares(pages: DataFrame) -> DataFrame:
    """(page_id, share) of every page with visible content: the share of its characters in spam blocks."""
    return _run(pages, Models(pages), _SPAM, _each(_share), "page_id bigint, share double")


def spam_pages(pages: DataFrame) -> DataFrame:
    """(page_id): pages at least half of which is spam."""
    return spam_shares(pages).where(f"share >= {spam.SHARE}").select("page_id")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, body) of every non-empty line of the pages that aren't spam."""
    return _run(pages, Models(pages, lines=True), _LINES, _each(_lines), "page_id bigint, line_no int, body boolean", "html_content")


def page_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body): the body's lines of every page that isn't spam, restored where they were garbled."""
    return _run(pages, Models(pages, lines=True), _BODY, _each(_text), "page_id bigint, body string", "html_content")


def _labelled(pages: DataFrame) -> DataFrame:
    return pages.withColumn("label", label(pages["language"]))


def page_languages(pages: DataFrame) -> DataFrame:
    """(page_id, lang, chars, confidence, labelled, languages): each language with sentences in a page's body, the label's
    language (null: none or none of the six) and the number of languages with MIN_LANGUAGE_CHARS characters or more."""
    ddl = "page_id bigint, lang string, chars int, confidence double, labelled string, languages int"
    return _run(_labelled(pages), Models(pages, languages=True), _LANGS, _languages, ddl, "html_content", "label")


def relabelled_pages(pages: DataFrame) -> DataFrame:
    """(page_id, lang) of pages without a right label and of pages in two languages."""
    found = page_languages(pages).where(f"chars >= {MIN_LANGUAGE_CHARS}")
    return found.where("languages > 1 or labelled is null or labelled <> lang").select("page_id", "lang")


def page_segments(pages: DataFrame) -> DataFrame:
    """(page_id, segment, lang, confidence, ambiguous, text) of every sentence of the pages' bodies."""
    ddl = "page_id bigint, segment int, lang string, confidence double, ambiguous boolean, text string"
    return _run(pages, Models(pages, languages=True), _SEGMENTS, _segment_rows, ddl, "html_content")
