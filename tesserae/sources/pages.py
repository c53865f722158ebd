"""The page store: reading, upserts, deletes, filters; and extraction of page records from HTML.

Extraction parses with the standard library inside mapInArrow, one batch of pages at a time; everything else is built in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.frontier import netloc

# --- store ---------------------------------------------------------------------------------------------------------


def find(pages: DataFrame, *, where: Column | None = None, skip: int = 0, limit: int = 0, order: str = "page_id") -> DataFrame:
    """Rows in id order; limit 0 is none."""
    rows = pages if where is None else pages.where(where)
    if skip or limit:
        rows = rows.orderBy(order)
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit else rows


def stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def upsert(pages: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The last stored version of each url (by crawled_at, then page_id), with the crawled_at of its first version as
    created_at. Rows of a null url stay each for itself. A hot url's versions are reduced before the shuffle."""
    rows = pages if new is None else pages.unionByName(new, allowMissingColumns=True)
    keyed = rows.where("url is not null")
    order = F.struct(F.coalesce("crawled_at", F.lit("0001-01-01").cast(rows.schema["crawled_at"].dataType)), "page_id")
    last = keyed.groupBy("url").agg(F.max(order).alias("o"), F.min("crawled_at").alias("created_at")).select(F.col("o.page_id").alias("page_id"), "created_at")
    kept = keyed.join(last, "page_id")
    return kept.unionByName(rows.where("url is null").withColumn("created_at", F.col("crawled_at")))


def updated(pages: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return pages.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(pages: DataFrame, where: Column) -> DataFrame:
    return pages.where(~F.coalesce(where, F.lit(False)))


def mark_processed(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages whose id is among ``ids`` get processed = true."""
    done = ids.select("page_id").distinct().withColumn("_done", F.lit(True))
    return pages.join(done, "page_id", "left").withColumn("processed", F.coalesce("_done", "processed")).drop("_done")


def by_domain(pages: DataFrame, domain: str, skip: int = 0, limit: int = 0) -> DataFrame:
    return find(pages, where=F.col("domain") == domain, skip=skip, limit=limit)


def unprocessed(pages: DataFrame) -> DataFrame:
    return pages.where(~F.coalesce("processed", F.lit(False)))


def long_enough(pages: DataFrame, n: int = 1000) -> DataFrame:
    return pages.where(F.length("content") >= n)


def statistics(pages: DataFrame) -> DataFrame:
    """(total, processed, unprocessed, domains, total_bytes, mean_bytes, megabytes) in one aggregate."""
    size = F.col("content_length").cast("bigint")
    return pages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("processed")).alias("processed"),
        F.count_if(~F.coalesce("processed", F.lit(False))).alias("unprocessed"),
        F.countDistinct("domain").alias("domains"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_bytes"),
        (F.coalesce(F.sum(size), F.lit(0)) / 1048576).alias("megabytes"),
    )


def domains(pages: DataFrame) -> DataFrame:
    return pages.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


def fields(pages: DataFrame) -> DataFrame:
    """(field, type) of the store."""
    return pages.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in pages.schema], "field string, type string")


def page_document(pages: DataFrame) -> DataFrame:
    """The fixed projection of a stored page, defaults filled; domain is host with port, source and language stay."""
    url = F.col("url")
    return pages.select(
        "page_id", "url", F.coalesce("domain", F.when(netloc(url) != "", netloc(url))).alias("domain"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("encoding", F.lit("utf-8")).alias("encoding"), F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.length(F.coalesce("content", F.lit(""))).alias("content_length"), F.coalesce("status_code", F.lit(200)).alias("status_code"),
        F.coalesce("status", F.lit("downloaded")).alias("status"), F.coalesce("processed", F.lit(False)).alias("processed"), "source", "language",
    )


# --- extraction ----------------------------------------------------------------------------------------------------


def html_title(html: Column) -> Column:
    """The text of the title element, white space folded; null without html, empty without title."""
    raw = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(raw, "[\\t\\n\\r ]+", " "))


# Elements without text of their own, files that are no pages, schemes that lead to none.
DROPPED = frozenset("script style nav footer header aside noscript".split())
MEDIA = tuple(".jpg .jpeg .png .gif .svg .css .js .pdf .zip .rar .exe .mp3 .mp4 .avi .doc".split())
DOCUMENTS = tuple(".pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .tar .gz .jpg .jpeg .png .gif".split())  # links to these are no pages
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 table tr td th br pre section article blockquote dd dt".split())


def keep_link(link: str) -> bool:
    low = link.strip().lower()
    return bool(low) and not low.startswith(NO_PAGE) and not urlsplit(low).path.endswith(MEDIA)


class _Page(HTMLParser):
    """Collects title, first heading, metadata, links and the text of each marked region in one walk."""

    def __init__(self, region: re.Pattern[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.region = region
        self.stack: list[tuple[str, bool]] = []
        self.dropped = self.inside = 0
        self.title, self.heading = "", ""
        self.meta: dict[str, str] = {}
        self.links: list[tuple[str, bool]] = []
        self.tags: list[str] = []
        self.main: list[str] = []
        self.rest: list[str] = []
        self.paragraphs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("name") or a.get("property") or a.get("http-equiv")
            if name and "content" in a:
                self.meta[name.lower()] = a["content"]
            return
        if tag in BLOCKS:
            self.main.append("\n")
            self.rest.append("\n")
        if tag == "a" and keep_link(a.get("href", "")):
            self.links.append((a["href"].strip(), self.inside > 0))
        if tag in VOID:
            return
        mark = f"{tag} {a.get('id', '')} {a.get('class', '')} {a.get('itemprop', '')}"
        here = bool(self.region and self.region.search(mark))
        self.stack.append((tag, here))
        self.dropped += tag in DROPPED
        self.inside += here
        if tag == "p":
            self.paragraphs.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.main.append("\n")
            self.rest.append("\n")
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        for name, here in self.stack[at:]:
            self.dropped -= name in DROPPED
            self.inside -= here
        del self.stack[at:]

    def handle_data(self, data: str) -> None:
        names = [t for t, _ in self.stack]
        if "title" in names:
            self.title += data
            return
        if self.dropped:
            return
        if "h1" in names:
            self.heading += data
        self.rest.append(data)
        if self.inside:
            self.main.append(data)
            if "p" in names and self.paragraphs:
                self.paragraphs[-1] += data


def folded(parts: list[str]) -> str:
    lines = (re.sub(r"[ \t\r\f ]+", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


# Sources by host: where the main text stands, how many links are kept and which.
SITES = (
    ("wiki", re.compile(r"(^|\.)wikipedia\.org$"), re.compile(r"mw-content-text"), 50, lambda u, base: "/wiki/" in u and ":" not in urlsplit(u).path),
    ("blog", re.compile(r"(^|\.)habr\.com$"), re.compile(r"article-formatted-body|post__text|tm-article-body"), 30, lambda u, base: "/articles/" in u or "/post/" in u),
    ("qa", re.compile(r"(^|\.)stackoverflow\.com$"), re.compile(r"postcell|answercell|s-prose|post-text"), 20, lambda u, base: "/questions/" in u),
    ("generic", re.compile(r""), re.compile(r"^(?:main|article)\b|\b(?:content|article|post|entry)(?:-body|-content)?\b"), 40, lambda u, base: urlsplit(u).netloc == urlsplit(base).netloc),
)


def extract_page(url: str, html: str, source: str | None = None) -> tuple[str, str, str, dict[str, str], list[str]]:
    """(source, title, content, metadata, links). The source is that named, or the first whose host fits. Where its region
    is missing or shorter than 100 characters, the whole body stands for it."""
    host = urlsplit(url).netloc.lower().partition(":")[0]
    name, _, region, most, wanted = next((s for s in SITES if s[0] == source), None) or next(s for s in SITES if s[1].search(host))
    page = _Page(region)
    page.feed(html)
    page.close()
    main = folded(page.main)
    if name == "wiki" and any(p.strip() for p in page.paragraphs):
        main = "\n".join(folded([p]) for p in page.paragraphs if p.strip())
    content = main if len(main) > 100 else folded(page.rest)
    title = folded([page.heading]) or folded([page.title])
    links = []
    for link, _ in page.links:
        full = urljoin(url, link)
        if wanted(full, url) and full not in links:
            links.append(full)
        if len(links) == most:
            break
    return name, title, content, page.meta, links


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500).to_pylist()
            done = [(r["page_id"], r["url"], *extract_page(r["url"] or "", r["html_content"])) for r in rows]
            columns = list(zip(*done, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()),
                    pa.array(columns[4], pa.string()), pa.array([list(m.items()) for m in columns[5]], pa.map_(pa.string(), pa.string())),
                    pa.array(columns[6], pa.list_(pa.string())),
                ],
                ["page_id", "url", "parser", "title", "content", "metadata", "links"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, parser, title, content, metadata, links) from html_content; pages without it give no row."""
    ddl = "page_id bigint, url string, parser string, title string, content string, metadata map<string,string>, links array<string>"
    return pages.where("html_content is not null").select("page_id", "url", "html_content").mapInArrow(_extract, ddl)


def html_links(html: Column) -> Column:
    """array<string>: href values of a page's links in order, those that lead to no page left out."""
    found = F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    good = lambda x: (F.length(F.trim(x)) > 0) & ~F.lower(x).rlike("^(?:#|javascript:|mailto:|tel:)") & ~F.lower(x).rlike("\\.(?:" + "|".join(m[1:] for m in DOCUMENTS) + ")$")
    return F.filter(found, good)


def detect_encoding(content_type: Column, html: Column) -> Column:
    """Charset of the header, else of the page's meta element, else utf-8."""
    header, meta = F.regexp_extract(content_type, "(?i)charset=[\"']?([\\w-]+)", 1), F.regexp_extract(html, "(?i)<meta[^>]+charset=[\"']?([\\w-]+)", 1)
    return F.lower(F.coalesce(F.nullif(header, F.lit("")), F.nullif(meta, F.lit("")), F.lit("utf-8")))


def latest_first(pages: DataFrame, key: str = "domain") -> DataFrame:
    """Pages with their place by age within the key, the newest first."""
    w = Window.partitionBy(key).orderBy(F.desc("crawled_at"), F.desc("page_id"))
    return pages.withColumn("place", F.row_number().over(w))
