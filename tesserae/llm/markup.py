"""Problem 6: HTML, Markdown, wiki and LaTeX markup left in texts, and clean text that keeps their structure.

Method: union-free regular expressions inferred by alignment. A line is lexed by shape alone into candidate tokens (anything
that looks like a tag, a command, a pair of marks) and the gaps of text between them. Lines of one host that begin with the
same candidate are aligned one after another: what one side lacks becomes optional, what stands more than once becomes
repeated, a gap with the same text everywhere stays constant, any other becomes a slot. Every partition aligns its own
lines, the few expressions of a host and candidate are then aligned with each other: the host's wrappers.

The wrappers decide which candidates are markup. One that is complete in itself (a pair, an element closed on its page or
with attributes, a command with an argument) is. One that isn't, such as ``<word>`` or ``\\word``, is markup of the host if it
begins a line there, or if it parts slots; if the text around it is constant or it hangs on a word, it belongs to the text.
Pages get their kinds, and are cleaned, by what the wrappers of their host hold.

In lines of program code (known by their shape) only complete candidates, and what wraps the line, count.

Defined results: null content has no markup and stays null; null hosts are one host; pairs of marks (``**``, ``[[``) that aren't
closed in their line are text; comments, formulas, templates and tags may span lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize, shuffle_partitions

# Elements that have no end, and commands whose arguments aren't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEYS = frozenset("bibliography bibliographystyle cite citep citet documentclass eqref hspace includegraphics input include label pageref ref setlength usepackage vspace".split())

# Candidates by shape: one named group for each construct, the kind before the underscore; order is precedence. What a pair
# holds may not hold its opening mark again, so the search of a closing mark never runs over another opening one.
_PARTS = [
    ("html_comment", r"<!--(?:(?!<!--|-->).)*-->|<!--(?:(?!<!--).)*"),
    ("wiki_ref", r"</?ref\b[^<>]*>"),
    ("wiki_nowiki", r"</?nowiki\s*/?>"),
    ("html_tag", r"</?[a-z][\w:-]*(?:\s(?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*)?/?>|<![a-z][^<>]*>|<\?[a-z][^<>]*\?>"),
    ("html_entity", r"&(?:[a-z][a-z0-9]{1,31}|#[0-9]+|#x[0-9a-f]+);"),
    ("latex_command", r"(?<!\\)\\[a-z]+\*?"),
    ("latex_formula", r"(?<!\\)\\\((?:(?!\\[()]).)+\\\)|(?<!\\)\\\[(?:(?!\\[\[\]]).)+\\\]|\$\$[^$]+\$\$|(?<![\w$])\$(?=[^\s$])(?=[^$]*[\\^_{}=+/<>*-])[^$]*(?<=[^\s$])\$(?![\w$])|(?<![\w$])\$[a-z]\$(?![\w$])"),
    ("wiki_link", r"\[\[[^\[\]]+\]\]"),
    ("wiki_template", r"\{\{(?:(?!\{\{|\}\}).)+\}\}"),
    ("wiki_table", r"^\s*(?:\{\|.*|\|\}|\|-[^|]*)$"),
    ("wiki_heading", r"^\s*(?P<eq>={2,6})\s*[^=\s].*?(?P=eq)\s*$"),
    ("wiki_quotes", r"(?P<qu>'{2,5})(?!')(?:[^']|'(?!'))+'{2,5}"),
    ("markdown_fence", r"^\s*(?:```|~~~)[\w+-]*\s*$"),
    ("markdown_heading", r"^\s{0,3}#{1,6}\s+(?=\S)"),
    ("markdown_link", r"!?\[(?P<la>[^\[\]]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"),
    ("markdown_strong", r"\*\*(?=[^\s*])[^*]+?(?<=\S)\*\*|(?<!\w)__(?=[^\s_])[^_]+?(?<=\S)__(?!\w)"),
    ("markdown_strike", r"~~(?=[^\s~])[^~]+?(?<=\S)~~"),
    ("markdown_code", r"`[^`]+`"),
    ("markdown_quote", r"^\s{0,3}>\s+(?=\S)"),
    ("markdown_rule", r"^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$"),
    ("markdown_emphasis", r"(?<![\w*])\*(?=[^\s*])[^*]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_]+?(?<=[^\s_])_(?![\w_])"),
]
LEXER = re.compile("|".join(f"(?P<{name}>{part})" for name, part in _PARTS), re.I)
#: A text without any of these signs holds no candidate.
SIGNS = re.compile(r"[<&\\$\[{*_~`]|''|==|^\s*(?:#|>|\|)", re.M)
#: Candidates that may span lines, but no empty one (comments may).
_OVER_LINES = [
    ("<!--", re.compile(r"<!--(?:(?!<!--|-->).)*-->", re.S)),
    ("$$", re.compile(r"\$\$(?:[^$\n]|\n(?!\s*\n))+\$\$")),
    ("\\[", re.compile(r"(?<!\\)\\\[(?:(?!\\[\[\]]|\n\s*\n).)+\\\]", re.S)),
    ("{{", re.compile(r"\{\{(?:(?!\{\{|\}\}|\n\s*\n).)+\}\}", re.S)),
    ("<", re.compile(r"<[a-zA-Z][\w:-]*\s(?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'\n]|\n(?!\s*\n))*>")),
]
JOINT = "\x1e"  # stands for a line's end inside a candidate
#: Program code by its shape, once what is quoted in the line is off.
CODE = re.compile(
    r"[=(){}\[\]>:].*;\s*$|[)\w]\s*\{\s*$|\w\s*=\s*\w+[\[(]|^\s*\w+(?:::\w+|<[\w, <>]+>)\s"
    r"|^\s*(?:(?:if|for|while|switch)\s*\(|(?:if|elif|while|for|class|with)\b[^.,]*:\s*$|(?:def|function)\s+\w+\s*\(|return\b[^.]*[;)]\s*$|print\s*\("
    r"|(?:import|from)\s+[\w.]+(?:\s+(?:import|as)\s.*)?;?\s*$|(?:var|let|const)\s+\w+\s*=|select\s.+\sfrom\s|cd\s+\S+(?:\s*(?:&&|;).*)?$)",
    re.I,
)
QUOTED = re.compile(r"`[^`]*`|<(code|pre|nowiki)>.*?</\1>|\$[^$]*\$", re.I)
TEXT = "~"


class Token(NamedTuple):
    """A candidate (or one end of a pair): its construct and name, where it stands, whether it is complete in itself, and
    whether it hangs on the text beside it."""

    key: str
    start: int
    end: int
    firm: bool
    glued: bool


def joined(text: str) -> str:
    """The text with candidates over several lines on one."""
    for sign, pattern in _OVER_LINES:
        if sign in text:
            text = pattern.sub(lambda m: m[0].replace("\n", JOINT), text)
    return text


def _groups(line: str) -> dict[int, int]:
    """The place of every opening brace and of the one that closes it."""
    out, stack = {}, []
    for i, ch in enumerate(line):
        if ch == "{":
            stack.append(i)
        elif ch == "}" and stack:
            out[stack.pop()] = i
    return out


def tokens(line: str, code: bool = False, ended: frozenset[str] = frozenset()) -> list[Token]:
    """The candidates of a line in order; ``ended``: elements that its page closes somewhere."""
    if not SIGNS.search(line):
        return []
    code = code or bool(CODE.search(unescape(QUOTED.sub("", line))))
    found: list[Token] = []
    ends: dict[int, int] = {}  # closing marks of the pairs found so far
    groups: dict[int, int] | None = None
    at = 0

    def pair(name: str, s: int, inner: int, stop: int, e: int, firm: bool) -> None:
        found.append(Token(name, s, inner, firm, False))
        found.append(Token("/" + name, stop, e, firm, False))
        ends[stop] = e

    while (m := LEXER.search(line, at)) is not None:
        name, (s, e) = m.lastgroup, m.span()
        if name in ("eq", "qu", "la"):
            name = {"eq": "wiki_heading", "qu": "wiki_quotes", "la": "markdown_link"}[name]
        if s in ends:
            at = ends[s]
            continue
        at = e
        if name == "html_tag":
            bare = re.match(r"</?[!?]?([a-z][\w:-]*)", m[0], re.I)[1].lower()
            firm = m[0][1] in "/!?" or m[0][-2] == "/" or bare in VOID or bare in ended or '="' in m[0] or "='" in m[0]
            found.append(Token(f"{'/' if m[0][1] == '/' else ''}{name}:{bare}", s, e, firm, s > 0 and line[s - 1].isalnum()))
        elif name == "html_entity":
            if unescape(m[0]) != m[0]:
                found.append(Token(name, s, e, True, False))
        elif name == "latex_command":
            key, firm = f"{name}:{m[0][1:].rstrip('*').lower()}", False
            if groups is None:
                groups = _groups(line)
            while e < len(line) and line[e] == "[" and (stop := line.find("]", e)) > 0:
                e = stop + 1
            first = e
            while e in groups:
                firm = True
                stop = groups[e]
                if e > first:
                    found[-1] = found[-1]._replace(end=e + 1)  # one argument ends where the next begins
                    ends[found[-1].start] = e + 1
                else:
                    found.append(Token(key, s, e + 1, True, False))
                found.append(Token("/" + key, stop, stop + 1, True, False))
                ends[stop] = stop + 1
                e = stop + 1
            if not firm:
                hangs = (s > 0 and (line[s - 1].isalnum() or line[s - 1] in ":/")) or (e < len(line) and (line[e].isdigit() or line[e] == "\\"))
                found.append(Token(key, s, e, False, hangs))
            else:
                at = first + 1
        elif name in ("markdown_strong", "markdown_strike", "markdown_emphasis"):
            n = 1 if name == "markdown_emphasis" else 2
            pair(name, s, s + n, e - n, e, not code)
            at = s + n
        elif name == "wiki_quotes":
            n = len(m["qu"])
            k = len(m[0]) - len(m[0].rstrip("'"))
            pair(name, s, s + n, e - k, e, not code)
            at = s + n
        elif name == "wiki_heading":
            inner = s + m[0].index("=") + len(m["eq"])
            stop = s + len(m[0].rstrip().rstrip("="))
            pair(name, s, inner, stop, e, not code)
            at = inner
        elif name == "markdown_link":
            # an index that is called looks like a link: such a one hangs on a word
            hangs = s > 0 and line[s - 1].isalnum() and m[0][0] == "["
            pair(name, s, m.start("la"), m.end("la"), e, not code and not hangs)
            at = m.start("la")
        elif name == "wiki_link":
            label = s + (m[0].rfind("|") + 1 or 2)
            pair(name, s, label, e - 2, e, not code)
            at = label
        else:
            found.append(Token(name, s, e, not code or name in ("html_comment", "wiki_ref", "wiki_nowiki", "markdown_fence"), False))
    found.sort(key=lambda t: (t.start, t.end))
    if code:
        # what wraps the line counts; inside it a candidate is one of the code
        lo, hi = 0, len(line)
        for t in found:
            if t.start >= lo and not line[lo : t.start].strip():
                lo = t.end
        for t in reversed(found):
            if t.end <= hi and not line[t.end : hi].strip():
                hi = t.start
        found = [t if t.firm else t._replace(firm=True) if t.end <= lo or t.start >= hi else t._replace(key="code:" + t.key, glued=True) for t in found]
    return found


_OPEN, _CLOSE = re.compile(r"<([a-z][\w:-]*)", re.I), re.compile(r"</([a-z][\w:-]*)", re.I)


def lexed(text: str) -> Iterator[tuple[str, list[Token], bool]]:
    """(line, candidates, code) of every line, those of one candidate joined; what stands in a fence or verbatim is code."""
    text = joined(text)
    ended = frozenset()
    if "</" in text:
        opened = {x.lower() for x in _OPEN.findall(text)}
        ended = frozenset(x.lower() for x in _CLOSE.findall(text)) & opened
    fenced = False
    for line in text.split("\n"):
        found = tokens(line, fenced, ended)
        if any(t.key == "markdown_fence" for t in found):
            fenced = not fenced
            yield line, found, True
            continue
        low = line.strip().lower()
        if low.startswith("\\begin{verbatim}"):
            fenced = True
        elif low.startswith("\\end{verbatim}"):
            fenced = False
        yield line, found, fenced


# --- inference -----------------------------------------------------------------------------------------------------

# An expression is a list of [token, optional, repeated, firm, glued]; a token is a candidate's key, TEXT for a slot, or "="
# and what stands for a constant text.
Expression = list[list]


def _constant(text: str) -> str:
    text = text.strip()
    return "=" + (text if len(text) <= 24 else text[:8] + blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest())


def _is_gap(token: str) -> bool:
    return token[0] in "~="


def _merged(a: list, b: list) -> list:
    """Two equal tokens, or two gaps, as one."""
    return [a[0] if a[0] == b[0] else TEXT, a[1] or b[1], a[2] or b[2], a[3] or b[3], a[4] or b[4]]


def folded(found: list[Token], line: str) -> Expression:
    """A line's expression: candidates with the gaps between them, runs of the same pair folded into one repeat."""
    out: Expression = []
    at = 0
    for t in found:
        if line[at : t.start].strip():
            out.append([_constant(line[at : t.start]), False, False, False, False])
        out.append([t.key, False, False, t.firm, t.glued])
        at = max(at, t.end)
    if line[at:].strip():
        out.append([_constant(line[at:]), False, False, False, False])
    tight: Expression = []
    for token in out:
        tight.append(token)
        while True:
            for n in (1, 2, 4):  # a candidate, one and a gap, a pair around a gap and the gap after it
                a, b = tight[-2 * n : -n], tight[-n:]
                if len(a) == n and all(x[0] == y[0] or (_is_gap(x[0]) and _is_gap(y[0])) for x, y in zip(a, b, strict=True)) and not all(_is_gap(x[0]) for x in b):
                    tight[-2 * n :] = [_merged(x, y)[:2] + [True] + _merged(x, y)[3:] for x, y in zip(a, b, strict=True)]
                    break
            else:
                break
    return tight


def aligned(a: Expression, b: Expression) -> Expression:
    """The two expressions aligned: matches merge, gaps that differ become slots, what one side lacks becomes optional."""
    ka, kb = [TEXT if _is_gap(x[0]) else x[0] for x in a], [TEXT if _is_gap(x[0]) else x[0] for x in b]
    if ka == kb:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if ka[i] == kb[j] else max(below[j], row[j + 1])
    out: Expression = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[i] == kb[j]:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    # optional neighbours of the same candidate are one repeat: the expression stays short, however many lines come
    short: Expression = []
    seen: dict[str, int] = {}
    for token in out:
        key = TEXT if _is_gap(token[0]) else token[0]
        if token[1] and key in seen:
            k = seen[key]
            short[k] = _merged(short[k], token)[:1] + [short[k][1], True] + _merged(short[k], token)[3:]
        else:
            seen.setdefault(key, len(short))
            short.append(token)
    return short


def held(e: Expression) -> dict[str, bool]:
    """Each candidate of the expression and whether the expression makes it markup."""
    out: dict[str, bool] = {}
    before = True  # what stands before is the line's beginning, a slot or markup
    begins = True
    for k, (token, _, _, firm, glued) in enumerate(e):
        if _is_gap(token):
            before, begins = token == TEXT, False
            continue
        after = k + 1 == len(e) or not _is_gap(e[k + 1][0]) or e[k + 1][0] == TEXT
        yes = firm or (not glued and (begins or (before and after)))
        out[token] = out.get(token, False) or yes
        before, begins = yes, begins and yes
    return out


def written(e: Expression) -> str:
    return json.dumps(e, ensure_ascii=False, separators=(",", ":"))


def read(text: str) -> Expression:
    return json.loads(text)


def shown(e: Expression) -> str:
    """The expression as a pattern: slots ``~``, constants in quotes, ``?``, ``+`` and ``*`` for optional and repeated."""
    return " ".join((repr(t[1:]) if t[0] == "=" else t) + ("*" if o and r else "?" if o else "+" if r else "") for t, o, r, _, _ in e)


def learn(rows: Iterator[tuple[str, str]], known: dict[tuple[str, str], list]) -> Iterator[None]:
    """Aligns the lines of (host, text) rows into ``known``: (host, first candidate) to [expression, lines]."""
    for host, text in rows:
        if SIGNS.search(text):
            for line, found, _ in lexed(text):
                if found:
                    e, key = folded(found, line), (host, found[0].key)
                    if (old := known.get(key)) is None:
                        known[key] = [e, 1]
                    else:
                        old[0], old[1] = aligned(old[0], e), old[1] + 1
        yield


_WRAPPER = pa.schema([("host", pa.string()), ("construct", pa.string()), ("expression", pa.string()), ("lines", pa.int64())])
_DDL = "host string, construct string, expression string, lines bigint"


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], list] = {}

    def rows() -> pa.RecordBatch:
        items = [(host, key, written(e), n) for (host, key), (e, n) in known.items()]
        columns = list(zip(*items, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WRAPPER, strict=True)], schema=_WRAPPER)

    for batch in batches:
        for _ in learn(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), known):
            if len(known) > 200_000:
                yield rows()
                known.clear()
    yield rows()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All expressions of a host and candidate lie in one partition: align them in a fixed order."""
    parts: dict[tuple[str, str], set[str]] = {}
    lines: dict[tuple[str, str], int] = {}
    for batch in batches:
        for host, construct, expression, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.setdefault((host, construct), set()).add(expression)
            lines[host, construct] = lines.get((host, construct), 0) + n
    rows = []
    for (host, construct), texts in parts.items():
        whole = None
        for text in sorted(texts):
            whole = read(text) if whole is None else aligned(whole, read(text))
        rows.append((host, construct, written(whole), lines[host, construct]))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WRAPPER, strict=True)], schema=_WRAPPER)


def _host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce("domain", F.lit("")))


def _inferred(pages: DataFrame) -> DataFrame:
    """To a host and candidate each partition of the input brings one row, whatever the number of lines."""
    parts = _host(pages).where("content is not null").select("host", "content").mapInArrow(_wrappers, _DDL)
    return parts.repartition(shuffle_partitions(pages.sparkSession), "host", "construct").mapInArrow(_merge, _DDL)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, construct, expression, lines, rejected): the wrapper of each host, one expression for each candidate that begins
    a line's candidates; rejected: those in it that aren't markup by it."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x) for x in batch.column(2).to_pylist()]
            texts = pa.array([shown(e) for e in found], pa.string())
            no = pa.array([sorted(k for k, yes in held(e).items() if not yes) for e in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, batch.column(3), no], ["host", "construct", "expression", "lines", "rejected"])

    return _inferred(pages).mapInArrow(show, _DDL + ", rejected array<string>")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host, key) for host, e in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) for key, yes in held(read(e)).items() if yes]
        columns = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "construct"])


def held_constructs(pages: DataFrame) -> DataFrame:
    """(host, construct): what the wrappers of each host make markup."""
    return _inferred(pages).mapInArrow(_held, "host string, construct string").distinct()


def _page_constructs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, hosts, names = [], [], []
        for page, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if SIGNS.search(text):
                for name in {t.key for _, found, _ in lexed(text) for t in found}:
                    pages.append(page)
                    hosts.append(host)
                    names.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(hosts, pa.string()), pa.array(names, pa.string())], ["page_id", "host", "construct"])


SALTS = 16


def _by_host(rows: DataFrame, held: DataFrame, how: str) -> DataFrame:
    """Rows (page_id, host, construct) with what their host holds; a big host's pages are spread."""
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("page_id", F.lit(SALTS)).cast("int")).join(held, ["host", "construct", "salt"], how)


def page_constructs(pages: DataFrame) -> DataFrame:
    """(page_id, construct): candidates of each page that the wrappers of its host make markup."""
    own = _host(pages).where("content is not null").select("page_id", "host", "content").mapInArrow(_page_constructs, "page_id bigint, host string, construct string")
    return _by_host(own, held_constructs(pages), "left_semi").select("page_id", "construct")


def kind(construct: str) -> str:
    """The kind of markup a construct is of."""
    return construct.removeprefix("code:").removeprefix("/").partition("_")[0]


def page_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, kind) once for each kind of markup left in a page."""
    bare = F.regexp_replace("construct", "^(?:code:)?/?", "")
    return page_constructs(pages).select("page_id", F.substring_index(bare, "_", 1).alias("kind")).distinct()


# --- clean text ----------------------------------------------------------------------------------------------------

_LIST = re.compile(r"^\s*(?:[*+-]|\d+\.|\\item)\s+|^\s*<li[^>]*>", re.I)
_CELLS = re.compile(r"^\s*\|(.*?)\|?\s*$")
_FORMULAS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math")
_DROPPED = ("html_comment", "wiki_ref", "wiki_nowiki", "markdown_fence", "markdown_heading", "markdown_quote", "markdown_rule", "wiki_table")


def _plain(key: str, s: str) -> str:
    """What a token leaves behind."""
    construct, _, name = key.removeprefix("code:").removeprefix("/").partition(":")
    if construct == "html_tag":
        ends = s[1] == "/"
        if name in ("br", "hr") or (ends and name in ("p", "div", "tr")):
            return "\n"
        return "\t" if ends and name in ("td", "th") else ""
    if construct == "html_entity":
        return unescape(s)
    if construct == "wiki_template":
        return ", ".join(p.rpartition("=")[2].strip() for p in s[2:-2].split("|")[1:])
    if construct == "markdown_code":
        return s[1:-1]
    if construct == "latex_formula":
        return s.strip("$") if s[0] == "$" else s[2:-2].strip()
    if construct == "latex_command":
        if name == "footnote":
            return ")" if s[0] == "}" else " ("
        return " " if s.startswith("}") and s.endswith("{") else ""
    return ""


def _parts(line: str, found: list[Token]) -> str:
    """The line with its markup taken off."""
    out, at, skip = [], 0, 0
    for t in found:
        if t.start < at:
            continue
        name = t.key.removeprefix("/").partition(":")[2]
        if not skip:
            out.append(line[at : t.start])
            out.append(_plain(t.key, line[t.start : t.end]))
        if t.key.startswith("latex_command:") and t.firm and (name in KEYS or name in ("begin", "end")) and line[t.end - 1] == "{":
            skip += 1  # the argument is a name and no text
        elif skip and t.key.startswith("/latex_command:") and (name in KEYS or name in ("begin", "end")) and line[t.end - 1] == "}":
            skip -= 1
        at = t.end
    if not skip:
        out.append(line[at:])
    return "".join(out)


def clean(text: str, markup: frozenset[str] | None = None) -> str:
    """The text without markup: headings become ``# `` lines, list items ``- `` lines, code and formulas stay as they are.
    ``markup``: what its host's wrappers make markup of what isn't complete in itself (None: nothing)."""
    if not SIGNS.search(text):
        return text
    out = []
    fenced = formula = False
    for line, all_found, code in lexed(text):
        found = [t for t in all_found if t.firm or (markup is not None and t.key in markup)]
        names = {t.key for t in found}
        low = line.strip().lower()
        if "markdown_fence" in names:
            fenced = not fenced
            continue
        if low.startswith(("\\begin{", "\\end{")) and re.fullmatch(r"\\(?:begin|end)(?:\{[^{}]*\}|\[[^\]]*\])+", low):
            formula = low.startswith(tuple("\\begin{" + x for x in _FORMULAS))
            continue
        if names & {"wiki_table", "markdown_rule"}:
            continue
        if fenced or formula or code or not found:
            cells = _CELLS.match(line)
            out.append("\t".join(x.strip() for x in cells[1].split("|")) if cells and not (fenced or formula or code) else line.replace(JOINT, "\n"))
            continue
        sections = ("latex_command:section", "latex_command:subsection", "latex_command:subsubsection", "latex_command:chapter", *(f"html_tag:h{i}" for i in range(1, 7)))
        heading = bool(names & {"wiki_heading", "markdown_heading"}) or found[0].key in sections
        item = _LIST.match(line)
        done = _parts(line, found).replace(JOINT, "\n")
        if any(k.startswith("latex_command") for k in names):
            done = done.replace("~", " ")
        if item:
            done = "- " + re.sub(r"^\s*(?:[*+-]|\d+\.)\s+", "", done).strip()
        elif heading:
            done = "# " + done.strip()
        out += [x for x in done.split("\n") if x.strip()] or [""]
    return "\n".join(out)


def _clean_complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages whose candidates are complete in themselves, cleaned; others as they are, with the rest of their candidates."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts, open_, done = part.column(2).to_pylist(), [], []
            for t in texts:
                keys = sorted({x.key for _, found, _ in lexed(t) for x in found if not x.firm and not x.glued}) if t is not None and SIGNS.search(t) else []
                open_.append(keys)
                done.append(t if t is None or keys else clean(t))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(done, pa.string()), pa.array([a != b for a, b in zip(texts, done, strict=True)], pa.bool_()), pa.array(open_, pa.list_(pa.string()))],
                ["page_id", "host", "content", "changed", "open"],
            )


def _clean_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        done = [clean(t, frozenset(keys or ())) for t, keys in zip(texts, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(done, pa.string()), pa.array([a != b for a, b in zip(texts, done, strict=True)], pa.bool_())], ["page_id", "content", "changed"]
        )


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, content, changed) of every page, its markup turned into plain structure by its host's wrappers.

    Only pages with candidates that aren't complete in themselves are joined with what their host holds."""
    rows = _host(pages).select("page_id", "host", "content")
    first = materialize(rows.mapInArrow(_clean_complete, "page_id bigint, host string, content string, changed boolean, open array<string>"), "p6-first")
    rest = first.where(F.size("open") > 0)
    keys = _by_host(rest.select("page_id", "host", F.explode("open").alias("construct")), held_constructs(pages), "inner")
    keys = keys.groupBy("page_id").agg(F.collect_set("construct").alias("held"))  # one page's own
    done = rest.select("page_id", "content").join(keys, "page_id", "left").select("page_id", "content", "held")
    done = done.mapInArrow(_clean_open, "page_id bigint, content string, changed boolean")
    return first.where(F.size("open") == 0).select("page_id", "content", "changed").unionByName(done)
