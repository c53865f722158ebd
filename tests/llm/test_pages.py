"""Problems 1, 2, 3, 5 and 6 on small pages made here and on the smallest tables."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest

from tesserae.llm import body, encoding, html_tree, language, markup, page_pass, sample, spam

DATA = Path("/root/testdata/sf0.01/pages.parquet")
PAGES = "page_id bigint, title string, content string, html_content string, domain string, language string, lang string, encoding string, links array<string>"

NOUNS = {"en": "river house garden letter window teacher market bridge winter story", "ru": "река дом сад письмо окно учитель рынок мост зима рассказ"}
OPEN = {
    "en": """When the {a} of the old {b} was closed, nobody there knew what to do next.|A {a} near the {b} has been painted white, although people liked it grey.
Before noon she had already seen the {a}, the {b} and both of their owners.|Why should any {a} be built so far from a {b} as this one is?
It takes about an hour to walk from our {a} up to their {b}, if it doesn't rain.|They found no {a} in that {b}, which surprised everyone but him.
Most of what we know about the {a} comes from letters kept in the {b}.|If you open the {a} too early, its {b} will lose all its colour.
He said that this {a} could never become a {b}, and he was right.|The {a} stood empty for years until somebody put a {b} into it.
Only one {a} out of ten survives long enough to see another {b}.|With every {a} that was sold, the price of a {b} went up again.""".replace("\n", "|").split("|"),
    "ru": """Когда старый {a} за городом закрыли, никто там не знал, что делать дальше.|Возле этого места недавно покрасили {a} и {b}, хотя людям нравилось и так.
До полудня она уже видела {a}, потом {b} и обоих их хозяев.|Зачем строить {a} так далеко, если рядом уже есть {b} и даже не один?
Пешком отсюда до них идти около часа, если не мешают ни {a}, ни {b}.|Они не нашли там свой {a}, и это удивило всех, кроме него одного.
Почти всё, что мы знаем про {a}, взято из писем, где описан {b}.|Если открыть {a} слишком рано, то {b} потеряет весь свой цвет.
Он говорил, что {a} никогда не станет таким, как {b}, и был прав.|Много лет {a} стоял пустым, пока кто-то не поставил туда {b}.
Лишь один {a} из десяти живёт так долго, чтобы увидеть новый {b}.|С каждым проданным днём дорожал {a}, а вслед за ним и {b}.""".replace("\n", "|").split("|"),
}


def sentences(lang, rng, n):
    words = NOUNS[lang].split()
    return " ".join(x.format(a=rng.choice(words), b=rng.choice(words)) for x in rng.sample(OPEN[lang], n))


def make(rng, i, lang):
    whole = sentences(lang, rng, 12).replace(". ", ".|").replace("? ", "?|").split("|")
    paragraphs = [" ".join(whole[k : k + 3]) for k in range(0, 12, 3)]
    nav, foot = ("Home | About | Help", "All rights reserved by the site") if lang == "en" else ("Главная | О сайте | Помощь", "Все права на сайт защищены")
    content = "\n".join([nav, *paragraphs, f"{foot} {i}"])
    html = f"<html><head><title>t</title></head><body><div class='menu'><a href='/'>{nav}</a></div><div class='c1'>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div><div class='foot'>{foot} {i}</div></body></html>"
    return content, html


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "ru"
        content, html = make(rng, i, lang)
        rows.append([i, "title", content, html if i % 5 else None, f"s{i % 4}", {"en": "English", "ru": "ru-RU"}[lang], "clash", None, None])
    rows[10][5] = None  # no label
    rows[11][5] = "ru"  # a wrong one
    rows[12][2] = rows[12][2] + "\n" + sentences("en", rng, 4)  # two languages
    rows[12][3] = None
    keywords = ["sofa", "cheap", "pump", "buy", "price", "drill", "sale", "order"]
    rows[13][2] = ", ".join(rng.choice(keywords) for _ in range(400))
    rows[14][2] = "cheap sofa, " * 200
    rows[15][2] = "\n".join(f"{rng.choice(['Alpha', 'Beta'])} {rng.choice(keywords)} {rng.randint(1, 9999)}" for _ in range(150))
    rows[16][2] = rows[16][2].encode("cp1251").decode("koi8-r")
    rows[16][1] = "Новый заголовок страницы".encode().decode("cp1251", "replace")
    rows[17][2] = rows[17][2] + "\nHe wrote the word «Ð¡Ð»Ð¾Ð²Ð¾» as an example of a wrong table."
    for k, content in enumerate([None, "", "  \n ", "x", "слово " * 30_000, "\n" * 100]):
        rows.append([500 + k, None, content, None, None, None, "clash", "koi8-r", []])
    return spark.createDataFrame(rows, PAGES)


def test_spam(pages):
    found = {r.page_id for r in page_pass.spam_pages(pages).collect()}
    assert found == {13, 14, 15, 504}


def test_garbled(pages):
    got = {(r.page_id, r.field): r.restored for r in encoding.garbled_fields(pages).collect()}
    assert set(got) == {(16, "content"), (16, "title")}
    assert "старый {a}".format(a="")[:6] in got[16, "content"] and "Все права на сайт" in got[16, "content"]


def test_lines(pages):
    content = {r.page_id: r.content for r in pages.collect()}
    rows = page_pass.page_lines(pages).collect()
    wrong = [(r.page_id, r.line_no) for r in rows if r.page_id not in (12, 17, 16) and r.page_id < 500 and r.body != (2 <= r.line_no <= 5)]
    assert not wrong
    assert len({(r.page_id, r.line_no) for r in rows}) == len(rows)
    assert not {13, 14, 15, 500, 501, 502} & {r.page_id for r in rows}
    assert len(content) == 126


def test_languages(pages):
    found = {(r.page_id, r.lang) for r in page_pass.relabelled_pages(pages).collect()}
    assert found == {(10, "ru"), (11, "en"), (12, "ru"), (12, "en")}
    segments = [r for r in page_pass.page_segments(pages).collect() if r.page_id == 12]
    assert {r.lang for r in segments} == {"ru", "en"} and all(0 <= r.confidence <= 1 for r in segments)


def test_empty_table(pages):
    none = pages.where("false")
    assert page_pass.spam_pages(none).collect() == [] and page_pass.page_lines(none).collect() == []
    assert page_pass.relabelled_pages(none).collect() == [] and encoding.garbled_fields(none).collect() == []
    assert markup.page_kinds(none).collect() == [] and markup.clean_pages(none).collect() == []


def test_labels(spark):
    pairs = {"ru": "ru", "RU": "ru", "ru-RU": "ru", "rus": "ru", "Russian": "ru", "en_US": "en", " de ": "de", "und": None, "": None, "unknown": None, "zh": None, None: None}
    df = spark.createDataFrame([(k,) for k in pairs], "language string")
    assert {r[0]: r[1] for r in df.select("language", sample.label(df["language"])).collect()} == pairs


CHAINS = [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "latin-1")]


@pytest.fixture(scope="module")
def repairer():
    rng = random.Random(2)
    return encoding.Repairer(encoding.fit([(lang, sentences(lang, rng, 1)) for lang in ("ru", "en") for _ in range(300)]))


@pytest.mark.parametrize(("true", "wrong"), CHAINS)
def test_round_trips(repairer, true, wrong):
    text = sentences("ru", random.Random(9), 3)
    raw = text.encode(true)
    garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    assert repairer.text(garbled) == (text, 1)


def test_twice_garbled_and_sound(repairer):
    text = sentences("ru", random.Random(4), 2)
    once = "".join(bytes([b]).decode("cp1251", "ignore") or chr(b) for b in text.encode())
    twice = "".join(bytes([b]).decode("cp1251", "ignore") or chr(b) for b in once.encode())
    assert repairer.text(twice)[0] == text
    for sound in (text, text.upper(), "¿Qué? ¡Sí! n.º 5 — «да»", "Größe für Übung", "", "x" * 10_000, "Привет latinская"):
        assert repairer.text(sound) == (sound, 0)


def test_output_codes():
    assert language.CODEWORDS.shape == (6, 31)
    distance = [(a != b).sum() for i, a in enumerate(language.CODEWORDS) for b in language.CODEWORDS[:i]]
    assert min(distance) >= 15  # of seven wrong bits none changes the language


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_languages_held_out():
    import duckdb

    rows = duckdb.sql(f"SELECT language, content FROM '{DATA}' WHERE language IN ('ru','en','uk','de','fr','es') AND content IS NOT NULL ORDER BY page_id").fetchall()
    model = language.fit(rows[::2])
    detector = language.Detector(model)
    right = total = 0
    for lang, text in rows[1::2]:
        segments = detector.segments([x for x in text.split("\n") if len(x) > 150])
        for found, _, s in segments:  # noqa: B007
            total += len(s)
            right += len(s) * (found == lang)
    assert total and right / total > 0.9  # labels are wrong on some pages and some pages are in two languages


def test_tree_scoring():
    html = "<body><nav>Menu one two three four five six seven</nav><table><tr><td><font size=1>Notice, long, with, many, commas, in, small, type</font></td><td><h2>Head</h2><p>Text of the page, with commas, and words enough to score.</p><li>Item</td><td><p>More text of the page, the second half of it.</p></td></tr></table><footer>Foot, foot, foot, foot, foot and more foot</footer>"
    blocks = html_tree.parse(html)
    assert [b.text[:4] for b in blocks] == ["Menu", "Noti", "Head", "Text", "Item", "More", "Foot"]
    assert html_tree.main_body(blocks) == [False, False, True, True, True, True, False]
    assert html_tree.parse("") == [] and html_tree.main_body([]) == []
    assert [b.text for b in html_tree.parse("a < b &amp; c<br>d<script>x</script><p>e")] == ["a < b & c", "d", "e"]
    assert html_tree.parse("<" * 2000 + "<div>" * 2000 + "x")[-1].text.endswith("x")


def test_lines_align_by_text():
    html = "<body><div class=a>Menu</div><div class=b><p>First paragraph, with commas, of the page.</p><p>Second one, with commas, too, of the page.</p></div>"
    got = body.by_tree(["Menu", "not in html", "First  paragraph, with commas, of the page.", "Second one, with commas, too, of the page."], html)
    assert got == [False, None, True, True]


def test_same_lines():
    rng = random.Random(3)
    b = [rng.choice("abcdefgh") + (str(i) if rng.random() < 0.5 else "") for i in range(300)]
    a = [x for x in b if rng.random() < 0.9]
    pairs = body.same_lines(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q for x, y in zip(pairs, pairs[1:], strict=False) for p, q in zip(x, y, strict=True))
    assert len(pairs) > 0.8 * len(a) and body.same_lines(b, b) == [(i, i) for i in range(300)]
    assert body.same_lines([], b) == body.same_lines(a, []) == [] and body.same_lines(["x"] * 5, ["x"] * 3) == [(0, 0), (1, 1), (2, 2)]
    # very long pages take the same way
    began = time.perf_counter()
    assert len(body.same_lines(["menu", "x"] * 50_000, ["menu", "x"] * 50_000)) == 100_000 and time.perf_counter() - began < 5
    # a body line that the footer repeats stays what its place makes it
    html = "<body><div class=b><p>First paragraph, with commas, of the page.</p><p>Repeated line, with commas, too, of the page.</p></div><div class=f><a href=/>Repeated line, with commas, too, of the page.</a></div>"
    got = body.by_tree(["not in html", "First paragraph, with commas, of the page.", *["Repeated line, with commas, too, of the page."] * 2, "nor this"], html)
    assert got == [None, True, True, False, None]


KINDS = {
    "<p>a</p>": {"html"}, "a &nbsp; b": {"html"}, "<!-- x --> a": {"html"}, "a<br/>b": {"html"}, "&lt;p&gt;": {"html"},
    "== Head ==": {"wiki"}, "[[a|b]] c": {"wiki"}, "{{s|x}}": {"wiki"}, "''it'' b": {"wiki"}, "a<ref name=\"k\">x</ref>": {"wiki"}, "<nowiki>a[1] = b;</nowiki>": {"wiki"}, "{| class=x": {"wiki"},
    "# Head": {"markdown"}, "a **b** c": {"markdown"}, "__a b__": {"markdown"}, "~~a~~": {"markdown"}, "`a`": {"markdown"}, "[a](/b)": {"markdown"}, "> quote": {"markdown"}, "```": {"markdown"}, "|---|---|": {"markdown"},
    "\\section{a}": {"latex"}, "\\item a": {"latex"}, "a~\\cite{k}": {"latex"}, "$s = C / r^{3}$": {"latex"}, "$$\\frac{a}{b}$$": {"latex"}, "\\(x \\le y\\)": {"latex"}, "\\begin{equation}": {"latex"},
    "": set(), "plain text": set(), "x < 6 and y > 3": set(), "C#9 — 40$ a piece*, model 5$": set(), "5 * 3 * 2": set(), "std::vector<int> post(5);": set(), "Map<String, List<Integer>> m = load(5);": set(),
    "cd C:\\temp\\run1 && build.bat": set(), "#tag #other_tag": set(), "Home > Articles > x": set(), "a | b | c": set(), "for (i = 0; i < n; ++i) a[i] **= 2;": set(), "rock 'n' roll": set(), "def __init__(self): return a[i]": set(),
}


MORE_KINDS = {
    "<script>": {"html"}, "Buy <button>now</button>": {"html"}, f"<div style=\"{'x' * 320}\">a": {"html"}, f"[a](/{'b' * 320})": {"markdown"}, "in \\mathcal{L} of": {"latex"}, "\\subfigure{a}": {"latex"},
    f"${'a + ' * 200}b$": {"latex"}, f"**{'a ' * 400}b**": {"markdown"}, "a <!-- one\n\ntwo --> b": {"html"}, "{{box\n|a=1\n}}": {"wiki"}, "<img\nsrc='a.png'>": {"html"}, "$$\na\n$$": {"latex"},
    "If \\emph{a} material is old, it goes (so they say); it's fine.": {"latex"}, "While one [[a|b]] closes: c (d)": {"wiki"}, "Call `x = load(5)` now, **please**.": {"markdown"}, "copy C:\\temp\\run1": set(), "usage: run <file> now": set(),
    "R&D; AT&T;": set(), "handlers[i](event);": set(), "``": set(), "<!-- open": {"html"}, "cost $5 and $6 - or so": set(), "a]] b}} c** --> d": set(),
}
ALL_KINDS = KINDS | MORE_KINDS


def kinds_on_host(texts):
    """The kinds of each text if all stand on one host."""
    known = {}
    for _ in markup.learn((("h", t) for t in texts), known):
        pass
    held = {k for e, _ in known.values() for k, yes in markup.held(e).items() if yes}
    return [{markup.kind(t.key) for _, found, _ in markup.lexed(x) for t in found if t.key in held} for x in texts]


@pytest.mark.parametrize("text", sorted(ALL_KINDS))
def test_markup_kinds(text):
    assert kinds_on_host([text]) == [ALL_KINDS[text]]


def test_wrappers_decide():
    paths = [f"cd C:\\temp\\run{i} && build" for i in range(5)] + [f"run <file> with {i}" for i in range(5)]
    assert kinds_on_host(paths) == [set()] * 10
    # what isn't complete in itself is markup where its host shows that it parts slots, or begins lines
    mixed = ["One old house \\hfill three trees", "Two rivers meet \\hfill nobody knows", "<par>Some text", "<par>Other words"]
    assert kinds_on_host(mixed[:1]) == [set()] and kinds_on_host(mixed) == [{"latex"}, {"latex"}, {"html"}, {"html"}]
    # the pair on one page speaks for the open one on another page of the host
    assert kinds_on_host(["see <x>this</x> now", "see <x>that"]) == [{"html"}, {"html"}]
    assert kinds_on_host(["see <x>that"]) == [set()]


def test_markup_pages(spark):
    texts = sorted(ALL_KINDS)
    rows = [(i, t, "h" if i % 3 else None, "x") for i, t in enumerate(texts)] + [(900, None, "h", "x"), (901, "**a** " * 20_000, "h", "x"), (902, "<file> " * 3, "other", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, content string, domain string, host string")
    want = set()
    for host in (0, 1):
        part = [(i, t) for i, t, d, _ in rows if t is not None and (d == "h") == bool(host) and i < 902]
        want |= {(i, k) for (i, _), ks in zip(part, kinds_on_host([t for _, t in part]), strict=True) for k in ks}
    assert {(r.page_id, r.kind) for r in markup.page_kinds(df).collect() if r.page_id < 902} == want
    assert {(i, k) for i, t in enumerate(texts) for k in ALL_KINDS[t]} <= want
    cleaned = {r.page_id: r.content for r in markup.clean_pages(df).collect()}
    assert len(cleaned) == len(rows) and cleaned[900] is None
    wrappers = markup.host_wrappers(df).collect()
    assert any("code:html_tag:int" in r.rejected for r in wrappers)


def test_clean_by_wrapper(spark):
    rows = [(1, "Old house \\hfill trees **x**", "a"), (2, "Rivers meet \\hfill nobody", "a"), (3, "cd C:\\temp\\run1 && build", "a"), (4, "cd C:\\temp\\run2 && build", "a"), (5, "plain", "a")]
    df = spark.createDataFrame(rows, "page_id bigint, content string, domain string")
    got = {r.page_id: (r.content, r.changed) for r in markup.clean_pages(df).collect()}
    assert got[1] == ("Old house  trees x", True) and got[2] == ("Rivers meet  nobody", True)
    assert got[3] == (rows[2][1], False) and got[4] == (rows[3][1], False) and got[5] == ("plain", False)


def test_clean_keeps_structure():
    text = "<h2>Head</h2>\n* [[a|item]]\n```\nx = a[1] ** 2\n```\n\\begin{equation}\nE = m c^2\n\\end{equation}\n**bold** and $a = b$ &amp; `code`\nplain 5 * 3"
    assert markup.clean(text) == "# Head\n- item\nx = a[1] ** 2\nE = m c^2\nbold and a = b & code\nplain 5 * 3"


def test_clean_texts_of_constructs():
    assert markup.clean("a\\footnote{kept text} b \\emph{c \\textbf{d}} \\cite{k1}e \\href{/u}{text}") == "a (kept text) b c d e /u text"
    assert markup.clean("one <!-- hidden\nand hidden --> two\n$$\nx = 1\n$$") == "one  two\nx = 1"
    assert markup.clean("**a [b](/c \"t\") d** ''e'' {{box|f|g=h}} ![alt](i.png)") == "a b d e f, h alt"


@pytest.mark.parametrize("sign", ["<a ", "<!--", "$x", "{{", "[[", "**a", "`", "\\a{", "''", "[a](", "&a", "<a \"", "_a", "$$", "\\["])
def test_markup_of_long_broken_texts(sign):
    began = time.perf_counter()
    list(markup.lexed(sign * 20_000))
    list(markup.lexed((sign + "\n") * 20_000))
    assert time.perf_counter() - began < 20


def test_alignment():
    line = "One **two**"
    found = markup.tokens(line)
    a = markup.folded(found, line)
    assert [x[0] for x in a] == ["=One", "markdown_strong", "=two", "/markdown_strong"] and markup.read(markup.written(a)) == a
    assert markup.shown(markup.folded(markup.tokens(x := "One **two** and **three** there"), x)) == "~+ markdown_strong+ ~+ /markdown_strong+ 'there'"
    b = markup.folded(markup.tokens("**x** [a](/b) y"), "**x** [a](/b) y")
    both = markup.aligned(a, b)
    assert {x[0] for x in both} >= {"~", "markdown_strong", "/markdown_strong", "markdown_link"}
    again = both
    for _ in range(50):
        again = markup.aligned(again, b)
    assert len(again) <= len(both)


def test_pmi_table_is_bounded(pages):
    top, direction = spam.fit(pages)
    assert len(top) <= spam.TOP and direction.shape == (spam.CLASSES, spam.CLASSES) and np.isfinite(direction).all()
    judge = spam.Judge(top, direction)
    assert judge.share("") == judge.share("\n \n") == 0.0
