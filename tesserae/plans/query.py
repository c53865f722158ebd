"""The boolean query language: lexer, parser, rewriting and analysis; all of it on the driver, none of it on data.

    a && b    a b    a || b    !a    (a || b) && !c    "a phrase"    "near words" / 5    # comment

Words are folded like index tokens, in phrases too. A word with ``-``, ``_`` or ``'`` inside is what the index holds of
it: a phrase of its parts (``compat=True`` keeps it one term, which no index token equals)."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass(frozen=True)
class Token:
    kind: str  # term, phrase, near, and, or, not, (, ), end
    value: str
    position: int


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    operand: Node


Node = Term | Phrase | Near | And | Or | Not

_LEXER = re.compile(
    r"""(?P<space>\s+)|(?P<comment>\#[^\n]*)|(?P<and>&&)|(?P<or>\|\|)|(?P<not>!)|(?P<open>\()|(?P<close>\))
    |"(?P<phrase>[^"]*)"(?:\s*/\s*(?P<near>\d*))?|(?P<term>[^\W_][\w'-]*)""",
    re.X,
)


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEXER.match(text, at)
        if m is None:
            raise QuerySyntaxError("unclosed quote" if text[at] == '"' else f"unexpected {text[at]!r}", at)
        kind = m.lastgroup
        if m["phrase"] is not None:
            if m["near"] == "":
                raise QuerySyntaxError("a number must follow /", m.end())
            out.append(Token("phrase", m["phrase"], at))
            if m["near"]:
                out.append(Token("near", m["near"], m.end()))
        elif kind in ("and", "or", "not", "open", "close", "term"):
            out.append(Token({"open": "(", "close": ")"}.get(kind, kind), m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


class _Parser:
    def __init__(self, tokens: list[Token], *, compat: bool, fold: str) -> None:
        self.tokens, self.at, self.compat = tokens, 0, compat
        self.fold = str.lower if fold == "unicode" else lambda s: s.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))

    def take(self, *kinds: str) -> Token | None:
        token = self.tokens[self.at]
        if token.kind in kinds:
            self.at += 1
            return token
        return None

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Or(node, self.both())
        return node

    def both(self) -> Node:
        node = self.factor()
        while True:
            if self.take("and") or self.tokens[self.at].kind in ("term", "phrase", "not", "("):
                node = And(node, self.factor())
            else:
                return node

    def factor(self) -> Node:
        if self.take("not"):
            return Not(self.factor())
        token = self.tokens[self.at]
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise QuerySyntaxError("expected )", self.tokens[self.at].position)
            return node
        if self.take("term"):
            return self.word(token.value)
        if self.take("phrase"):
            words = tuple(self.fold(w) for w in token.value.split(" ") if w or self.compat)
            near = self.take("near")
            return Near(words, int(near.value)) if near else Phrase(words)
        raise QuerySyntaxError("expected a term" if token.kind != "end" else "unexpected end", token.position)

    def word(self, text: str) -> Node:
        text = self.fold(text)
        parts = [p for p in re.split(r"[-_']+", text) if p]
        if self.compat or len(parts) == 1 and parts[0] == text:
            return Term(text)
        return Term(parts[0]) if len(parts) == 1 else Phrase(tuple(parts))


def parse(text: str, *, compat: bool = False, fold: str = "unicode") -> Node:
    tokens = lex(text)
    if len(tokens) == 1:
        raise QuerySyntaxError("empty query", 0)
    parser = _Parser(tokens, compat=compat, fold=fold)
    node = parser.either()
    if not parser.take("end"):
        raise QuerySyntaxError("unexpected input", tokens[parser.at].position)
    return node


def parse_keywords(text: str) -> Node:
    """Extension: AND, OR and NOT as words beside the signs."""
    return parse(re.sub(r"\bAND\b", "&&", re.sub(r"\bOR\b", "||", re.sub(r"\bNOT\b", "!", text))))


def parse_simple(text: str) -> tuple[str, list[str]]:
    """The small grammar of the pattern search: (operation, patterns); the first that fits of && , ||, leading !, words."""
    text = text.strip()
    for sign, name in (("&&", "and"), ("||", "or")):
        if sign in text:
            return name, [p.strip() for p in text.split(sign)]
    if text.startswith("!"):
        return "not", [text[1:].strip()]
    words = text.split()
    return ("and", words) if len(words) > 1 else ("term", words)


def optimize(node: Node) -> Node:
    """``X op X`` becomes X and ``!!X`` becomes X, everywhere in the tree."""
    match node:
        case And(a, b) | Or(a, b):
            a, b = optimize(a), optimize(b)
            return a if a == b else type(node)(a, b)
        case Not(x):
            x = optimize(x)
            return x.operand if isinstance(x, Not) else Not(x)
    return node


def to_string(node: Node) -> str:
    match node:
        case Term(t):
            return t
        case Phrase(ts):
            return '"' + " ".join(ts) + '"'
        case Near(ts, n):
            return '"' + " ".join(ts) + f'" / {n}'
        case And(a, b):
            return f"({to_string(a)} && {to_string(b)})"
        case Or(a, b):
            return f"({to_string(a)} || {to_string(b)})"
        case Not(x):
            return "!" + to_string(x)
    raise TypeError(node)


def print_tree(node: Node, depth: int = 0) -> str:
    pad = "  " * depth
    match node:
        case And(a, b) | Or(a, b):
            return f"{pad}{type(node).__name__.upper()}\n{print_tree(a, depth + 1)}\n{print_tree(b, depth + 1)}"
        case Not(x):
            return f"{pad}NOT\n{print_tree(x, depth + 1)}"
    return f"{pad}{type(node).__name__.upper()} {to_string(node)}"


def terms_of(node: Node) -> list[str]:
    """Distinct terms from left to right, negated ones too."""
    match node:
        case Term(t):
            found = [t]
        case Phrase(ts) | Near(ts, _):
            found = list(ts)
        case And(a, b) | Or(a, b):
            found = terms_of(a) + terms_of(b)
        case Not(x):
            found = terms_of(x)
    return list(dict.fromkeys(found))


def complexity(node: Node) -> int:
    match node:
        case And(a, b) | Or(a, b):
            return 1 + complexity(a) + complexity(b)
        case Not(x):
            return 1 + complexity(x)
    return 1


def matches_nothing(node: Node) -> bool:
    """Whether a document without any of the terms matches."""
    match node:
        case And(a, b):
            return matches_nothing(a) and matches_nothing(b)
        case Or(a, b):
            return matches_nothing(a) or matches_nothing(b)
        case Not(x):
            return not matches_nothing(x)
    return False


def validate(text: str) -> bool:
    try:
        parse(text)
    except QuerySyntaxError:
        return False
    return True


def analyze(text: str) -> dict:
    try:
        node = optimize(parse(text))
    except QuerySyntaxError as e:
        return {"original_query": text, "terms": [], "complexity": 0, "is_valid": False, "parse_tree": "", "error_message": str(e)}
    return {"original_query": text, "terms": terms_of(node), "complexity": complexity(node), "is_valid": True, "parse_tree": to_string(node), "error_message": ""}
