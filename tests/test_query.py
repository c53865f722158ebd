from __future__ import annotations

import pytest

from tesserae.plans import query as q


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("термин", "термин"),
        ("A b", "(a && b)"),
        ("a && b || c", "((a && b) || c)"),
        ("a || b && c", "(a || (b && c))"),
        ("!!a", "!!a"),
        ("(красный || синий) && !медленный", "((красный || синий) && !медленный)"),
        ('"Old  Phrase" / 5', '"old phrase" / 5'),
        ("foo-bar", '"foo bar"'),
        ("it's # rest", '"it s"'),
        ("a # comment\n&& b", "(a && b)"),
    ],
)
def test_parse(text, tree):
    assert q.to_string(q.parse(text)) == tree


@pytest.mark.parametrize("text", ["", "   ", "# only", "&& a", "a &&", "()", "a & b", "a | b", "(a", "a)", '"open', '"a b" / x', "a : b", "invalid query!", "!"])
def test_errors(text):
    assert not q.validate(text)
    assert not q.analyze(text)["is_valid"]
    with pytest.raises(q.QuerySyntaxError):
        q.parse(text)


def test_analysis():
    a = q.analyze("(красный || синий) && !медленный")
    assert a["terms"] == ["красный", "синий", "медленный"]
    assert a["complexity"] == 6
    assert a["parse_tree"] == "((красный || синий) && !медленный)"
    assert q.print_tree(q.parse("a && !b")) == "AND\n  TERM a\n  NOT\n    TERM b"


def test_optimize_everywhere():
    assert q.to_string(q.optimize(q.parse("(a && a) || !!(b || b)"))) == "(a || b)"
    assert q.to_string(q.optimize(q.parse("!!!a"))) == "!a"


def test_matches_nothing():
    for text, want in (("a", False), ("!a", True), ("!a && b", False), ("!a || b", True), ("!(a || b)", True), ('!"a b"', True)):
        assert q.matches_nothing(q.parse(text)) is want


def test_compatibility_and_extensions():
    assert q.parse("foo-bar", compat=True) == q.Term("foo-bar")
    assert q.to_string(q.parse_keywords("a AND NOT b OR c")) == "((a && !b) || c)"
    assert q.parse_simple("a && !b") == ("and", ["a", "!b"])
    assert q.parse_simple("!x") == ("not", ["x"])
    assert q.parse_simple("a b") == ("and", ["a", "b"])
    assert q.parse_simple("a || b") == ("or", ["a", "b"])
