"""Stems as Columns: a byte-cutting compatibility rule and the public Snowball algorithm for Russian."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import lower_ascii


def should_stem(word: Column) -> Column:
    return F.octet_length(word) >= 3


def stem_bytes(word: Column) -> Column:
    """Compatibility: ASCII-lower; more than six bytes lose two, six lose one, shorter ones stay. binary, as a letter may be cut."""
    low = lower_ascii(word)
    raw, size = low.cast("binary"), F.octet_length(low)
    cut = F.when(size > 6, 2).when(size == 6, 1).otherwise(0)
    return F.when(size < 3, word.cast("binary")).otherwise(F.substring(raw, F.lit(1), size - cut))


def base_form(word: Column) -> Column:
    """The word itself (the base form is the word as given)."""
    return word


# Fixed values of the Snowball description for Russian; in alternatives the longest comes first.
VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = "вшись|вши|в", "ившись|ывшись|ивши|ывши|ив|ыв"
ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем|нн|вш|ющ|щ", "ивш|ывш|ующ"
VERB_1 = "ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н"
VERB_2 = "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of the value, which is computed once however often it stands there; the generated code stays short."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def _first_step(rv: Column) -> Column:
    """A gerund, or else the reflexive ending and one of adjective, verb and noun."""
    gerund = f"(?:(?<=[ая])(?:{GERUND_1})|(?:{GERUND_2}))$"
    adjective = f"(?:{ADJECTIVE})$"
    participle = f"(?:(?<=[ая])(?:{PARTICIPLE_1})|(?:{PARTICIPLE_2}))$"
    verb = f"(?:(?<=[ая])(?:{VERB_1})|(?:{VERB_2}))$"

    def calm(c: Column) -> Column:
        return F.when(c.rlike(adjective), _cut(_cut(c, adjective), participle)).when(c.rlike(verb), _cut(c, verb)).otherwise(_cut(c, f"(?:{NOUN})$"))

    return F.when(rv.rlike(gerund), _cut(rv, gerund)).otherwise(_with(_cut(rv, "(?:ся|сь)$"), calm))


def _last_step(c: Column) -> Column:
    """One n of two, a superlative (then an n too), or a soft sign."""
    superlative = "(?:ейше|ейш)$"
    return F.when(c.rlike("нн$"), _cut(c, "н$")).when(c.rlike(superlative), F.regexp_replace(_cut(c, superlative), "нн$", "н")).otherwise(_cut(c, "ь$"))


def stem_russian(word: Column) -> Column:
    """Snowball stem of a Russian word; words without a Russian vowel stay as they are, lower-cased; null stays null."""

    def stem(w: Column) -> Column:
        head = F.regexp_extract(w, f"^[^{VOWELS}]*[{VOWELS}]", 0)
        # the third step needs the region after the second vowel and consonant
        before = F.length(F.regexp_extract(w, f"^.*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]", 0))

        def rest(p: Column) -> Column:
            rv = F.substring(w, F.length(p.head) + 1, F.length(w))

            def derived(second: Column) -> Column:
                region = F.substring(F.concat(p.head, second), p.before + 1, F.length(w))
                return F.when((p.before > 0) & region.rlike("ость?$"), _cut(second, "ость?$")).otherwise(second)

            done = _with(_with(_cut(_with(rv, _first_step), "и$"), derived), _last_step)
            return F.when(F.length(p.head) == 0, w).otherwise(F.concat(p.head, done))

        return _with(F.struct(head.alias("head"), before.alias("before")), rest)

    return _with(F.regexp_replace(F.lower(word), "ё", "е"), stem)


def stem_statistics(words: DataFrame, column: str = "word") -> DataFrame:
    """(processed, changed, bytes_removed, ratio) of the compatibility stems; ratio is 1.0 without words."""
    word, stem = F.col(column), stem_bytes(F.col(column))
    before, after = F.octet_length(word), F.octet_length(stem)
    return words.where(word.isNotNull()).agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.count_if(stem != word.cast("binary")), F.lit(0)).alias("changed"),
        F.coalesce(F.sum(F.greatest(before - after, F.lit(0))), F.lit(0)).cast("bigint").alias("bytes_removed"),
        F.coalesce(F.try_divide(F.sum(after), F.sum(before)), F.lit(1.0)).alias("ratio"),
    )
