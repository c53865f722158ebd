"""Tokens and byte strings as Columns. All of it stays in built-in functions.

A token is a run of non-delimiters, cut after 51 characters; it is kept if it has 2 to 50 bytes (a cut piece of 51
characters is kept as it is). ``fold`` is ``unicode`` (default) or ``ascii`` (letters A-Z only)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# C-locale white space and ASCII punctuation end a token; bytes above 127 never do.
DELIMITERS = "\\t\\n\\x0B\\f\\r !-/:-@\\[-`{-~"
RUN = "[^" + DELIMITERS + "]{1,51}"
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT = 51
ZIPF_MARKS = ".,!?;:\"'()[]{}"


@dataclass(frozen=True)
class TokenizerConfig:
    min_bytes: int = 2
    max_bytes: int = 50
    remove_numbers: bool = False
    remove_punctuation: bool = True  # kept for compatibility: punctuation always ends a token
    fold: str = "unicode"
    stop_words: tuple[str, ...] = field(default=())

    def save(self) -> str:
        """One ``key=value`` line for each setting, values as JSON."""
        return "\n".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in asdict(self).items()) + "\n"

    @staticmethod
    def load(text: str) -> TokenizerConfig:
        values = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
        known = {k: json.loads(v) for k, v in values.items() if k in TokenizerConfig.__dataclass_fields__}
        return TokenizerConfig(**(known | ({"stop_words": tuple(known["stop_words"])} if "stop_words" in known else {})))

    def with_stop_words(self, *words: str) -> TokenizerConfig:
        return TokenizerConfig(**{**asdict(self), "stop_words": tuple(dict.fromkeys([*self.stop_words, *words]))})

    def without_stop_words(self, *words: str) -> TokenizerConfig:
        return TokenizerConfig(**{**asdict(self), "stop_words": tuple(w for w in self.stop_words if w not in words)})


DEFAULT = TokenizerConfig()

# The built-in Russian stop words.
RUSSIAN_STOP_WORDS = tuple(
    """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну
ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам
чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были
куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем
хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def fold(c: Column, how: str = "unicode") -> Column:
    return F.lower(c) if how == "unicode" else lower_ascii(c)


def normalize(raw: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    term = fold(raw, cfg.fold)
    return F.regexp_replace(term, "[0-9]", "") if cfg.remove_numbers else term


def kept(term: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    """Whether a normalised token stays."""
    size = F.octet_length(term)
    ok = (size >= cfg.min_bytes) & ((size <= cfg.max_bytes) | (F.length(term) == CUT))
    return ok & ~term.isin(*cfg.stop_words) if cfg.stop_words else ok


def tokens(text: Column, cfg: TokenizerConfig = DEFAULT) -> Column:
    """array<string> of the text's tokens in order; null text has none (null)."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.filter(F.transform(runs, lambda t: normalize(t, cfg)), lambda t: kept(t, cfg))


def segments(text: Column) -> Column:
    """array<string>: the text cut into runs and the delimiters between them, nothing lost."""
    return F.regexp_extract_all(text, F.lit(RUN + "|[" + DELIMITERS + "]+"), F.lit(0))


def is_delimiter(c: Column) -> Column:
    return c.rlike("^[" + DELIMITERS + "]$")


def is_punctuation(c: Column) -> Column:
    return c.rlike("^[!-/:-@\\[-`{-~]$")


def zipf_tokens(text: Column) -> Column:
    """Words parted by white space, longer than two characters before marks are stripped from their ends."""
    words = F.split(F.lower(text), "[\\t\\n\\x0B\\f\\r ]+")
    return F.transform(F.filter(words, lambda t: F.length(t) > 2), lambda t: F.btrim(t, F.lit(ZIPF_MARKS)))


def word_set(text: Column) -> Column:
    """Distinct words of at least two letters or digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 2))


# Byte strings: positions and lengths count bytes, from 0; -1 stands for "not found".
def byte_find(c: Column, what: str) -> Column:
    if not what:
        return F.lit(-1)
    at = F.instr(c, F.lit(what))
    return F.when(at > 0, F.octet_length(F.substring(c, F.lit(1), at - 1))).otherwise(-1)


def byte_substr(c: Column, start: int, length: int) -> Column:
    return F.substring(c.cast("binary"), start + 1, length)


def byte_erase(c: Column, start: int, length: int) -> Column:
    raw = c.cast("binary")
    return F.concat(F.substring(raw, 1, start), F.substring(raw, start + length + 1, 2**30))


def byte_insert(c: Column, start: int, what: str) -> Column:
    raw = c.cast("binary")
    return F.concat(F.substring(raw, 1, start), F.lit(what).cast("binary"), F.substring(raw, start + 1, 2**30))


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def split_on(c: Column, delimiter: str) -> Column:
    """Parts between the delimiters, empty ones kept."""
    return F.split(c, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1) if delimiter else F.array(c)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trim_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_alpha(c: Column) -> Column:
    return c.rlike("^[A-Za-z\\x{80}-\\x{10FFFF}]+$")


def is_alnum(c: Column) -> Column:
    return c.rlike("^[0-9A-Za-z\\x{80}-\\x{10FFFF}]+$")
