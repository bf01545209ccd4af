"""Text functions on columns: cleaning, names, tokens, stems and the form used for detection."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv

SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def java(pattern: str, flags: str = "") -> str:
    """Give a pattern Unicode classes and boundaries (they are ASCII by default in Java)."""
    return f"(?{flags}U){pattern}"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, java(rf"^{SPACE}+|{SPACE}+\z"), "")


def filled(template: str, *values: Column) -> Column:
    """A text in which each ``{}`` is the next value."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for value, part in zip(values, parts[1:], strict=True) for x in (value, F.lit(part))])


def clean_control(text: Column) -> Column:
    """Remove control characters other than newline, carriage return and tab."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), fv.CONTROL, "")


def clean_layout(text: Column) -> Column:
    """Drop NUL, blanks before a newline and empty lines beyond one; trim."""
    text = F.regexp_replace(text, r"\x00", "")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def safe_name(name: Column) -> Column:
    """Last part of a path without unsafe characters, at most 200 characters; empty if nothing is left."""
    parts = F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    last = F.try_element_at(F.filter(parts, lambda p: ~p.isin("", ".")), F.lit(-1))
    kept = F.regexp_replace(F.coalesce(last, F.lit("")), fv.UNSAFE_NAME_CHARS, "")
    return F.substring(F.btrim(kept, F.lit(" .")), 1, fv.MAX_NAME_CHARS)


def stem(token: Column) -> Column:
    """Light suffix stripping; the first rule that fits wins."""
    n = F.length(token)
    cut = lambda k: token.substr(F.lit(1), n - k)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & token.endswith("es") & F.substring(token, -3, 1).isin("s", "x", "z"), cut(2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .when((n > 6) & token.endswith("ing"), cut(3))
        .when((n > 5) & token.endswith("ed"), cut(2))
        .otherwise(token)
    )


def words_but(text: Column, stop: Iterable[str]) -> Column:
    """Lower-cased words of two or more characters that are not in ``stop``, unstemmed, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}{{2,}}"), F.lit(0))
    return F.filter(words, lambda word: ~word.isin(*dict.fromkeys(stop)))


def content_words(text: Column) -> Column:
    """Unstemmed index words of a passage; explode them and apply :func:`stem` to stay in generated code."""
    return words_but(text, fv.STOP_WORDS)


def tokenize(text: Column) -> Column:
    """Index terms of a passage, in order."""
    return F.transform(content_words(text), stem)


def query_terms(text: Column) -> Column:
    """Set of terms of a question."""
    return F.array_distinct(F.transform(words_but(text, fv.QUESTION_STOP_WORDS), stem))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form. ASCII text is its own NFKC form and is not sent to Python."""
    other = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_nfkc(other), text)


def normalise_for_detection(text: Column) -> Column:
    """NFKC, no invisible characters, single spaces, lower case, letter-spaced words joined."""
    text = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), fv.INVISIBLE, "")
    return join_letters(F.lower(F.regexp_replace(text, java(f"{SPACE}+"), " ")))


def join_letters(text: Column) -> Column:
    """Words written with a space after each letter, four letters at least, without these spaces."""
    single = rf"[a-z](?!{WORD})"
    run = rf"(?:\G(?!^)|(?<!{WORD})(?=(?:[a-z] ){{3,}}{single}))([a-z]) (?={single})"
    return F.regexp_replace(text, run, "$1")


def bound(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that it names several times and that is worked out once, also where a filter repeats the whole expression."""
    return F.transform(F.array(value), step)[0]


def normalise_passage(text: Column) -> Column:
    """:func:`normalise_for_detection` for many texts, in less time: ASCII texts have no invisible characters and need no Unicode classes, a space alone is not replaced
    by itself, and letters are looked at where four stand alone."""
    runs = lambda one: f" {one}+|[{one}&&[^ ]]{one}*"
    narrow = lambda x: F.regexp_replace(x, runs(r"[\t-\r\x1c-\x1f ]"), " ")
    wide = lambda x: F.regexp_replace(F.regexp_replace(x, fv.INVISIBLE, ""), java(runs(SPACE)), " ")
    spaced = bound(nfkc(F.coalesce(text, F.lit(""))), lambda x: F.lower(F.when(F.octet_length(x) == F.length(x), narrow(x)).otherwise(wide(x))))
    return bound(spaced, lambda x: F.when(x.rlike("[a-z] [a-z] [a-z] [a-z]"), join_letters(x)).otherwise(x))
