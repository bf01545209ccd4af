"""Guardrail functions: screening, redaction, fencing, answer checks.

Functions named after a step add columns to a table, so that every intermediate text is computed once and all
steps of a row stay in one stage of generated code.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import bound, clean_control, java, normalise_for_detection, normalise_passage, query_terms, strip

VERDICT = "struct<allowed:boolean,text:string,flags:array<string>,reason:string>"
_END = r"(?=\n?\z)"


def _pattern(text: str) -> str:
    """Java form of a fixed pattern; ``$`` is the end of the text or a newline that ends it."""
    return java(text.replace("|$)", f"|{_END})"))


def _named(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def _no_flags() -> Column:
    return F.array().cast("array<string>")


def screen_input(df: DataFrame, text: str, out: str = "verdict", *, max_chars: int = fv.MAX_QUERY_CHARS,
                 mode: str = "block") -> DataFrame:
    """Add the verdict on a user text: allowed, cleaned text, rule names and reason."""
    clean, norm, low, flags = "__clean", "__norm", "__low", "__flags"
    staged = df.withColumn(clean, strip(clean_control(F.col(text))))
    staged = staged.withColumn(norm, normalise_for_detection(F.col(clean))).withColumn(low, F.lower(clean))
    matched = _named([(name, F.col(low if name in fv.RAW_TEXT_RULES else norm).rlike(java(pattern)))
                      for name, pattern, _ in fv.INPUT_RULES])
    staged = staged.withColumn(flags, matched)
    high = F.array(*[F.lit(name) for name, _, severity in fv.INPUT_RULES if severity == "high"])
    blocked = F.arrays_overlap(F.col(flags), high) if mode == "block" else F.lit(False)

    def verdict(allowed: bool, value: Column, names: Column, reason: str | None) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), value.alias("text"), names.alias("flags"),
                        F.lit(reason).cast("string").alias("reason"))

    value = F.col(clean)
    result = (
        F.when(value == "", verdict(False, value, _no_flags(), fv.EMPTY_QUERY))
        .when(F.length(value) > max_chars,
              verdict(False, F.substring(value, 1, max_chars), _no_flags(), fv.LONG_QUERY.format(max_chars=max_chars)))
        .when(blocked, verdict(False, value, F.col(flags), fv.BLOCKED_QUERY))
        .otherwise(verdict(True, value, F.col(flags), None))
    )
    return staged.withColumn(out, result).drop(clean, norm, low, flags)


def flag_suspicious(df: DataFrame, text: str, out: str = "suspicious") -> DataFrame:
    """Add whether a document text tries to instruct a model."""
    def instructs(norm: Column) -> Column:
        hit = F.lit(False)
        for pattern, groups in zip(fv.DOCUMENT_RULES, fv.DOCUMENT_HINTS, strict=True):
            fits = norm.rlike(java(pattern))
            for group in reversed(groups):  # words are looked for first: that takes far less time than a pattern
                fits = reduce(or_, [F.contains(norm, F.lit(word)) for word in group]) & fits
            hit = hit | fits
        return hit

    return df.withColumn(out, bound(normalise_passage(F.col(text)), instructs))


def redact_secrets(df: DataFrame, text: str, out: str | None = None, found: str | None = None) -> DataFrame:
    """Replace secret keys in ``text`` by their label; optionally name the kinds found.

    Every step names the step before it once, so that a filter pushed through the steps stays as small as they are.
    Texts without any hint of a key are null in the steps and cost one search.
    """
    out = out or text
    steps = [f"__s{i}" for i in range(len(fv.SECRET_PATTERNS) + 1)]
    df = df.withColumn(steps[0], F.when(F.col(text).rlike(fv.SECRET_HINT), F.col(text)))
    for before, after, (name, pattern) in zip(steps, steps[1:], fv.SECRET_PATTERNS):
        df = df.withColumn(after, F.regexp_replace(before, _pattern(pattern), f"[REDACTED_{name.upper()}]"))
    df = df.withColumn(out, F.coalesce(F.col(steps[-1]), F.col(text)))
    if found:
        df = df.withColumn(found, _named([(name, F.col(a) != F.col(b))
                                          for a, b, (name, _) in zip(steps, steps[1:], fv.SECRET_PATTERNS)]))
    return df.drop(*steps)


def _digit_table() -> tuple[str, str]:
    """All decimal digits outside ASCII and the ASCII digit each one stands for."""
    digits = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


_DIGITS_FROM, _DIGITS_TO = _digit_table()


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits with a right check sum; other characters are ignored."""
    digits = F.regexp_replace(F.translate(text, _DIGITS_FROM, _DIGITS_TO), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def redact_cards(text: Column) -> Column:
    """Replace card-shaped runs with a right check sum, each at its own place."""
    pattern = java(fv.CARD)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    joined = F.zip_with(between, matches, lambda gap, card: F.concat(
        gap, F.when(card.isNull(), "").when(luhn_valid(card), fv.CARD_LABEL).otherwise(card)))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def redact_pii(df: DataFrame, text: str, out: str | None = None, found: str | None = None) -> DataFrame:
    """Replace cards, then e-mail, identity and phone numbers, each on the text left by the step before."""
    out = out or text
    names = ["credit_card"] + [name for name, _, _ in fv.PII_PATTERNS]
    steps = [f"__p{i}" for i in range(len(names) + 1)]
    df = df.withColumn(steps[0], F.col(text)).withColumn(steps[1], redact_cards(F.col(steps[0])))
    for before, after, (_, pattern, label) in zip(steps[1:], steps[2:], fv.PII_PATTERNS):
        df = df.withColumn(after, F.regexp_replace(before, java(pattern), label))
    df = df.withColumn(out, F.col(steps[-1]))
    if found:
        df = df.withColumn(found, _named([(n, F.col(a) != F.col(b)) for a, b, n in zip(steps, steps[1:], names)]))
    return df.drop(*steps)


def neutralise_fence(text: Column) -> Column:
    """Replace tags that could close or forge the fence around passages."""
    return F.regexp_replace(text, java(fv.FENCE_TAG, "i"), fv.FENCE_LABEL)


def source_attribute(name: Column) -> Column:
    """A document name made safe for a tag attribute."""
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r'["<>\n\r]', ""), 1, fv.MAX_SOURCE_CHARS)


def fenced_passage(pos: Column, source: Column, page: Column, content: Column, suspicious: Column) -> Column:
    """One numbered passage inside its fence."""
    page_part = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(' page="'), page.cast("string"), F.lit('"')))
    flag_part = F.when(suspicious, F.lit(f' flagged="{fv.FLAGGED_ATTRIBUTE}"'))
    return F.concat(
        F.lit('<document id="'), pos.cast("string"), F.lit('" source="'), source_attribute(source), F.lit('"'),
        F.coalesce(page_part, F.lit("")), F.coalesce(flag_part, F.lit("")), F.lit(">\n"),
        neutralise_fence(clean_control(content)), F.lit("\n</document>"),
    )


def context_block(hits: DataFrame, keys: list[str], *, pos: str = "pos", source: str = "document", page: str = "page",
                  content: str = "content", suspicious: str = "suspicious", out: str = "context") -> DataFrame:
    """One block of fenced passages per question. A question has at most 15 hits."""
    passage = fenced_passage(F.col(pos), F.col(source), F.col(page), F.col(content), F.col(suspicious))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), passage.alias("passage"))))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["passage"]), "\n\n").alias(out))


def canary(qid: Column, key: str) -> Column:
    """Reference code of a question, the same on every run with the same key."""
    return F.concat(F.lit(fv.CANARY_PREFIX), F.substring(F.sha2(F.concat_ws("|", F.lit(key), qid.cast("string")), 256), 1, 16))


def strip_reasoning(text: Column) -> Column:
    """Remove the reasoning blocks some models emit."""
    return strip(F.regexp_replace(text, java(fv.REASONING, "is"), ""))


def valid_image_ref(ref: Column) -> Column:
    """Whether an attached image is a supported data URL."""
    return ref.rlike(fv.IMAGE_REF.replace("$", _END))


def check_output(df: DataFrame, answer: str, canary_col: str, out: str = "checked", *,
                 max_chars: int = fv.MAX_ANSWER_CHARS) -> DataFrame:
    """Add the checked answer: leaked code refused, secrets scrubbed, over-long text cut."""
    clean, scrubbed, found = "__clean", "__scrubbed", "__found"
    df = df.withColumn(clean, clean_control(F.col(answer)))
    df = redact_secrets(df, clean, scrubbed, found)
    code = F.coalesce(F.col(canary_col), F.lit(""))
    leaked = (code != "") & F.contains(F.col(clean), code)
    long = F.length(scrubbed) > max_chars
    text = F.when(long, F.concat(F.substring(scrubbed, 1, max_chars), F.lit(fv.TRUNCATED_MARK))).otherwise(F.col(scrubbed))
    flags = _named([("secret_in_output", F.size(found) > 0), ("truncated", long)])
    result = F.when(leaked, F.struct(F.lit(fv.LEAK_REFUSAL).alias("text"), F.array(F.lit("system_prompt_leak")).alias("flags")))
    return df.withColumn(out, result.otherwise(F.struct(text.alias("text"), flags.alias("flags")))).drop(clean, scrubbed, found)


def creator_pattern(assistant_name: str | None = None) -> str:
    """The creator pattern, with the assistant's own name if it has one."""
    name = re.escape(assistant_name.lower()) if assistant_name else None
    return fv.CREATOR.replace("{or_names}", f"|{name}'?s?" if name else "").replace("{or_name}", f"|{name}" if name else "")


def classify_question(df: DataFrame, text: str, *, assistant_name: str | None = None) -> DataFrame:
    """Add ``is_creator``, ``is_identity``, ``is_library`` and ``is_overview``."""
    norm = "__norm"
    df = df.withColumn(norm, normalise_for_detection(F.col(text)))
    df = df.withColumn("is_creator", F.col(norm).rlike(java(creator_pattern(assistant_name))))
    overview = fv.OVERVIEW.replace(r"\W*$", rf"\W*{_END}")
    return (
        df.withColumn("is_identity", F.col("is_creator") | F.col(norm).rlike(java(fv.IDENTITY)))
        .withColumn("is_library", F.col(norm).rlike(java(fv.LIBRARY)))
        .withColumn("is_overview", (F.size(query_terms(F.col(text))) == 0) | F.col(text).rlike(java(overview, "i")))
        .drop(norm)
    )
