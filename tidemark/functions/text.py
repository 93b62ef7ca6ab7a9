"""Text scalars of the retrieval domain as Column functions.

The three overlap semantics differ on purpose: whole tokens, substrings, or tokens of one field with
substrings of another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0b\f\r]+"


def words(text: Column) -> Column:
    """Lower-cased tokens in order, repeats included; none for an empty or null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(words(text))


def strip_marks(text: Column) -> Column:
    """Without question and exclamation marks."""
    return F.translate(text, "?!", "")


def long_terms(text: Column) -> Column:
    """Tokens of over three characters, their outer punctuation stripped afterwards."""
    return F.transform(F.filter(words(text), lambda t: F.length(t) > 3), lambda t: F.regexp_replace(t, r"^[?!.,]+|[?!.,]+$", ""))


def keywords(text: Column, stop: Sequence[str], most: int = 8) -> Column:
    """First distinct tokens of over two characters without outer punctuation and stop words."""
    bare = F.transform(words(text), lambda t: F.regexp_replace(t, r"^[?!.,]+|[?!.,]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: (F.length(t) > 2) & ~t.isin(list(stop)))), 1, most)


def overlap_tokens(terms: Column, text_tokens: Column) -> Column:
    return F.size(F.array_intersect(terms, text_tokens))


def overlap_substrings(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def any_word(text: Column, found: Sequence[str]) -> Column:
    """Whether any of the phrases is a substring of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in found:
        out = out | F.contains(low, F.lit(w))
    return out


def expand_synonyms(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """The terms and, one hop, all synonyms of a group whose base or member a term is."""
    extra = [F.when(F.arrays_overlap(terms, F.array(*(F.lit(x) for x in [base, *members]))), F.array(*(F.lit(x) for x in members))).otherwise(F.array().cast("array<string>")) for base, members in synonyms.items()]
    return F.array_distinct(F.concat(terms, *extra))


def rewrite(text: Column, expansions: Sequence[tuple[str, str]]) -> Column:
    """The lower-cased text with each phrase replaced in turn, in what earlier ones put in as well."""
    out = F.lower(text)
    for phrase, new in expansions:
        out = F.replace(out, F.lit(phrase), F.lit(new))
    return out


def rewrite_applied(text: Column, expansions: Sequence[tuple[str, str]], suffix: str) -> tuple[Column, Column]:
    """The rewritten text, with the suffix on the unchanged text if nothing applied, and the applied phrases."""
    out, applied = F.lower(text), F.array().cast("array<string>")
    for phrase, new in expansions:
        applied = F.when(F.contains(out, F.lit(phrase)), F.concat(applied, F.array(F.lit(phrase)))).otherwise(applied)
        out = F.replace(out, F.lit(phrase), F.lit(new))
    some = F.size(applied) > 0
    return F.trim(F.when(some, out).otherwise(F.concat(text, F.lit(suffix)))), F.when(some, applied).otherwise(F.array(F.lit("generic")))


def short_id(first: Column, *rest: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the first column, or of the others joined by | if that is empty."""
    key = F.coalesce(F.when(first != "", first), F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in rest)))
    return F.substring(F.sha1(key), 1, 12)


def clamp(value: Column) -> Column:
    """Between 0 and 1; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def first_json(text: Column, schema: str) -> Column:
    """The outermost braces of a reply, parsed; code fences around them do not matter."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """Name of the first rule with a word in the text."""
    out = None
    for name, found in rules:
        out = F.when(any_word(text, found), name) if out is None else out.when(any_word(text, found), name)
    return F.lit(other) if out is None else out.otherwise(other)


def signal(quality: Column) -> Column:
    return F.when(quality >= 0.7, "excellent").when(quality >= 0.5, "positive").when(quality >= 0.3, "acceptable").otherwise("negative")


def confidence(quality: Column) -> Column:
    return F.when(quality >= 0.5, "HIGH").when(quality >= 0.3, "MEDIUM").otherwise("LOW")


def sentiment_label(mean: Column) -> Column:
    return F.when(mean >= 0.05, "positive").when(mean <= -0.05, "negative").otherwise("neutral")


def badge(is_cve: Column, tags: Column) -> Column:
    return F.when(is_cve, "CVE").when(F.array_contains(tags, "SECURITY"), "SECURITY").when(F.array_contains(tags, "BREAKING"), "BREAKING").otherwise("OK")


def tier(source: Column, tier1: Sequence[str], tier2: Sequence[str]) -> Column:
    return F.when(source.isin(list(tier1)), 1).when(source.isin(list(tier2)), 2).otherwise(3)


def tier_name(number: Column) -> Column:
    return F.when(number == 1, "VERIFIED").when(number == 2, "COMMUNITY").otherwise("UNVERIFIED")
