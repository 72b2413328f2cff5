"""Cleaning, tokens and predicates on field values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it, in a Java pattern.
WS = r"(?U)[\s\x1c-\x1f]"
#: What of it is ASCII.
ASCII_WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: An extracted value that says nothing, whole or from its start.
EMPTY_WORDS = ["null", "none", "n/a", "na"]
MISSING_PREFIXES = [
    "not specified", "not stated", "not provided", "not available", "not found", "not explicitly provided",
    "not explicitly stated", "not mentioned", "not included", "no information", "none specified",
]
#: A value that scoring counts as missing.
MISSING_PHRASES = [
    "", "null", "none", "n/a", "na", "not applicable", "not specified", "not stated", "not provided", "not available",
    "not found", "not explicitly provided", "not explicitly stated", "not specified in the rfp", "not stated in the rfp",
    "not provided in the rfp",
]
#: Section headings, and what shows that more than a heading stands there.
HEADINGS = [
    "section", "appendix", "rated criteria", "pricing schedule", "scope of work", "mandatory submission requirements",
    "mandatory technical requirements",
]
HEADING_DETAIL = r"\b\d+(?:\.\d+)?\s*%|\$\s*\d|\bminimum\b|\brequired\b|\bmust\b"
#: The pattern of e-mail addresses, and numbers as words.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def unicode_pattern(p: str) -> str:
    r"""A Java pattern whose \b, \d and \s mean what they mean in Python: combining marks are no part of words."""
    w = r"[\p{L}\p{N}_]"
    return "(?U)" + p.replace(r"\b", f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))").replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\x1c-\x1f]")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_ascii(c: Column) -> Column:
    """As many bytes as characters: what holds for plain letters only may be used then."""
    return F.octet_length(c) == F.char_length(c)


def quick_strip(c: Column) -> Column:
    """strip(), without a pattern where the text is ASCII."""
    return F.when(is_ascii(c), F.btrim(c, F.lit(ASCII_WS))).otherwise(strip(c))


def is_missing_phrase(stripped: Column) -> Column:
    """Whether a stripped value simplifies to a phrase that scoring counts as missing; of ASCII ones only those that begin like one are looked at."""
    first = F.lower(F.substring(F.ltrim(stripped, F.lit(ASCII_WS + " .;:")), 1, 1))
    begins = first.isin(sorted({p[:1] for p in MISSING_PHRASES}))
    return F.when(is_ascii(stripped) & ~begins, False).otherwise(simplified(stripped).isin(MISSING_PHRASES))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, also where the optimizer moves the expression into a filter."""
    return F.element_at(F.transform(F.array(x), f), 1)


def simplified(c: Column) -> Column:
    """Lower case, runs of white space as one space, no spaces or ' .;:' around."""
    other = r"\t\n\x0b\f\r\x1c-\x1f"
    plain = lambda x: F.regexp_replace(x, f"[{other}][ {other}]*| [ {other}]+", " ")  # noqa: E731 (for ASCII; single spaces stay as they are)
    return once(F.lower(c), lambda x: F.btrim(F.when(is_ascii(x), plain(x)).otherwise(F.regexp_replace(x, f"{WS}+", " ")), F.lit(" .;:")))


def clean_value(c: Column) -> Column:
    """The stripped value; null where it says nothing (extraction's notion of missing)."""
    missing = lambda s, simple: (s == "") | simple.isin(EMPTY_WORDS) | simple.rlike("^(?:" + "|".join(MISSING_PREFIXES) + ")")
    return once(quick_strip(c), lambda s: once(simplified(s), lambda simple: F.when(~missing(s, simple), s)))


def normalize_text(c: Column) -> Column:
    """A cleaned value for comparison; '' for missing."""
    said_nothing = r"(?s)\A(?:(?:" + "|".join(EMPTY_WORDS) + r")\z|(?:" + "|".join(MISSING_PREFIXES) + ").*)"
    return F.coalesce(F.regexp_replace(simplified(c), said_nothing, ""), F.lit(""))  # the simplified value is worked out once


def clean_missing_text(c: Column) -> Column:
    """The stripped value; '' where scoring counts it as missing."""
    s = strip(c)
    return F.when(c.isNull() | simplified(s).isin(MISSING_PHRASES), "").otherwise(s)


def is_missing(c: Column) -> Column:
    return clean_missing_text(c) == ""


def comparable(decomposed: Column) -> Column:
    """Scoring's normal form of a cleaned and NFKD-decomposed value."""
    dashes = F.replace(F.when(is_ascii(decomposed), decomposed).otherwise(F.translate(decomposed, "–—", "--")), F.lit("&"), F.lit(" and "))
    lowered = F.lower(dashes)
    plain = F.when(F.contains(lowered, F.lit("http")), F.regexp_replace(lowered, "https?://", "")).otherwise(lowered)
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9@.$%:/+-]+", " "))


def tokens(normal: Column) -> Column:
    """Tokens of a value in its normal form."""
    return F.regexp_extract_all(normal, F.lit(r"[a-z0-9@.$%+-]+"), F.lit(0))


def token_f1(e: Column, p: Column) -> Column:
    """F1 of two token arrays taken as sets; two empty ones agree."""
    a, b = F.array_distinct(e), F.array_distinct(p)
    common = F.size(F.array_intersect(a, b))
    precision, recall = F.try_divide(common, F.size(b)), F.try_divide(common, F.size(a))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0) | (common == 0), 0.0)
        .otherwise(F.try_divide(2 * precision * recall, precision + recall))
    )


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0)))


def contains_all(expected: Column, found: Column) -> Column:
    """expected is a non-empty subset of found (arrays)."""
    return (F.size(expected) > 0) & (F.size(F.array_except(expected, found)) == 0)


def numbers(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """Distinct words of four or more characters, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9@.$%+-]{4,}"), F.lit(0)))


def first_place(words: Column, lowered: Column) -> Column:
    """Smallest 0-based place of any of the words in a text, null if none is there; the text is made lower once, not for each word."""
    return once(lowered, lambda text: F.array_min(F.filter(F.transform(words, lambda w: F.call_function("locate", w, text)), lambda p: p > 0)) - 1)


def source_excerpt(source: Column, field: Column, value: Column, size: int = 900, fallback: bool = True) -> Column:
    """`size` characters of a source around the first of the value's keywords, else the field's (if `fallback`), else its middle."""
    text = F.coalesce(source, F.lit(""))
    n, lowered = F.length(text), F.lower(text)
    middle = F.floor(n / 2)
    of_field = first_place(F.slice(keyword_tokens(field), 1, 5), lowered) if fallback else F.lit(None)
    centre = F.coalesce(first_place(F.slice(keyword_tokens(value), 1, 10), lowered), of_field, middle)
    end = F.least(n, F.greatest(F.lit(0), centre - size // 2) + size)
    start = F.greatest(F.lit(0), end - size)
    return quick_strip(F.when(n <= size, text).otherwise(F.substring(text, (start + 1).cast("int"), F.lit(size))))


def contains_any(c: Column, terms: Iterable[str], is_lower: bool = False) -> Column:
    """Whether any of the terms is there; is_lower: c is lower case already."""
    lowered, found = c if is_lower else F.lower(c), F.lit(False)
    for t in terms:
        found = found | F.contains(lowered, F.lit(t))
    return found


def count_matches(c: Column, terms: Iterable[str], is_lower: bool = False) -> Column:
    """How many of the terms are there; terms within others count too; is_lower: c is lower case already."""
    lowered, n = c if is_lower else F.lower(c), F.lit(0)
    for t in terms:
        n = n + F.contains(lowered, F.lit(t)).cast("int")
    return n


def heading_only(c: Column) -> Column:
    """A value of up to 90 characters that names a section and nothing else, or an empty one."""
    v = normalize_text(c)
    return (v == "") | ((F.length(v) <= 90) & contains_any(v, HEADINGS) & ~v.rlike(unicode_pattern(HEADING_DETAIL)))


def reference_count(c: Column) -> Column:
    """The first whole number of a value, else the first of one ... ten that is there, in that order."""
    v = normalize_text(c)
    word = F.lit(None).cast("string")
    for i, w in reversed(list(enumerate(NUMBER_WORDS, 1))):
        word = F.when(v.rlike(unicode_pattern(rf"\b{w}\b")), str(i)).otherwise(word)
    return F.coalesce(F.nullif(F.regexp_extract(v, unicode_pattern(r"\b(\d+)\b"), 1), F.lit("")), word)


def natural_number(c: Column) -> Column:
    """All digits of a name as one number, 999999 without any: a key for natural order."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(999999).cast("bigint"))


def python_round(x: Column, digits: int = 0) -> Column:
    """x to so many digits as Python's round() gives it: by the binary value itself, halves to even. For up to six digits and |x| up to 10**9.

    With n = floor(x * 10**digits), the sign of 2 * x * 10**digits - (2 * n + 1) decides; the product is worked out exactly, in two parts.
    """
    scale = 10**digits

    def rounded(v: Column) -> Column:
        n = F.floor(v * float(scale)).cast("double")
        high = v * 4097.0 - (v * 4097.0 - v)  # the upper 41 bits of v
        apart = (high * (2.0 * scale) - (2 * n + 1)) + (v - high) * (2.0 * scale)
        up = F.when(apart > 0, 1.0).when(apart < 0, 0.0).otherwise(F.pmod(n, F.lit(2.0)))
        return (n + up) / float(scale)

    return once(x.cast("double"), lambda v: F.when(v.isNotNull(), rounded(v)))
