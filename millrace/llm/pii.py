"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Numbers and dates that prove valid - payment cards by their Luhn digit, telephone numbers, IPv4 and IPv6 addresses, social
security numbers, IBANs by their check digits, calendar dates - are mapped by a keyed Feistel permutation of all values of their
format, so a pseudonym is valid too, equal values have equal pseudonyms in every document, and different values different
ones. E-mail addresses and secrets have no format of fixed size: they become keyed digests of the same shape, equal for
equal values. Nothing is shuffled: a text is split at its findings and joined again.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_table

_EDGE, _END = r"(?<![\w.+-])", r"(?![\w-]|\.\w)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Four digits four times or more, 4-6-5 and 4-6-4 digits, or in one piece: how cards are written as a rule.
_LAYOUT = r"(?:\d{4}(?:[ -]\d{4}){3,11}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})" + _END
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w+%-](?:[\w.+%-]|(?<=\w)'(?=\w)){0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "secret": r'(?i:(?<![\w])(?:api[_-]?key|secret|token|password|passwd|pwd)\s{0,3}[=:]\s{0,3}"?[\w+/.~-]{8,200}"?)',
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\w)",
    "ip": _EDGE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + _END,
    "phone": r"(?<![\w.+-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END,
    "abroad": r"(?<![\w.+-])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "date": _EDGE + r"\d{4}-\d{2}-\d{2}" + _END,
    "day": _EDGE + r"\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)\d{4}" + _END,
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END,
    "card": _EDGE + rf"(?:{_LAYOUT}|\d(?:[ -]?(?!{_LAYOUT})\d){{12,18}}{_END})",
}
PATTERN = "|".join(PATTERNS.values())
ROUNDS = 10
#: Dates from this one on, as many days as the two factors' product, are permuted among themselves.
FIRST_DAY, DAYS = "1800-01-01", (381, 383)


def _digest(key: Column, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", key, *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def feistel(key: Column, kind: str, a: Column, b: Column, a_size: Column | int, b_size: Column | int) -> Column:
    """Struct (a, b) of a keyed permutation of 0 <= a < a_size, 0 <= b < b_size (both up to 10**15), by alternating rounds."""
    sizes = [x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a_size, b_size)]

    def mixed(i: Column, other: Column) -> Column:
        return F.conv(F.substring(_digest(key, kind, sizes[0], sizes[1], i, other), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = F.pmod(F.when(even, s["a"]).otherwise(s["b"]) + F.pmod(mixed(i, F.when(even, s["b"]).otherwise(s["a"])), F.when(even, sizes[0]).otherwise(sizes[1])), F.when(even, sizes[0]).otherwise(sizes[1]))
        return F.struct(F.when(even, moved).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _bound(value: Column, make) -> Column:
    """make(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _permuted_digits(key: Column, kind: str, digits: Column) -> Column:
    """A permutation of the strings of as many digits, up to 30."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(key, kind, F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n - left).cast("long"), ten(left), ten(n - left))
    return _bound(out, lambda s: F.concat(_padded(s["a"], left), _padded(s["b"], n - left)))


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _valid_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d) & ~d.rlike("^0+$")


def _new_card(key: Column, d: Column) -> Column:
    """The digits of another card that begins alike."""
    body = F.concat(F.substring(d, 1, 1), _permuted_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
    return _bound(body, lambda p: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(p, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1))


def _card(key: Column, m: Column) -> Column:
    """A card as a whole; of more than four groups of four digits, each four in a row that prove valid."""

    def four(groups: Column, gaps: Column, i: Column) -> Column:
        return F.array_join(F.slice(groups, i + 1, 4), "")

    def walked(g: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"))

        def step(s: Column, i: Column) -> Column:
            gap = F.when(i > 0, F.get(g["gaps"], i - 1)).otherwise("")
            d = four(g["groups"], g["gaps"], i)
            shape = lambda x: F.concat(*[y for k in range(4) for y in ([F.get(g["gaps"], i + (k - 1))] if k else []) + [F.substring(x, 4 * k + 1, 4)]])
            found = F.struct(F.concat(s["out"], gap, _bound(_new_card(key, d), shape)).alias("out"), (i + 4).alias("next"))
            other = F.struct(F.concat(s["out"], gap, F.get(g["groups"], i)).alias("out"), (i + 1).alias("next"))
            return F.when(i < s["next"], s).when((F.length(d) == 16) & _valid_card(d), found).otherwise(other)

        return F.aggregate(F.sequence(F.lit(0), F.size(g["groups"]) - 1), start, step)["out"]

    parts = F.struct(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)).alias("gaps"))
    whole = lambda d: F.when(_valid_card(d), _refilled(m, _new_card(key, d))).when(m.rlike(r"^\d{4}(?:[ -]\d{4}){4,}$"), _bound(parts, walked)).otherwise(m)
    return _bound(F.regexp_replace(m, "[ -]", ""), whole)


def _phone(key: Column, m: Column) -> Column:
    def renamed(d: Column) -> Column:
        out = feistel(key, "phone", F.substring(d, -10, 3).cast("long") - 200, F.substring(d, -7, 7).cast("long") - 2_000_000, 800, 8_000_000)
        new = _bound(out, lambda s: F.concat((s["a"] + 200).cast("string"), (s["b"] + 2_000_000).cast("string")))
        return F.when(d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), _refilled(m, F.concat(F.when(F.length(d) == 11, "1").otherwise(""), new))).otherwise(m)

    return _bound(F.regexp_replace(m, "[^0-9]", ""), renamed)


def _abroad(key: Column, m: Column) -> Column:
    """A number with another country's code, of 8 to 15 digits: all but the first two are permuted."""
    renamed = lambda d: F.when(F.length(d).between(8, 15), _refilled(m, F.concat(F.substring(d, 1, 2), _permuted_digits(key, "abroad", F.substring(d, F.lit(3), F.length(d) - 2))))).otherwise(m)
    return _bound(F.regexp_replace(m, "[^0-9]", ""), renamed)


def _ip6(key: Column, m: Column) -> Column:
    """Eight groups, or at least three around a double colon; both halves are permuted, and the result has all groups."""
    side = lambda i: F.filter(F.split(F.get(F.split(m, "::"), F.lit(i)), ":"), lambda x: x != "")
    left, right = side(0), F.when(m.contains("::"), side(1)).otherwise(F.array().cast("array<string>"))
    groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    number = lambda g, i: F.conv(F.get(g, F.lit(i)), 16, 10).cast("long") * 65536 + F.conv(F.get(g, F.lit(i + 1)), 16, 10).cast("long")

    def renamed(g: Column) -> Column:
        halves = [feistel(key, f"ip6-{i}", number(g, i), number(g, i + 2), 1 << 32, 1 << 32) for i in (0, 4)]
        hexed = lambda n: F.concat_ws(":", F.lower(F.hex(F.floor(n / 65536))), F.lower(F.hex(n % 65536)))
        return F.concat_ws(":", *[_bound(h, lambda s: F.concat_ws(":", hexed(s["a"]), hexed(s["b"]))) for h in halves])

    enough = (F.size(left) + F.size(right)).between(3, 8) & (m.contains("::") | (F.size(left) == 8)) & m.rlike("[0-9]")
    return F.when(enough & (F.size(left) + F.size(right) <= F.when(m.contains("::"), 7).otherwise(8)), _bound(groups, renamed)).otherwise(m)


def _ip(key: Column, m: Column) -> Column:
    def renamed(o: Column) -> Column:
        out = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16)
        new = _bound(out, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
        return F.when(F.array_max(o) < 256, new).otherwise(m)

    return _bound(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), renamed)


def _ssn(key: Column, m: Column) -> Column:
    part = lambda i, n: F.substring(m, i, n).cast("long")
    area = F.when(part(1, 3) > 666, part(1, 3) - 2).otherwise(part(1, 3) - 1)
    out = feistel(key, "ssn", area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, 898, 99 * 9999)
    new = _bound(out, lambda s: F.concat_ws("-", _padded(F.when(s["a"] > 664, s["a"] + 2).otherwise(s["a"] + 1), 3), _padded(F.floor(s["b"] / 9999) + 1, 2), _padded(s["b"] % 9999 + 1, 4)))
    return F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), new).otherwise(m)


def _other_day(key: Column, day: Column, write) -> Column:
    """write(another date) for a date of the permuted ones, else null."""

    def renamed(n: Column) -> Column:
        out = feistel(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], *DAYS)
        new = _bound(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")))
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _bound(new, write))

    return _bound(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), renamed)


def _date(key: Column, m: Column) -> Column:
    return F.coalesce(_other_day(key, m.try_cast("date"), lambda d: F.date_format(d, "yyyy-MM-dd")), m)


def _day(key: Column, m: Column) -> Column:
    """Month, day and year between slashes, or day first where that is no date; day, month and year between dots. Single digits stay single where they can."""
    p = F.split(m, "[/.]")
    date = lambda month, day: F.concat_ws("-", p[2], _padded(month, 2), _padded(day, 2)).try_cast("date")

    def written(first: str, second: str):
        number = lambda d, part, i: F.when(F.length(p[i]) == 1, F.date_format(d, part[0])).otherwise(F.date_format(d, part))
        return lambda d: F.concat(number(d, first, 0), F.substring(m, F.length(p[0]) + 1, F.lit(1)), number(d, second, 1), F.substring(m, F.length(p[0]) + 1, F.lit(1)), F.date_format(d, "yyyy"))

    american = F.when(m.contains("/"), _other_day(key, date(p[0], p[1]), written("MM", "dd")))
    return F.coalesce(american, _other_day(key, date(p[1], p[0]), written("dd", "MM")), m)


def _rest(text: Column) -> Column:
    """A number with letters as 10 to 35 modulo 97."""
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: Column, m: Column) -> Column:
    """An account's digits are permuted, its letters stay, the check digits are worked out anew. Of groups, the most that prove valid."""

    def renamed(x: Column) -> Column:
        account = F.substring(x, F.lit(5), F.length(x) - 4)
        digits = F.regexp_replace(account, "[A-Z]", "")
        new = F.when(F.length(digits) > 1, _refilled(account, _permuted_digits(key, "iban", digits))).otherwise(account)
        check = lambda a: F.concat(F.substring(x, 1, 2), _padded(98 - _rest(F.concat(a, F.substring(x, 1, 2), F.lit("00"))), 2), a)
        return _bound(new, check)

    valid = lambda x: F.length(x).between(15, 34) & (_rest(F.concat(F.substring(x, F.lit(5), F.length(x) - 4), F.substring(x, 1, 4))) == 1)
    groups = F.split(m, " ")
    prefixes = F.when(F.size(groups) > 1, F.transform(F.sequence(F.size(groups), F.lit(1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), ""))).otherwise(F.array(m))
    shaped = lambda x: F.concat(F.when(F.size(groups) > 1, F.trim(F.regexp_replace(renamed(x), "(.{4})", "$1 "))).otherwise(renamed(x)), F.substring(m, F.length(x) + F.when(F.size(groups) > 1, F.floor((F.length(x) - 1) / 4)).otherwise(0).cast("int") + 1, F.length(m)))
    return F.coalesce(_bound(F.get(F.filter(prefixes, valid), F.lit(0)), lambda x: F.when(x.isNotNull(), shaped(x))), m)


def _email(key: Column, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(key, "email", F.lower(m)), 1, 16), F.lit("@d"), F.substring(_digest(key, "domain", F.lower(F.substring_index(m, "@", -1))), 1, 8), F.lit(".example"))


def _secret(key: Column, m: Column) -> Column:
    """The name and sign stay; the value becomes as many hexadecimal digits."""
    head = F.regexp_extract(m, r'^(?s)([^=:]*[=:]\s*"?)', 1)
    tail = F.when(m.endswith('"'), '"').otherwise("")
    n = F.length(m) - F.length(head) - F.length(tail)
    return F.concat(head, F.substring(F.repeat(_digest(key, "secret", F.substring(m, F.length(head) + 1, n)), 4), F.lit(1), n), tail)


def _pseudonym(key: Column, m: Column) -> Column:
    full = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    makers = {
        "email": _email, "key": lambda k, x: F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(k, "key", x), 1, 16))), "secret": _secret,
        "ip6": _ip6, "ip": _ip, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "date": _date, "day": _day, "iban": _iban, "card": _card,
    }
    return reduce(lambda other, kind: F.when(full(kind), makers[kind](key, m)).otherwise(other), reversed(list(PATTERNS)), m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with findings in `text` replaced; `count` names a column for the number of replacements.

    Findings that don't prove valid stay, and so do cards of 19 digits in groups. Null and empty texts stay as they are, with count 0; all other columns and all
    rows stay, repeated ones too; an empty table gives an empty result. Keep the key secret: it undoes linkage only by being lost.
    It comes to the rows from a table of its own, so plans and event logs don't show it.
    """
    if count is not None and count in docs.columns:
        raise ValueError(f"{count} is a column already")
    free = lambda name: next(n for n in (name, *(f"{name}{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    value, held, secret = F.col(f"`{text}`"), free("__pairs"), free("__secret")
    given = docs.withColumn(secret, small_table(docs.sparkSession, [(key,)], pa.schema({"k": pa.string()})).scalar())
    pairs = F.transform(F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("old"), _pseudonym(F.col(secret), m).alias("new")))
    out = given.withColumn(held, F.when(value.rlike("[0-9@=:]") & value.rlike(PATTERN), pairs))
    joined = F.array_join(F.zip_with(F.split(value, PATTERN, -1), F.concat(F.col(held)["new"], F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")
    changed = F.size(F.filter(held, lambda x: x["old"] != x["new"]))
    columns = [F.when(F.col(held).isNull(), value).otherwise(joined).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.when(F.col(held).isNull(), 0).otherwise(changed).alias(count)] if count else []))
