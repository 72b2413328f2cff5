"""Pseudonyms in plain Python: the same formats, permutations and digests, one finding at a time."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re

EDGE, END = r"(?<![\w.+-])", r"(?![\w-]|\.\w)"
LAYOUT = rf"(?:\d{{4}}(?:[ -]\d{{4}}){{3,11}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{13,19}}){END}"
FINDERS = [
    ("email", r"(?<![\w.+%-])[\w+%-](?:[\w.+%-]|(?<=\w)'(?=\w)){0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"),
    ("key", r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)"),
    ("secret", r'(?i:(?<![\w])(?:api[_-]?key|secret|token|password|passwd|pwd)\s{0,3}[=:]\s{0,3}"?[\w+/.~-]{8,200}"?)'),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\w)"),
    ("ip", EDGE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + END),
    ("phone", r"(?<![\w.+-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + END),
    ("abroad", r"(?<![\w.+-])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}" + END),
    ("ssn", EDGE + r"\d{3}-\d{2}-\d{4}" + END),
    ("date", EDGE + r"\d{4}-\d{2}-\d{2}" + END),
    ("day", EDGE + r"\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)\d{4}" + END),
    ("iban", EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + END),
    ("card", EDGE + rf"(?:{LAYOUT}|\d(?:[ -]?(?!{LAYOUT})\d){{12,18}}{END})"),
]


def digest(key, *parts):
    return hashlib.sha256("|".join(map(str, (key, *parts))).encode()).hexdigest()


def feistel(key, kind, a, b, sizes):
    for i in range(10):
        by = int(digest(key, kind, *sizes, i, b if i % 2 == 0 else a)[:15], 16)
        if i % 2 == 0:
            a = (a + by) % sizes[0]
        else:
            b = (b + by) % sizes[1]
    return a, b


def digits_of(key, kind, d):
    n = len(d) // 2
    a, b = feistel(key, kind, int(d[:n] or 0), int(d[n:]), (10**n, 10 ** (len(d) - n)))
    return (f"{a:0{n}d}" if n else "") + f"{b:0{len(d) - n}d}"


def filled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def card(key, m):
    good = lambda d: 13 <= len(d) <= 19 and luhn(d) and int(d) > 0

    def new(d):
        body = d[0] + digits_of(key, "card", d[1:-1])
        return next(body + c for c in "0123456789" if luhn(body + c))

    whole = re.sub("[ -]", "", m)
    if good(whole):
        return filled(m, new(whole))
    if not re.fullmatch(r"\d{4}(?:[ -]\d{4}){4,}", m):
        return m
    at, out = 0, m
    while at + 19 <= len(m):
        d = re.sub("[ -]", "", m[at : at + 19])
        out = out[:at] + filled(m[at : at + 19], new(d)) + out[at + 19 :] if good(d) else out
        at += 20 if good(d) else 5
    return out


def other_day(key, y, m, d):
    try:
        n = (datetime.date(int(y), int(m), int(d)) - datetime.date(1800, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < 381 * 383:
        return None
    a, b = feistel(key, "date", n // 383, n % 383, (381, 383))
    return datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 383 + b)


def day(key, m):
    p, sep = re.split("[/.]", m), "/" if "/" in m else "."
    for month, at in ((p[0], p[1]), (p[1], p[0])) if sep == "/" else ((p[1], p[0]),):
        if new := other_day(key, p[2], month, at):
            both = (new.month, new.day) if month is p[0] and at is p[1] else (new.day, new.month)
            return sep.join([*(str(x) if len(o) == 1 else f"{x:02d}" for x, o in zip(both, p, strict=False)), f"{new.year:04d}"])
    return m


def iban(key, m):
    rest = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
    groups = m.split(" ")
    for n in range(len(groups), 0, -1):
        x = "".join(groups[:n])
        if 15 <= len(x) <= 34 and rest(x[4:] + x[:4]) == 1:
            digits = re.sub("[A-Z]", "", x[4:])
            account = filled(x[4:], digits_of(key, "iban", digits)) if len(digits) > 1 else x[4:]
            return filled_letters(m, x[:2] + f"{98 - rest(account + x[:2] + '00'):02d}" + account)
    return m


def filled_letters(shape, text):
    it = iter(text)
    return "".join(c if c == " " else next(it, c) for c in shape)


def ip6(key, m):
    n = sum(bool(g) for g in m.replace("::", ":").split(":"))
    if n < 3 or not re.search(r"\d", m) or n > (7 if "::" in m else 8):
        return m
    g = [int(x, 16) for x in ipaddress.IPv6Address(m).exploded.split(":")]
    halves = [feistel(key, f"ip6-{i}", g[i] * 65536 + g[i + 1], g[i + 2] * 65536 + g[i + 3], (1 << 32, 1 << 32)) for i in (0, 4)]
    return ":".join(f"{x // 65536:x}:{x % 65536:x}" for h in halves for x in h)


def phone(key, m):
    d = re.sub("[^0-9]", "", m)
    if not re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}", d):
        return m
    a, b = feistel(key, "phone", int(d[-10:-7]) - 200, int(d[-7:]) - 2_000_000, (800, 8_000_000))
    return filled(m, ("1" if len(d) == 11 else "") + str(a + 200) + str(b + 2_000_000))


def abroad(key, m):
    d = re.sub("[^0-9]", "", m)
    return filled(m, d[:2] + digits_of(key, "abroad", d[2:])) if 8 <= len(d) <= 15 else m


def ip(key, m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    return ".".join(str(y) for x in feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536)) for y in divmod(x, 256))


def ssn(key, m):
    if not re.fullmatch("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", m):
        return m
    area, group, serial = map(int, m.split("-"))
    a, b = feistel(key, "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999))
    return f"{a + (2 if a > 664 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def secret(key, m):
    head = re.match(r'(?s)[^=:]*[=:]\s*"?', m)[0]
    tail = '"' if m.endswith('"') else ""
    value = m[len(head) : len(m) - len(tail)]
    return head + (digest(key, "secret", value) * 4)[: len(value)] + tail


MAKERS = {
    "email": lambda k, m: f"u{digest(k, 'email', m.lower())[:16]}@d{digest(k, 'domain', m.lower().rsplit('@', 1)[1])[:8]}.example", "key": lambda k, m: "AKIA" + digest(k, "key", m)[:16].upper(),
    "date": lambda k, m: d.isoformat() if (d := other_day(k, *m.split("-"))) else m, "secret": secret, "ip6": ip6, "ip": ip, "phone": phone, "abroad": abroad, "ssn": ssn, "day": day, "iban": iban, "card": card,
}


def pseudonymise(text, key):
    """(text, number of replacements)."""
    n = 0

    def new(m):
        nonlocal n
        kind = next(k for k, p in FINDERS if re.fullmatch(p, m[0], re.A))
        out = MAKERS[kind](key, m[0])
        n += out != m[0]
        return out

    return re.sub("|".join(p for _, p in FINDERS), new, text, flags=re.A), n
