"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern, validated (check digits, calendar, number ranges) and replaced by another valid value of
the same format: the value is mapped to an integer below the number of values of its format, permuted by a keyed
Feistel network with cycle-walking, and written back with the same separators.  The permutation depends on the key
and the format alone, so equal values get equal pseudonyms in every document (and in every run with the same key),
different values stay different, and the holder of the key can undo it.

Kinds: e-mail addresses (the local part; the domain stays), phone numbers (country code and separators stay), payment
cards (first digit and a valid check digit stay), IBANs (country stays, check digits recomputed), US social security
numbers, IPv4 addresses, calendar dates from 1900 to 2099, and secrets: access keys, and the values of password=,
token= and the like, of any length, up to the closing quote or the next blank (8 characters or more, with a digit; their
ASCII letters and digits change, punctuation stays).
Text that does not validate is left alone, so documents without such values come back unchanged.

A row is one task's work, nothing moves between rows; patterns have bounded repeats or one class, so long texts take linear time.
Defined results: null text stays null, empty text stays empty; repeated rows get equal results; other columns, also
with clashing names, are kept by ``pseudonymise``.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
DEFAULT_KEY = "websift-pseudonyms"
ROUNDS = 10
RESULT = "text string, " + ", ".join(f"n_{k} int" for k in KINDS)

_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked along
    its cycle until the result is in range (fewer than four steps on average)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(r: int, x: int) -> int:
        data = f"{tweak}|{size}|{r}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=max(1, min(64, half // 8 + 1))).digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)):
            a, b = (b ^ f(r, a), a) if inverse else (b, a ^ f(r, b))
        value = (a << half) | b
        if value < size:
            return value


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{16,}")
_LOW_HEX = re.compile(r"[0-9a-f]+")


#: Places of one permutation; a longer value is permuted block by block (one number for all would take quadratic time).
_BLOCK = 128


def _permute_places(s: str, alphabets: tuple, key: bytes, tweak: str, inverse: bool, same: Callable) -> str:
    """Characters of ``s`` that are in an alphabet, permuted together, each within its alphabet; all else stays.  The
    cycle is walked until ``same`` tells the new string like the old one."""
    places = [(i, a) for i, c in enumerate(s) for a in alphabets if c in a]
    value, size = 0, 1
    for i, a in places:
        value, size = value * len(a) + a.index(s[i]), size * len(a)
    shape = ".".join(str(len(a)) for _, a in places)  # the format is part of the tweak
    kind = same(s)
    while True:
        value, out = permute(value, size, key, f"{tweak}|{shape}", inverse), list(s)
        rest = value
        for i, a in reversed(places):
            rest, k = divmod(rest, len(a))
            out[i] = a[k]
        new = "".join(out)
        if same(new) == kind:
            return new


def _permute_letters(s: str, key: bytes, tweak: str, inverse: bool) -> str:
    """Letters and digits of ``s`` permuted together, each within its class (or within hex digits); all else stays."""
    places = [i for i, c in enumerate(s) if c.isascii() and c.isalnum()]
    if len(places) <= _BLOCK:
        alphabets = ("0123456789abcdef",) if _HEX.fullmatch(s) else _ALPHABETS
        return _permute_places(s, alphabets, key, tweak, inverse, lambda x: bool(_HEX.fullmatch(x)))
    out, before = list(s), b""
    for at in range(0, len(places), _BLOCK):  # the tweak of a block has the digest of the plain blocks before it
        part = places[at:at + _BLOCK]
        block = "".join(s[i] for i in part)
        alphabets = ("0123456789", "abcdef") if _LOW_HEX.fullmatch(block) else _ALPHABETS
        new = _permute_places(block, alphabets, key, f"{tweak}|{at}|{before.hex()}", inverse, lambda x: bool(_LOW_HEX.fullmatch(x)))
        for i, c in zip(part, new):
            out[i] = c
        before = hashlib.blake2b(before + (new if inverse else block).encode(), digest_size=16).digest()
    return "".join(out)


def _put_digits(s: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``s``."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in s)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(s: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 2
    d = d[0] + str(permute(int(d[1:-1]), 10 ** n, key, f"card|{d[0]}", inverse)).zfill(n)
    return _put_digits(s, d + luhn_digit(d))


def iban_check(country: str, account: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97).zfill(2)


#: Length of the IBANs of each country; other countries' are taken as long as they go.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
                25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
                29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban(s: str, key: bytes, inverse: bool) -> str | None:
    plain = s.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, account) != check:
        return None
    account = _permute_letters(account, key, f"iban|{country}", inverse)
    it = iter(country + iban_check(country, account) + account)
    return "".join(c if c == " " else next(it) for c in s)


def _ssn(s: str, key: bytes, inverse: bool) -> str | None:
    a, g, n = (int(x) for x in s.split("-"))
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    areas = a - 1 - (a > 666)
    v = permute((areas * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, key, "ssn", inverse)
    v, n = divmod(v, 9999)
    a, g = divmod(v, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{n + 1:04d}"


def _ip(s: str, key: bytes, inverse: bool) -> str | None:
    p = [int(x) for x in s.split(".")]
    if max(p) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    v = permute(int.from_bytes(bytes(p), "big"), 1 << 32, key, "ip", inverse)
    return ".".join(str(x) for x in v.to_bytes(4, "big"))


_FRENCH = re.compile(r"0[1-9][ .-][0-9]{2}[ .-]")


def _is_nanp(d: str) -> bool:
    """North American: area and exchange from 200 on."""
    return len(d) == 10 and d[0] >= "2" and d[3] >= "2"


def _phone(s: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return None
    if _FRENCH.match(s):  # ten digits in pairs: the first is 0, the second is not
        v = permute(int(d[1:]) - 10 ** 8, 9 * 10 ** 8, key, "phone|pairs", inverse)
        return _put_digits(s, f"0{v + 10 ** 8}")
    code = ""
    if s.startswith("+"):
        code = "1" if d[0] == "1" else d[:2]
        d = d[len(code):]
    american = code in ("", "1")
    if american and _is_nanp(d):
        v = permute(((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:]), 800 * 800 * 10_000, key, "phone|nanp", inverse)
        v, line = divmod(v, 10_000)
        area, exchange = divmod(v, 800)
        d = f"{area + 200}{exchange + 200}{line:04d}"
    else:
        while True:  # a walk along the cycle until the number is outside the North American ranges, as the given one is
            d = str(permute(int(d), 10 ** len(d), key, f"phone|{code}|{len(d)}", inverse)).zfill(len(d))
            if not (american and _is_nanp(d)):
                break
    return _put_digits(s, code + d)


@lru_cache(maxsize=1)
def _late_days() -> tuple[list, dict]:
    """The days of 1900 to 2099 from the 13th of a month on, which no day-first reading of month/day/year takes."""
    days = [d for d in (_DAY0 + datetime.timedelta(days=i) for i in range(_DAYS)) if d.day > 12]
    return days, {d: i for i, d in enumerate(days)}


def _month_first(s: str, key: bytes, inverse: bool) -> str | None:
    month, day, year = (int(x) for x in s.split("/"))
    try:
        at = _late_days()[1].get(datetime.date(year, month, day))
    except ValueError:
        return None
    if at is None:
        return None
    new = _late_days()[0][permute(at, len(_late_days()[0]), key, "date|month first", inverse)]
    return f"{new.month:02d}/{new.day:02d}/{new.year:04d}"


def _date(s: str, key: bytes, inverse: bool) -> str | None:
    p = re.split(r"[-/.]", s)
    if s[2] == "/" and int(p[1]) > 12:
        return _month_first(s, key, inverse)
    order = (0, 1, 2) if len(p[0]) == 4 else (2, 1, 0)
    try:
        day = datetime.date(*(int(p[i]) for i in order))
    except ValueError:
        return None
    v = (day - _DAY0).days
    if not 0 <= v < _DAYS:
        return None
    day = _DAY0 + datetime.timedelta(days=permute(v, _DAYS, key, "date", inverse))
    new = {order[0]: f"{day.year:04d}", order[1]: f"{day.month:02d}", order[2]: f"{day.day:02d}"}
    return new[0] + s[len(p[0])] + new[1] + s[len(p[0]) + 1 + len(p[1])] + new[2]


def _email(s: str, key: bytes, inverse: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    return _permute_letters(local, key, "email|" + domain.lower(), inverse) + "@" + domain


def _secret(s: str, key: bytes, inverse: bool) -> str | None:
    keep = 4 if s.startswith(("AKIA", "ASIA")) else 0
    return s[:keep] + _permute_letters(s[keep:], key, "secret", inverse)


_B, _E = r"(?<![\w.+-])", r"(?![\w])"
_IBAN_PATTERN = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) \
    + rf"|(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
#: A digit of a phone number with what may stand before it; numbers of countries with one length end there.
_D = r"(?:(?:[ .-]?\(?|\)[ .-]?)[0-9])"
#: One alternative per kind, in this order: the longer and stricter formats first.
_NUMBERS = re.compile("|".join((
    _B + rf"(?P<iban>{_IBAN_PATTERN})" + _E,
    _B + r"(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})" + r"(?![\w-])",
    _B + r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})" + r"(?!\.?[\w])",
    _B + r"(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})" + r"(?![\w-])",
    r"(?<![\w+])(?P<phone>\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|\+(?:3[34]{_D}{{9}}|44{_D}{{10}})(?![0-9])|\+[2-9]{_D}{{7,14}}(?![0-9])"
    r"|(?<![.-])0[1-9](?P<pair>[ .-])[0-9]{2}(?:(?P=pair)[0-9]{2}){3}(?!\w|[.-][0-9])"
    r"|(?<![.-])[0-9]{3} [0-9]{3} [0-9]{4}(?!\w|[.-][0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w.-]))",
    _B + r"(?P<card>[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + r"(?![\w-])",
)))
_KINDS = tuple(k for k in _NUMBERS.groupindex if k in KINDS)
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
#: A named value is all of what is in its quotes, or else all up to the next blank or quote.
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?P<a>A[KS]IA[A-Z0-9]{16})(?![A-Za-z0-9])"
                     r"|(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
                     r"(?:\"(?P<b>[^\"\r\n]{8,})\"|'(?P<c>[^'\r\n]{8,})'|[\"']?(?P<d>[^\s\"']{8,}))")
_HINT = re.compile(r"[0-9@]")
_SECRET_HINT = re.compile(r"A[KS]IA|[=:]")
_MAKERS: dict[str, Callable] = {"iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card,
                                "email": _email, "secret": _secret}


@lru_cache(maxsize=100_000)
def _pseudonym(kind: str, value: str, key: bytes, inverse: bool) -> str | None:
    return _MAKERS[kind](value, key, inverse)


def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a value, or None if it isn't a valid value of its kind; long values are not kept in memory."""
    if len(value) > 256:
        return _MAKERS[kind](value, key, inverse)
    return _pseudonym(kind, value, key, inverse)


def replace(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with all values replaced, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _HINT.search(text):
        return text, counts

    def numbers(m: re.Match) -> str:
        kind = next(k for k in _KINDS if m.group(k) is not None)
        new = pseudonym(kind, m.group(), key, inverse)
        if new is None:
            return m.group()
        counts[kind] += 1
        return new

    def email(m: re.Match) -> str:
        counts["email"] += 1
        return pseudonym("email", m.group(), key, inverse)

    def secret(m: re.Match) -> str:
        name = m.lastgroup
        s = m.group(name)
        if name != "a" and not re.search("[0-9]", s):
            return m.group()
        counts["secret"] += 1
        at = m.start(name) - m.start()
        return m.group()[:at] + pseudonym("secret", s, key, inverse) + m.group()[at + len(s):]

    # each value is replaced once: text is cut around secrets and addresses, and only what is between is searched again
    out, at = [], 0
    for m in _matches(text):
        out.append(_NUMBERS.sub(numbers, text[at:m.start()]) if m.start() > at else "")
        out.append(email(m) if m.re is _EMAIL else secret(m))
        at = m.end()
    out.append(_NUMBERS.sub(numbers, text[at:]))
    return "".join(out), counts


def _matches(text: str) -> list[re.Match]:
    """Addresses and secrets in order, without overlaps."""
    found = list(_EMAIL.finditer(text)) if "@" in text else []
    if _SECRET_HINT.search(text):
        found += _SECRET.finditer(text)
    found.sort(key=lambda m: (m.start(), -m.end()))
    out, end = [], 0
    for m in found:
        if m.start() >= end:
            out.append(m)
            end = m.end()
    return out


def _column(key: str, inverse: bool):
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, *[0] * len(KINDS)))
            else:
                new, counts = replace(t, secret, inverse)
                rows.append((new, *counts.values()))
        return pd.DataFrame(rows, columns=["text", *[f"n_{k}" for k in KINDS]])
    return run


def pseudonymise(df: DataFrame, text: str = "text", key: str = DEFAULT_KEY, inverse: bool = False) -> DataFrame:
    """``df`` with the values in ``text`` replaced; ``inverse`` puts the originals back."""
    columns = df.columns
    names = [f"_in{i}" for i in range(len(columns))]
    at = columns.index(text)
    return df.toDF(*names).withColumn("_new", _column(key, inverse)(F.col(names[at]))) \
        .select(*[F.col("_new.text" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, columns))])


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, the replaced text and the number of values of each kind."""
    d = df.select(F.col(doc_id).alias("doc_id"), _column(key, False)(F.col(text)).alias("_new"))
    return d.select("doc_id", "_new.text", *[f"_new.n_{k}" for k in KINDS])
