"""Format-preserving pseudonyms for personal data.

Found values are validated (check digits, ranges, calendar), mapped to a number below the size of their format,
permuted there by a keyed Feistel network without fixed points, and written back in the same format: separators,
length, letter case, country and mail domain stay, check digits are right again. The permutation depends on the key
and the kind alone, so equal values stay linked across documents, however they are punctuated, and different values
stay different. Telephone numbers keep the country code, which the numbering plan cuts off; a number without it links with the
same national digits. Dates keep to their half of the month (up to the 12th or after it). Each task rewrites its documents by itself; nothing is shuffled.

Kinds: mail addresses (local part), payment cards (Luhn), IBANs (mod 97), telephone numbers, IPv4 addresses, US
social security numbers and dates (1900 to 2099, as y-m-d, also before a time, d/m/y or m/d/y, d.m.y). Values that fail
validation stay.

Defined results: a null text stays null without findings; an empty text is empty; text without values is unchanged.
"""
from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratally.llm.common import ship_package, unused
from terratally.llm.feistel import displaced, round_keys

KEY = b"pseudonyms-1"
KINDS = ("email", "iban", "date", "ssn", "ip", "card", "phone")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73049
ANY = re.compile(r"[0-9@]")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z"), re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}")
NUMBERS = re.compile(r"""
    (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?!\w))
  | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt][0-9])
      |(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9])))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
  | (?P<card>(?<![\w+.-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[\x20-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![\w-]|\.[0-9]))
  | (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[\x20.-]?\([0-9]{1,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}
      |\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9]))
""", re.X)
#: Registered lengths of IBANs by country.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
IBAN_LEAST = 15
#: Country codes of two digits in the public numbering plan; 1 and 7 stand alone, all others have three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


@lru_cache(256)
def keys_of(key: bytes, tweak: str) -> list[int]:
    return [int(k) for k in round_keys(key, tweak.encode())]


def permuted(key: bytes, kind: str, value: int, n: int) -> int:
    return displaced(value, n, keys_of(key, kind)) if n > 1 else value


def luhn(digits: str) -> int:
    """Sum whose last digit is 0 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    d = iter(digits)
    return "".join(next(d) if c.isdigit() else c for c in shape)


def radices(text: str) -> list[tuple[int, str]]:
    return [(10, "0") if c.isdigit() else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in text]


def letters(key: bytes, kind: str, text: str) -> str:
    """Digits, small and capital letters permuted among their like, in segments below 2**62."""
    out, at, places = [], 0, radices(text)
    while at < len(places):
        n, to, value = 1, at, 0
        while to < len(places) and n * places[to][0] < 1 << 62:
            r, zero = places[to]
            n, value, to = n * r, value * r + (ord(text[to]) - ord(zero) if r > 1 else 0), to + 1
        value = permuted(key, f"{kind} {at} {n}", value, n)
        part = []
        for r, zero in reversed(places[at:to]):
            value, d = divmod(value, r)
            part.append(chr(ord(zero) + d) if r > 1 else zero)
        out += reversed(part)
        at = to
    return "".join(out)


def email(key, local):
    return letters(key, "email", local)


def card(key, text):
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10 or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = str(permuted(key, f"card {n}", int(digits[:-1]), 10**n)).zfill(n)
    return refill(text, body + str(-luhn(body + "0") % 10))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def iban(key, text):
    plain = text.replace(" ", "")
    if iban_number(plain) % 97 != 1:
        return None
    body = letters(key, "iban " + plain[:2], plain[4:])
    new = iter(plain[:2] + f"{98 - iban_number(plain[:2] + '00' + body) % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def country_digits(digits: str) -> int:
    """Digits of the country code that an international number starts with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3


def phone(key, text):
    digits = re.sub(r"\D", "", text)
    at = country_digits(digits) if text[0] == "+" else 0
    n = len(digits) - at
    if not 6 <= n <= 14:
        return None
    new = permuted(key, f"phone {n}", int(digits[at:]), 10**n)
    return refill(text, digits[:at] + str(new).zfill(n))


def ip(key, text):
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permuted(key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def ssn(key, text):
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = permuted(key, "ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


@lru_cache(2)
def days_of(late: bool) -> list[int]:
    """Days since the first one that fall after the 12th of their month, or up to it."""
    return [k for k in range(DAYS) if ((FIRST_DAY + datetime.timedelta(k)).day > 12) == late]


def date(key, text):
    sep = next(c for c in text if not c.isdigit())
    parts = [int(x) for x in text.split(sep)]
    if sep == "-":
        orders = [(0, 1, 2)]
    elif sep == ".":
        orders = [(2, 1, 0)]
    else:
        orders = [(2, 1, 0), (2, 0, 1)]  # day first if that is a date, else month first
    for o in orders:
        try:
            day = datetime.date(*(parts[i] for i in o))
        except ValueError:
            continue
        value = (day - FIRST_DAY).days
        if not 0 <= value < DAYS:
            return None
        # days after the 12th stay among themselves in every format, so that a month-first date is read the same way again
        among = days_of(day.day > 12)
        new = FIRST_DAY + datetime.timedelta(among[permuted(key, f"date {len(among)}", bisect_left(among, value), len(among))])
        fields = {o[0]: f"{new.year:04d}", o[1]: f"{new.month:02d}", o[2]: f"{new.day:02d}"}
        return sep.join(fields[i] for i in range(3))
    return None


RULES = {"card": card, "iban": iban, "phone": phone, "ip": ip, "ssn": ssn, "date": date}


def addresses(text: str) -> list[tuple[int, int, int]]:
    """Start of the local part, the @ and the end of each mail address."""
    found, at = [], text.find("@")
    while at >= 0:
        left, right = LOCAL.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1)
        if left and right:
            start = at - len(left[0].lstrip(".-+%"))
            if start < at and (not found or start >= found[-1][2]):
                found.append((start, at, right.end()))
        at = text.find("@", at + 1)
    return found


def ends_of(kind: str, text: str, start: int, end: int) -> list[int]:
    """Ends to try for a value. An IBAN can run on into the words after it: the end of its country's length goes first, then the longest."""
    if kind != "iban":
        return [end]
    ends, n = [], 0
    for at in range(start, end):
        if text[at] != " ":
            n += 1
        elif n >= IBAN_LEAST:
            ends.append((n != IBAN_LENGTHS.get(text[start:start + 2]), -n, at))
    return [e[-1] for e in sorted([*ends, (n != IBAN_LENGTHS.get(text[start:start + 2]), -n, end)])]


def pseudonymised(text: str, key: bytes = KEY) -> tuple[str, Counter]:
    """The text rewritten, and the number of values by kind. Addresses go first; then numbers, from left to right."""
    found: Counter = Counter()
    if not ANY.search(text):
        return text, found
    mails = addresses(text)
    new = [(start, at, email(key, text[start:at]), "email") for start, at, _ in mails]
    at, k = 0, 0
    while m := NUMBERS.search(text, at):
        while k < len(mails) and mails[k][2] <= m.start():
            k += 1
        kind, at = kind_of(m), m.start() + 1  # a shorter value may start inside
        for end in ends_of(kind, text, m.start(), m.end()):
            value = None if k < len(mails) and mails[k][0] < end else RULES[kind](key, text[m.start():end])
            if value is not None:
                new.append((m.start(), end, value, kind))
                at = end
                break
    out, done = [], 0
    for start, end, value, kind in sorted(new):
        out += [text[done:start], value]
        done = end
        found[kind] += 1
    return "".join(out) + text[done:], found


def kind_of(m: re.Match) -> str:
    return next(k for k in RULES if m[k] is not None)


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and n_<kind> for each kind."""
    ship_package(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    base = docs.drop(*counts)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in counts)]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [pseudonymised(t, key) if t is not None else (None, Counter()) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], **{f"n_{k}": [r[1][k] for r in rows] for k in KINDS}})

    new = unused("new", base)
    done = base.withColumn(new, run("text"))
    return done.select(*(F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns), *(f"{new}.{c}" for c in counts))
