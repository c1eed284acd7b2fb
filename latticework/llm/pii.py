"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Candidates are found, validated, freed of overlaps (the earliest, then the longest
valid one counts), and permuted inside their own format:

=========  =====================================  ==================================
kind       validation                             what the pseudonym keeps
=========  =====================================  ==================================
card       13-19 digits, Luhn                     length, separators, Luhn validity
iban       ISO country, length, mod 97            country, character classes, mod 97
ssn        area, group and serial ranges          ranges and dashes
date       calendar date, year 1900-2099          layout; whether the day is over 12
ipv4       four octets up to 255                  dots; four valid octets
ipv6       eight groups, or fewer and one ``::``  zero groups, digits of each group
phone      7-15 digits after + or NANP layout     country code and punctuation
email      one @, dotted host                     host, punctuation, letter case
secret     32 or more hex digits, or a token      prefix, length and character classes
           that begins as issued keys do
=========  =====================================  ==================================

Each permutation is a bijection of the values of one format, keyed by the caller's
secret, and acts on the value, not on its spelling: a card with or without spaces,
a date as 2020-01-31, 31/01/2020 or 01/31/2020, a phone number with or without
punctuation, an address in either letter case, an IPv6 address with or without its
zeros get the same pseudonym in every document, on every executor. A date with
both numbers up to 12 is read day first. ``restore`` inverts them, save where a
pseudonym completes a longer valid value by chance (a card behind two letters and
two digits that then pass as an IBAN, 1 in 97 of such texts).

A date may stand before a time (2020-01-31T10:00) or another date (a range). A phone
number ends where it has its country's own number of digits, where that is fixed, else
at the last group of digits that leaves 15 or fewer, so a number behind it is not taken
for a part of it; where a country's numbers vary in length, one behind a number
with room for it still is. Not found: IBANs in lower case, values parted by tabs or line
breaks, and spelt-out numbers. Whole texts are scanned; no state
is shared between rows, so the operator is one narrow pass without a shuffle.

Null text stays null with zero counts. Empty and very long texts are scanned
like any other; repeated rows give repeated results; other columns pass through
untouched, also when they are named like the result's (then the result's win).
"""

from __future__ import annotations

import ipaddress
import re
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from latticework.llm.batches import map_columns, numbered, small_batches, without_columns

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "date", "ipv4", "ipv6", "phone", "email", "secret")


class Feistel:
    """A keyed permutation of range(n) for any n, by alternating modular Feistel rounds and cycle walking."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.left = 1
        while self.left * self.left < n:
            self.left *= 2
        self.right = -(-n // self.left)
        self.key, self.tweak = key[:64], tweak.encode()

    def _round(self, number: int, half: int, modulus: int) -> int:
        data = b"%b|%d|%d" % (self.tweak, number, half)
        wide = blake2b(data, key=self.key, digest_size=16 + (modulus.bit_length() + 7) // 8 if modulus < 1 << 380 else 64)
        return int.from_bytes(wide.digest(), "big") % modulus

    def _once(self, value: int, sign: int) -> int:
        a, b = divmod(value, self.right)
        for i in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if i % 2:
                b = (b + sign * self._round(i, a, self.right)) % self.right
            else:
                a = (a + sign * self._round(i, b, self.left)) % self.left
        return a * self.right + b

    def permute(self, value: int, sign: int = 1) -> int:
        if self.n < 2:
            return value
        value = self._once(value, sign)
        while value >= self.n:
            value = self._once(value, sign)
        return value


_CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)])),
    "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])),
)
_CLASS_OF = {c: i for i, chars in enumerate(_CLASSES) for c in chars}
_RANK = {c: i for chars in _CLASSES for i, c in enumerate(chars)}


def _permute_characters(text: str, kind: str, key: bytes, sign: int) -> str:
    """Permute the characters of each known class; all others stay in place. The layout is the tweak."""
    shape = "".join("dlLaA"[_CLASS_OF[c]] if c in _CLASS_OF else c for c in text)
    value, n = 0, 1
    for c in text:
        if c in _CLASS_OF:
            size = len(_CLASSES[_CLASS_OF[c]])
            value, n = value * size + _RANK[c], n * size
    value = Feistel(key, f"{kind}|{shape}", n).permute(value, sign)
    out = []
    for c in reversed(text):
        if c in _CLASS_OF:
            chars = _CLASSES[_CLASS_OF[c]]
            value, at = divmod(value, len(chars))
            c = chars[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced, in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in template)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _valid_card(text: str) -> bool:
    digits = _digits(text)
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text: str, key: bytes, sign: int) -> str:
    digits = _digits(text)
    body = digits[:-1]
    n = 10 ** len(body)
    walk = Feistel(key, f"card|{len(digits)}", n)
    value = walk.permute(int(body), sign)
    while len(set(new := (b := f"{value:0{len(body)}d}") + luhn_digit(b))) == 1:  # keep to the validated set
        value = walk.permute(value, sign)
    return _refill(text, new)


#: Total length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _compact(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def _valid_iban(compact: str) -> bool:
    return len(compact) == IBAN_LENGTHS.get(compact[:2]) and _mod97(compact[4:] + compact[:4]) == 1 and 2 <= int(compact[2:4]) <= 98


def _iban(text: str, key: bytes, sign: int) -> str:
    compact = _compact(text)
    country, body = compact[:2], compact[4:]
    body = _permute_characters(body, f"iban|{country}", key, sign)
    new = iter(f"{country}{98 - _mod97(body + country + '00'):02d}{body}")
    return "".join(c if c in " -" else next(new) for c in text)


def _valid_ssn(text: str) -> bool:
    area, group, serial = map(int, text.split("-"))
    return 1 <= area <= 899 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, key: bytes, sign: int) -> str:
    area, group, serial = map(int, text.split("-"))
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(Feistel(key, "ssn", 898 * 99 * 9999).permute(rank, sign), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _parsed_date(text: str) -> tuple[date, str] | None:
    """The day, and the order of its parts: year, day or month first."""
    numbers = [int(x) for x in re.split("[-/.]", text)]
    orders = {"ymd": numbers} if text[2].isdigit() else {"dmy": numbers[::-1], "mdy": [numbers[2], *numbers[:2]]}
    for order, (year, month, day) in orders.items():
        if 1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]:
            return date(year, month, day), order
    return None


@lru_cache(maxsize=1)
def _days() -> tuple[tuple[list[date], dict[date, int]], ...]:
    """The days of 1900 to 2099 with their ranks, apart by whether the day of the month is over 12.

    A date of the one kind keeps it, so that every order of its parts stays readable.
    """
    every = [date.fromordinal(i) for i in range(date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal())]
    kinds = [[d for d in every if (d.day > 12) is late] for late in (False, True)]
    return tuple((own, {d: i for i, d in enumerate(own)}) for own in kinds)


def _date(text: str, key: bytes, sign: int) -> str:
    day, order = _parsed_date(text)
    late = day.day > 12
    own, rank = _days()[late]
    new = own[Feistel(key, f"date|{late}", len(own)).permute(rank[day], sign)]
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return next(c for c in text if not c.isdigit()).join(parts[p] for p in order)


def _valid_ipv4(text: str) -> bool:
    return all(int(x) <= 255 for x in text.split("."))


def _ipv4(text: str, key: bytes, sign: int) -> str:
    value = Feistel(key, "ipv4", 1 << 32).permute(int.from_bytes(bytes(int(x) for x in text.split(".")), "big"), sign)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _valid_ipv6(text: str) -> bool:
    """An address that spells out three groups or more, two of them not zero."""
    try:
        packed = ipaddress.IPv6Address(text).packed
    except ValueError:
        return False
    return len([g for g in text.split(":") if g]) >= 3 and sum(packed[i : i + 2] != b"\0\0" for i in range(0, 16, 2)) >= 2


def _ipv6(text: str, key: bytes, sign: int) -> str:
    """Zero groups stay; the others are permuted together, each within its number of digits."""
    packed = ipaddress.IPv6Address(text).packed
    groups = [int.from_bytes(packed[i : i + 2], "big") for i in range(0, 16, 2)]
    digits = [len(f"{g:x}") if g else 0 for g in groups]
    value, n = 0, 1
    for g, size in zip(groups, digits, strict=True):
        if size:
            least = 16 ** (size - 1)
            value, n = value * 15 * least + g - least, n * 15 * least
    value = Feistel(key, f"ipv6|{digits}", n).permute(value, sign)
    for at in reversed(range(8)):
        if digits[at]:
            least = 16 ** (digits[at] - 1)
            value, rest = divmod(value, 15 * least)
            groups[at] = rest + least
    new = iter(g for g in groups if g)
    upper = text.upper() == text

    def spelt(m: re.Match) -> str:
        if not int(m[0], 16):
            return m[0]
        out = f"{next(new):0{len(m[0])}x}"
        return out.upper() if upper else out

    return re.sub("[0-9A-Fa-f]+", spelt, text)


#: The country codes of one digit and of two; all others have three.
_ONE_DIGIT = "17"
_TWO_DIGITS = {
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}


def _phone_parts(text: str) -> tuple[str, str]:
    """Country code and the other digits; a number without + is one of country code 1."""
    digits = _digits(text)
    if text[0] != "+":
        return "1", digits
    size = 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3
    return digits[:size], digits[size:]


#: Digits behind the country code, of countries whose numbers all have as many.
_NATIONAL = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "91": 10, "351": 9}


def _phone_alone(text: str) -> str:
    """What looks like a number, without the groups of digits behind it that belong to another one."""
    if text[0] != "+":
        return text
    code, body = _phone_parts(text)
    own, digits, longest = len(code) + _NATIONAL.get(code, len(body)), 0, text
    for i, c in enumerate(text):
        digits += "0" <= c <= "9"
        if "0" <= c <= "9" and not "0" <= text[i + 1 : i + 2] <= "9":  # a group ends
            if digits == own:
                return text[: i + 1] if digits <= 15 else longest
            if digits <= 15:
                longest = text[: i + 1]
    return longest


def _valid_phone(text: str) -> bool:
    return 7 <= len(_digits(text)) <= 15 and len(_phone_parts(text)[1]) >= 6


def _phone(text: str, key: bytes, sign: int) -> str:
    code, body = _phone_parts(text)
    value = Feistel(key, f"phone|{code}|{len(body)}", 10 ** len(body)).permute(int(body), sign)
    return _refill(text, (code if text[0] == "+" else "") + f"{value:0{len(body)}d}")


def _email(text: str, key: bytes, sign: int) -> str:
    """The local part is permuted in lower case; letters take the case of the place they get."""
    local, _, host = text.rpartition("@")
    low = "".join(_LOWER.get(c, c) for c in local)
    new = _permute_characters(low, "email|" + host.lower(), key, sign)
    return "".join(_UPPER.get(n, n) if c in _LOWER else n for c, n in zip(local, new, strict=True)) + "@" + host


_LOWER = {u: c for lower, upper in ((1, 2), (3, 4)) for c, u in zip(_CLASSES[lower], _CLASSES[upper], strict=True)}
_UPPER = {c: u for u, c in _LOWER.items()}


def _secret(text: str, key: bytes, sign: int) -> str:
    if issued := _ISSUED.fullmatch(text):
        return issued[1] + _permute_characters(text[len(issued[1]) :], f"secret|{issued[1]}", key, sign)
    upper = text.upper() == text
    value = Feistel(key, f"secret|{len(text)}", 16 ** len(text)).permute(int(text, 16), sign)
    new = f"{value:0{len(text)}x}"
    return new.upper() if upper else new


_MAP: dict[str, Callable[[str, bytes, int], str]] = {
    "card": _card, "iban": _iban, "ssn": _ssn, "date": _date, "ipv4": _ipv4, "ipv6": _ipv6, "phone": _phone, "email": _email, "secret": _secret,
}

#: What numbers look like, in the order in which they are tried where they begin, each with its validation.
_NUMBERS: tuple[tuple[str, re.Pattern, Callable[[str], object]], ...] = tuple(
    (kind, re.compile(pattern, re.X), valid)
    for kind, pattern, valid in (
        ("date", r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2} | [0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}) (?![0-9]|[-/.](?!(?:[0-9]{4}([-/.])[0-9]{2}\3[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\4[0-9]{4})(?![0-9]))[0-9])", _parsed_date),
        ("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3} (?![0-9]|\.[0-9])", _valid_ipv4),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4} (?![0-9]|-[0-9])", _valid_ssn),
        ("card", r"(?: [0-9]{13,19} | [0-9]{4}([ .\u00a0-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7} | [0-9]{4}([ .\u00a0-])[0-9]{6}\2[0-9]{5} ) (?![0-9])", _valid_card),
        ("phone", r"(?: \+(?:%s)[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{2,5}){1,6} | \+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3} | \(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4} ) (?![0-9])" % "|".join(_NATIONAL), _valid_phone),
    )
)
_HEX = re.compile(r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z_])")
#: How issued access keys begin.
_ISSUED = re.compile(r"(AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|hf_)[0-9A-Za-z_-]{16,}")
_TOKEN = re.compile(r"(?<![0-9A-Za-z_-])" + _ISSUED.pattern)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{5,39}(?![0-9A-Za-z:.]*[0-9A-Za-z:])")
# every beginning, cut at the length of its country: what follows can look like more of it
_IBAN = re.compile(
    r"(?<![0-9A-Za-z])(?=[A-Z]{2}[0-9]{2})(?=((?:%s)(?![0-9A-Za-z])))"
    % "|".join(f"{country}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for country, n in IBAN_LENGTHS.items())
)
_RUN = re.compile(r"[+(]{0,2}[0-9][0-9 \u00a0().:/+-]*")
_TIME = re.compile("[Tt][0-9]{2}(?::?[0-9]{2}|Z|$)")
_OWN = re.compile(r"(?:[0-9]+(?:\.[0-9]+)*)?")
_BEGIN = re.compile(r"[0-9+(]")
_LOCAL = re.compile(r"[\w.%+-]")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_ANY_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        while start < at and text[start] in ".-+%":
            start += 1
        # letters other than a to z are a host's only where it cannot end before them
        host = _HOST.match(text, at + 1) or _ANY_HOST.match(text, at + 1)
        if host and start < at:
            yield start, host.end(), "email"
        at = text.find("@", at + 1)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Valid numbers: where several kinds begin at one place, the first of ``_NUMBERS`` that is valid."""
    for run in _RUN.finditer(text):
        start, end = run.span()
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            # the run begins inside a word: the search goes on behind the numbers of that word
            start = _OWN.match(text, start, end).end()
        while end - start >= 7 and (begin := _BEGIN.search(text, start, end)) is not None:
            at = begin.start()
            start = at + 1
            if text[at - 1 : at].isdigit() and at:
                continue
            for kind, pattern, valid in _NUMBERS:
                m = pattern.match(text, at, end)
                if m is None:
                    continue
                value = _phone_alone(m[0]) if kind == "phone" else m[0]
                behind = at + len(value)
                after = text[behind : behind + 1]
                joined = (after.isalnum() or after == "_") and not (kind == "date" and _TIME.match(text, behind))
                if not joined and valid(value):
                    yield at, behind, kind
                    start = behind
                    break


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the valid values, in order and without overlap."""
    found = [*_emails(text), *_numbers(text)]
    found += [(m.start(), m.end(), "secret") for m in _HEX.finditer(text) if not m[0].isdigit()]
    found += [(m.start(), m.end(), "secret") for m in _TOKEN.finditer(text) if any("0" <= c <= "9" for c in text[m.end(1) : m.end()])]
    found += [(m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text) if _valid_ipv6(m[0])]
    found += [(*m.span(1), "iban") for m in _IBAN.finditer(text) if _valid_iban(_compact(m[1]))]
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for start, end, kind in found:
        if not kept or start >= kept[-1][1]:
            kept.append((start, end, kind))
    return kept


@lru_cache(maxsize=1 << 16)
def _mapped(value: str, kind: str, key: bytes, sign: int) -> str:
    return _MAP[kind](value, key, sign)


def pseudonymize_text(text: str, key: bytes, sign: int = 1) -> tuple[str, list[str]]:
    """The text with its values replaced, and the kinds replaced; ``sign`` -1 restores."""
    out, last, kinds = [], 0, []
    for start, end, kind in find(text):
        out += [text[last:start], _mapped(text[start:end], kind, key, sign)]
        last = end
        kinds.append(kind)
    return "".join([*out, text[last:]]) if kinds else text, kinds


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", restore: bool = False, with_counts: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and, ``with_counts``, one ``n_<kind>`` long per kind of value."""
    counts = [f"n_{k}" for k in KINDS] if with_counts else []
    passed = without_columns(docs, counts)
    at, sign = passed.columns.index(text_col), -1 if restore else 1
    kinds_of = [f.dataType if i != at else T.StringType() for i, f in enumerate(passed.schema.fields)] + [T.LongType() for _ in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, tally = [], [[0] * batch.num_rows for _ in KINDS]
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                new, kinds = (text, []) if text is None else pseudonymize_text(text, key, sign)
                texts.append(new)
                for kind in kinds:
                    tally[KINDS.index(kind)][i] += 1
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(x, pa.int64()) for x in tally] if with_counts else []
            yield pa.RecordBatch.from_arrays(columns, names=numbered(len(columns)))

    return map_columns(passed, run, [*passed.columns, *counts], kinds_of)
