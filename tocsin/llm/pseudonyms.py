"""Format-preserving pseudonyms for personal data.

Found values are validated (check digits, ranges, calendar), then permuted within
their format by a keyed Feistel network over two mixed-radix halves: a card number
gives a card number of the same network and spacing with a right check digit, a
date gives a date.  Beside a card may stand other digits: any groups of a run that
have a card's length and check digit are one, so every tenth such span of other
numbers is taken for a card by chance.  Phones have any area and office code, or + or 00 and a country
code, which is kept; behind such a code all groups of digits up to 15 digits belong
to the number, as the plans of the countries are not known.  A value has the same pseudonym wherever it occurs under one
key, so documents stay linked; other numbers stay as they are.  Each kind is a
permutation of its format, so different values stay different.

Null texts stay null, empty texts empty.  Overlapping finds go by the leftmost,
then by the order of ``KINDS``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import narrow, slices

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 10
#: The formats that are looked for, bounded by other characters than their own.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,}",  # a run of groups, any of which may begin or end a card
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?|[0-9]{3}[ .-][0-9]{3}[ .-])[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
}
FIND = {k: re.compile(v) for k, v in PATTERNS.items()}
#: Phones with a country code: + or 00, the code, a trunk 0 in brackets, groups of digits.
ABROAD = re.compile(r"(?<![0-9A-Za-z+])(?:\+|(?<![0-9]{2}[ .-])00)(?:[1-9][0-9]{0,2}\)(?=[ ./-]?[0-9(])|[1-9][0-9]*)(?:[ .-]?\(0\))?(?:[ ./-]?(?:\([0-9]{2,5}\)|[0-9]+))*")
#: Groups that cards are written in; also one of all digits.
LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((4, 4, 4, 4, n) for n in (1, 2, 3)), *((4, 4, 4, n) for n in (1, 2, 3))}
LEAST_CARD, MOST_CARD = 13, 19
#: What cannot come before the first digit of a card, and after the last.
BEFORE_CARD, AFTER_CARD = re.compile("[0-9A-Za-z.-]"), re.compile("[0-9A-Za-z]|[.-][0-9]")
TRUNK, DIGITS, GROUP = "(0)", re.compile("[0-9]+"), re.compile(r"[0-9]+\)?")
#: Country codes of one and two digits; all others have three.
COUNTRIES = {*"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: A text without any of these holds no value.
SIGN = re.compile(r"@|[0-9]")
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Cipher:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def round(self, tweak: bytes, k: int, value: int, below: int) -> int:
        size = value.bit_length() // 8 + 1
        out = hashlib.blake2b(tweak + bytes([k]) + value.to_bytes(size, "big"), key=self.key, digest_size=(below.bit_length() + 7) // 8 + 8).digest()
        return int.from_bytes(out, "big") % below

    def once(self, tweak: bytes, value: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(value, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self.round(tweak, k, left, b)) % b
            else:
                left = (left + sign * self.round(tweak, k, right, a)) % a
        return left * b + right

    def permute(self, kind: str, value: int, below: int, back: bool = False) -> int:
        """A permutation of 0 .. below-1 for each kind and bound: walks until it is in range."""
        b = isqrt(below - 1) + 1
        a = -(-below // b)
        tweak = f"{kind}:{below}:".encode()
        value = self.once(tweak, value, a, b, back)
        while value >= below:
            value = self.once(tweak, value, a, b, back)
        return value


def refill(shape: str, chars: str, is_own) -> str:
    """``shape`` with its own characters, in order, replaced by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if is_own(c) else c for c in shape)


def check_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def spell(c: Cipher, kind: str, text: str, back: bool) -> str:
    """Letters give letters of their case, digits digits; other characters stay."""
    value, below = 0, 1
    sets = [(26, 97) if "a" <= x <= "z" else (26, 65) if "A" <= x <= "Z" else (10, 48) if "0" <= x <= "9" else None for x in text]
    for x, s in zip(text, sets, strict=True):
        if s:
            value, below = value * s[0] + ord(x) - s[1], below * s[0]
    if below == 1:
        return text
    shape = "".join("." if s is None else "a" if s[1] == 97 else "A" if s[1] == 65 else "0" for s in sets)
    value = c.permute(f"{kind}:{shape}", value, below, back)
    out = []
    for x, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            value, d = divmod(value, s[0])
            x = chr(s[1] + d)
        out.append(x)
    return "".join(reversed(out))


def email(c: Cipher, v: str, back: bool) -> str:
    local, _, host = v.rpartition("@")
    names, _, top = host.rpartition(".")
    return f"{spell(c, 'local', local, back)}@{'.'.join(spell(c, 'host', n, back) for n in names.split('.'))}.{top}"


def iban_rest(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(x, 36)) for x in account + country + '00')) % 97:02d}"


def iban(c: Cipher, v: str, back: bool) -> str | None:
    flat = v.replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_rest(flat[:2], flat[4:]) != flat[2:4]:
        return None
    account = spell(c, "iban" + flat[:2], flat[4:], back)
    return refill(v, flat[:2] + iban_rest(flat[:2], account) + account, lambda x: x != " ")


def is_card(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """In each run of groups of digits, spans of whole groups with the length and the check
    digit of a card that do not overlap: first those written as cards are, then the longest."""
    for run in FIND["card"].finditer(text):
        groups = [g.span() for g in DIGITS.finditer(text, *run.span())]
        first = int(run.start() > 0 and BEFORE_CARD.match(text, run.start() - 1) is not None)
        last = len(groups) - int(AFTER_CARD.match(text, run.end()) is not None)
        found = []
        for a in range(first, last):
            digits, sizes = "", ()
            for b in range(a, last):
                start, end = groups[b]
                if len(digits) + end - start > MOST_CARD:
                    break
                digits, sizes = digits + text[start:end], (*sizes, end - start)
                if len(digits) >= LEAST_CARD and is_card(digits):
                    found.append((len(sizes) > 1 and sizes not in LAYOUTS, digits[0] not in "3456", -len(digits), a, b))
        taken = bytearray(len(groups))
        for *_, a, b in sorted(found):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                yield groups[a][0], groups[b][1]


def card(c: Cipher, v: str, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", v)
    if not is_card(digits):
        return None
    n = len(digits) - 2
    body = digits[0] + f"{c.permute('card' + digits[0], int(digits[1:-1]), 10**n, back):0{n}d}"
    return refill(v, body + check_digit(body), str.isdigit)


def own_digits(v: str) -> tuple[str, list[int]] | None:
    """Country code of a phone, 1 where it has none, and the places of its other digits."""
    if FIND["phone"].fullmatch(v):
        return "1", [k for k, x in enumerate(v) if x.isdigit()][-10:]
    lead, trunk = 1 if v[0] == "+" else 2, v.find(TRUNK)
    at = [k for k, x in enumerate(v) if k >= lead and x.isdigit() and (trunk < 0 or k != trunk + 1)]
    digits = "".join(v[k] for k in at)
    code = next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRIES), digits[:3])
    size, n = len(code), len(digits) - len(code)
    if n != 10 if code in ("1", "7") else n < 4 or not 7 <= n + size <= 15:
        return None
    if v[lead : lead + size] != code or lead == 2 and v[2 + size].isdigit():  # behind 00 only a code that stands apart
        return None
    return code, at[size:]


def phone(c: Cipher, v: str, back: bool) -> str:
    code, at = own_digits(v)
    out = list(v)
    new = c.permute("phone" + code.removeprefix("1"), int("".join(v[k] for k in at)), 10 ** len(at), back)
    for k, x in zip(at, f"{new:0{len(at)}d}", strict=True):
        out[k] = x
    return "".join(out)


def abroad(text: str, found: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Phones with a country code: of each the longest that ends at a group and leaves
    the other values in ``found`` (in order) whole, but those inside that are cards by chance."""
    reach = max((e - s for s, _, e, _ in found), default=0)
    for m in ABROAD.finditer(text):
        start = m.start()
        near = found[bisect_left(found, (start - reach,)) : bisect_left(found, (m.end(),))]
        for end in reversed([g.end() for g in GROUP.finditer(text, start, m.end())]):
            if text[end : end + 1].isalnum() or own_digits(text[start:end]) is None:
                continue
            if not any(s < end and start < e and (s < start or end < e or KINDS[k] not in ("card", "phone")) for s, k, e, _ in near):
                yield start, end
                break


def ssn(c: Cipher, v: str, back: bool) -> str | None:
    area, group, serial = (int(x) for x in v.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    rest, serial = divmod(c.permute("ssn", (area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, back), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def ip(c: Cipher, v: str, back: bool) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if any(p > 255 for p in parts) or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
        return None
    return ".".join(map(str, c.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back).to_bytes(4, "big")))


def day(c: Cipher, v: str, back: bool) -> str | None:
    """Years first, or days first; with slashes months first where that is a date."""
    try:
        if v[4] == "-":
            form, d = "%Y-%m-%d", date.fromisoformat(v)
        else:
            x, y, year = int(v[:2]), int(v[3:5]), int(v[6:])
            form, d = (f"%m{v[2]}%d{v[2]}%Y", date(year, x, y)) if v[2] == "/" and x <= 12 else (f"%d{v[2]}%m{v[2]}%Y", date(year, y, x))
    except ValueError:
        return None
    if not FIRST_DAY <= d <= LAST_DAY:
        return None
    n = (LAST_DAY - FIRST_DAY).days + 1
    if form.startswith("%d/"):  # only days that cannot be read as months keep this form
        days = [k for k in range(n) if (FIRST_DAY + timedelta(k)).day > 12]
        at = c.permute("day/", days.index((d - FIRST_DAY).days), len(days), back)
        return (FIRST_DAY + timedelta(days[at])).strftime(form)
    return (FIRST_DAY + timedelta(c.permute("date" + form, (d - FIRST_DAY).days, n, back))).strftime(form)


MAKE = {"email": email, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": day}


def replace(cipher: Cipher, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced in ``text``."""
    if not text or not SIGN.search(text):
        return text, []
    found = []
    for order, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text:
            continue
        for start, end in cards(text) if kind == "card" else (m.span() for m in FIND[kind].finditer(text)):
            if (new := MAKE[kind](cipher, text[start:end], back)) is not None:
                found.append((start, order, end, new))
    found.sort()
    far = [(s, KINDS.index("phone"), e, phone(cipher, text[s:e], back)) for s, e in abroad(text, found)]
    out, spans, at = [], [], 0
    for start, order, end, new in sorted(far + found, key=lambda f: f[0]):
        if start >= at:
            out += [text[at:start], new]
            spans.append((KINDS[order], start, end))
            at = end
    return "".join([*out, text[at:]]), spans


def pseudonyms(df: DataFrame, key: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, spans``: the new text, and where values were in the old one (code points)."""
    src = narrow(df, id, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for whole in batches:
            for b in slices(whole):
                new = [replace(cipher, t) for t in b.column(1).to_pylist()]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in new]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in new], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    return src.mapInArrow(run, StructType([src.schema["doc_id"], StructField("text", StringType()), StructField("spans", ArrayType(span))]))


def with_pseudonyms(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``df`` with pseudonyms in its text column; other columns as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for whole in batches:
            for b in slices(whole, at):
                new = pa.array([replace(cipher, t)[0] for t in b.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
