"""PII: format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel permutation.

Found and validated: payment cards (13 to 19 digits, Luhn), North American phone numbers, IPv4 addresses, social
security numbers, IBANs (mod 97), dates (ISO, or day and month with slashes or dots), and the local parts of e-mail addresses.
A value is mapped to a number in the domain of its format, permuted there by a keyed Feistel
network, again and again until the result is valid (cycle walking), and written in the same format: separators, lengths,
check digits and calendar stay right. The card and IBAN patterns may take in numbers or words that follow a value: a match that
isn't valid is tried up to each of its separators (IBAN: the country's length first, then as cards the longest first), then as the other kinds, and the
search goes on just after its start. Each place of a text is replaced once: local parts of addresses are found first, and numbers only beside them. Equal values give equal pseudonyms in all documents, different values different ones, and
the key undoes it (``Pseudonyms(key, back=True)``), but where a card's pseudonym and the digits after it, or an IBAN's of no listed country and the words after it,
happen to be valid together: the pseudonym depends on the value only, not on what follows.

Each text is handled on its own, whole and in one pass; nothing is shuffled. Nulls: a null text stays null with no values
found, an empty one stays empty, a null doc_id stays null. Repeated rows give equal rows. A text is searched from left to right: of values that overlap the one that starts first is taken, of
those with one start the kind that stands first in PATTERNS. A long text is one string in its task; the search goes over it once. An empty table gives an empty result.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
KINDS = ("card", "phone", "ip", "ssn", "iban", "date", "email")
_EDGE = r"(?<![0-9A-Za-z_])"
_END = r"(?![0-9A-Za-z_])"
PATTERNS = {
    "date": rf"{_EDGE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}){_END}",
    "ip": rf"(?<![0-9A-Za-z_.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9A-Za-z_]|\.[0-9])",
    "ssn": rf"(?<![0-9A-Za-z_-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z_]|-[0-9])",
    "phone": rf"(?<![0-9A-Za-z_])(?:\+?1[ .-]?)?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_END}",
    "card": rf"{_EDGE}[0-9](?:[ -]?[0-9]){{12,18}}{_END}",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]){{11,30}}{_END}",
}
NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
EACH = {k: re.compile(p) for k, p in PATTERNS.items()}
SHORTEST = {"card": 13, "iban": 15}
IBAN_LENGTH = {k: int(n) for n, of in {
    "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "BI DJ FR GR IT MC SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
}.items() for k in of.split()}
EMAIL = re.compile(r"(?<![0-9A-Za-z._%+-])([0-9A-Za-z._%+-]+)(?=@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+)")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def luhn_digit(body: str) -> str:
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Keyed permutations of the formats' domains; ``back`` undoes them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = blake2b(key, digest_size=32).digest(), back
        self.of = lru_cache(maxsize=100_000)(self._of)

    def permuted(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The permutation of the valid values among 0 .. size - 1 that ``tweak`` names."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for k in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
                seen = left if self.back else right
                f = int.from_bytes(blake2b(f"{tweak}|{size}|{k}|{seen}".encode(), digest_size=(half + 7) // 8 + 8, key=self.key).digest()) & mask
                left, right = (right ^ f, left) if self.back else (right, left ^ f)
            value = left << half | right
            if value < size and valid(value):
                return value

    def digits(self, text: str, tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        n = len(text)
        return f"{self.permuted(int(text), 10**n, tweak, lambda v: valid(f'{v:0{n}d}')):0{n}d}"

    def classes(self, text: str, tweak: str) -> str:
        """Digits become digits, and letters letters of the same case; all else stays."""
        sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), "") for c in text]
        value, size = 0, 1
        for c, s in zip(text, sets, strict=True):
            if s:
                value, size = value * len(s) + s.index(c), size * len(s)
        shape = "".join(s[0] if s else c for c, s in zip(text, sets, strict=True))
        value, out = self.permuted(value, size, f"{tweak}|{shape}") if size > 1 else value, []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                value, k = divmod(value, len(s))
                out.append(s[k])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a text of this kind; None if it isn't valid."""
        return getattr(self, f"_{kind}")(text)

    @staticmethod
    def _filled(text: str, digits: str, used: str = DIGITS) -> str:
        at = iter(digits)
        return "".join(next(at) if c in used else c for c in text)

    def _card(self, text: str) -> str | None:
        d = re.sub("[ -]", "", text)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = self.digits(d[:-1], "card", lambda x: len(set(x + luhn_digit(x))) > 1)
        return self._filled(text, body + luhn_digit(body))

    def _phone(self, text: str) -> str | None:
        d = re.sub("[^0-9]", "", text)
        ok = lambda x: x[0] > "1" and x[3] > "1"
        return self._filled(text, d[:-10] + self.digits(d[-10:], "phone", ok)) if ok(d[-10:]) else None

    def _ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        value = sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts))
        plain = lambda v: 0 < v >> 24 < 224 and v >> 24 not in (10, 127) and v >> 16 != 0xC0A8 and v >> 20 != 0xAC1 and v >> 16 != 0xA9FE
        if not plain(value):
            return None  # private, local or multicast: no one's address
        value = self.permuted(value, 1 << 32, "ip", plain)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def _ssn(self, text: str) -> str | None:
        ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        d = text.replace("-", "")
        return self._filled(text, self.digits(d, "ssn", ok)) if ok(d) else None

    def _iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if iban_remainder(bare) != 1:
            return None
        body = self.classes(bare[4:], "iban|" + bare[:2])
        made = f"{bare[:2]}{98 - iban_remainder(bare[:2] + '00' + body):02d}{body}"
        return self._filled(text, made, DIGITS + UPPER)

    def _date(self, text: str) -> str | None:
        """Slashes and dots: day first, or month first if only that is a date."""
        orders = ("ymd",) if text[4] == "-" else ("dmy", "mdy")
        for order in orders:
            part = dict(zip(order, map(int, re.split("[-/.]", text)), strict=True))
            try:
                day = date(part["y"], part["m"], part["d"]).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            # A date that reads month first goes to one that reads month first only, so that it can be undone.
            only = lambda v: order != "mdy" or date.fromordinal(v + FIRST_DAY).day > 12  # noqa: E731, B023
            new = date.fromordinal(self.permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date" if order != "mdy" else "date|mdy", only) + FIRST_DAY)
            return "".join(f"{ {'y': new.year, 'm': new.month, 'd': new.day}[c]:0{4 if c == 'y' else 2}d}" + (text[4 if order == 'ymd' else 2] if k < 2 else "") for k, c in enumerate(order))
        return None

    def _email(self, text: str) -> str | None:
        return self.classes(text, "email")

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values replaced, and how many of each kind."""
        n = dict.fromkeys(KINDS, 0)
        out: list[str] = []
        begin = 0
        for mail in EMAIL.finditer(text) if "@" in text else ():
            self._numbers(text, begin, mail.start(), out, n)
            out.append(self.of("email", mail[0]))
            n["email"] += 1
            begin = mail.end()
        self._numbers(text, begin, len(text), out, n)
        return "".join(out), n

    def _numbers(self, text: str, begin: int, end: int, out: list[str], n: dict[str, int]) -> None:
        """Adds the text from ``begin`` to ``end`` with its numbers and dates replaced. What is beside that part still counts as beside it."""
        done = at = begin
        while at < end and _DIGIT.search(text, at, end) and (m := NUMBERS.search(text, at)) and m.start() < end:
            at = m.start() + 1
            for kind, stop in ends(m):
                new = self.of(kind, text[m.start() : stop]) if stop <= end else None
                if new is not None:
                    out += text[done : m.start()], new
                    done = at = stop
                    n[kind] += 1
                    break
        out.append(text[done:end])


def ends(m: re.Match) -> Iterator[tuple[str, int]]:
    """The kinds and ends of what may be a value at the start of a match of ``NUMBERS``, in the order to try them."""
    kinds = list(EACH)
    for kind in kinds[kinds.index(m.lastgroup) :]:
        whole = m if kind == m.lastgroup else EACH[kind].match(m.string, m.start())
        if whole and kind in SHORTEST:
            held, cuts = 0, []
            for k, c in enumerate(whole[0]):
                if c in " -":
                    cuts.append((held, whole.start() + k))
                else:
                    held += 1
            cuts = [(size, end) for size, end in [*cuts, (held, whole.end())] if size >= SHORTEST[kind]]
            fixed = IBAN_LENGTH.get(whole[0][:2])
            yield from ((kind, end) for _, end in sorted(cuts, key=lambda cut: (cut[0] == fixed, cut[0]), reverse=True))
        elif whole:
            yield kind, whole.end()


_DIGIT = re.compile("[0-9]")


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """One row per document: doc_id, text (with pseudonyms), and the number of values of each kind, ``n_card`` and so on."""
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key, back)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                done = [(None, dict.fromkeys(KINDS, 0)) if t is None else made.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), *[pa.array([n[k] for _, n in done], pa.int64()) for k in KINDS]], names=["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
