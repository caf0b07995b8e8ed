"""Pseudonyms against a plain version that tries every place of a text, and undone on nested values."""

import hashlib
import random
import re
from datetime import date

import pytest

from plainweave.llm import pii
from plainweave.llm.pii import KINDS, Pseudonyms, pseudonymise

KEY = b"key for tests"
RNG = random.Random(11)
digits = lambda n, rng=RNG: "".join(rng.choice("0123456789") for _ in range(n))


def luhn(body):
    """The digit that makes the sum of the doubled digits a multiple of ten."""
    for d in "0123456789":
        total = 0
        for k, c in enumerate(reversed(body + d)):
            v = int(c) * (2 if k % 2 else 1)
            total += v - 9 if v > 9 else v
        if total % 10 == 0:
            return d
    raise AssertionError


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    for check in range(2, 99):
        number = "".join(str(int(c, 36)) for c in body + "DE" + f"{check:02d}")
        if int(number) % 97 == 1:
            return f"DE{check:02d}{body}"
    raise AssertionError


def value(rng):
    kind = rng.choice(["card", "phone", "ssn", "date", "ip", "iban", "plain"])
    if kind == "card":
        d = "4" + digits(14, rng)
        d += luhn(d)
        return d if rng.random() < 0.5 else " ".join(d[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        return f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4, rng)}"
    if kind == "ssn":
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "date":
        return date.fromordinal(rng.randint(date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal())).isoformat()
    if kind == "ip":
        return f"{rng.randint(11, 100)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
    if kind == "iban":
        return iban(rng)
    return digits(rng.randint(1, 9), rng)


def feistel(key, value, size, tweak, valid=lambda v: True):
    """The same permutation, written out from its definition."""
    secret = hashlib.blake2b(key, digest_size=32).digest()
    half = 1
    while 4**half < size:
        half += 1
    while True:
        left, right = divmod(value, 2**half)
        for k in range(pii.ROUNDS):
            f = hashlib.blake2b(f"{tweak}|{size}|{k}|{right}".encode(), digest_size=(half + 7) // 8 + 8, key=secret).digest()
            left, right = right, left ^ int.from_bytes(f, "big") % 2**half
        value = left * 2**half + right
        if value < size and valid(value):
            return value


def plain(kind, text):
    """The pseudonym of a whole value, for kinds whose domain is easily written down."""
    d = re.sub("[^0-9]", "", text)
    if kind == "card":
        body = feistel(KEY, int(d[:-1]), 10 ** (len(d) - 1), "card", lambda v: len(set(f"{v:0{len(d) - 1}d}" + luhn(f"{v:0{len(d) - 1}d}"))) > 1)
        new = f"{body:0{len(d) - 1}d}"
        new += luhn(new)
    elif kind == "phone":
        new = f"{feistel(KEY, int(d), 10**10, 'phone', lambda v: f'{v:010d}'[0] > '1' and f'{v:010d}'[3] > '1'):010d}"
    elif kind == "ssn":
        ok = lambda v: (s := f"{v:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        new = f"{feistel(KEY, int(d), 10**9, 'ssn', ok):09d}"
    else:
        first, last = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
        return date.fromordinal(first + feistel(KEY, date.fromisoformat(text).toordinal() - first, last - first + 1, "date")).isoformat()
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


@pytest.mark.parametrize("seed", range(40))
def test_values_against_the_definition(seed):
    rng = random.Random(seed)
    d = "4" + digits(14, rng)
    some = {
        "card": d + luhn(d), "phone": f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4, rng)}",
        "ssn": f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "date": date.fromordinal(rng.randint(693596, 766644)).isoformat(),
    }
    text = ", ".join(some.values()) + "."
    out, n = Pseudonyms(KEY).text(text)
    assert out == ", ".join(plain(k, v) for k, v in some.items()) + "."
    assert {k: c for k, c in n.items() if c} == dict.fromkeys(some, 1)


@pytest.mark.parametrize("seed", range(60))
def test_nested_values_are_undone_by_the_key(seed):
    """Numbers within and beside the local parts of addresses, each replaced once."""
    rng = random.Random(100 + seed)
    parts = []
    for _ in range(30):
        v = value(rng).replace(" ", "-")
        parts.append(rng.choice([v, f"{v}@example.com", f"{v}.{value(rng)}@mail.example.org".replace(" ", "_"), f"a{v}+{digits(3, rng)}@x.net", f"({v})", f"<{v}@example.com>;{value(rng)}"]))
    text = rng.choice([", ", " | ", "\n"]).join(parts)
    there, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    out, n = there.text(text)
    assert n["email"] == len(pii.EMAIL.findall(text)) and n["email"] == len(pii.EMAIL.findall(out))
    again, m = back.text(out)
    assert again == text
    assert m == n


def test_addresses_alone():
    for k in range(300):
        rng = random.Random(k)
        text = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4, rng)}@example.com"
        out, n = Pseudonyms(KEY).text(text)
        assert n == dict.fromkeys(KINDS, 0) | {"email": 1} and out != text
        assert Pseudonyms(KEY, back=True).text(out)[0] == text


def test_the_query_is_the_function_row_by_row(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(value(rng) if rng.random() < 0.2 else "word" for _ in range(60))) for k in range(1500)] + [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_card", "'x' AS lang")
    made = Pseudonyms(KEY)
    want = [(i, *((None, dict.fromkeys(KINDS, 0)) if t is None else made.text(t))) for i, t in rows]
    got = pseudonymise(docs.repartition(5), KEY).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["text"], *[r[f"n_{k}"] for k in KINDS]) for r in got), key=key) == sorted(((i, t, *n.values()) for i, t, n in want), key=key)
