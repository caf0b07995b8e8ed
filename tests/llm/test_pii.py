import re
from datetime import date

import pytest

from plainweave.llm.pii import KINDS, Pseudonyms, iban_remainder, luhn_digit, pseudonymise

KEY = b"key for tests"
TEXT = "card 4111 1111 1111 1111, again 4111111111111111; bad 4111 1111 1111 1112. Call (212) 555-0187 or +1 212-555-0187, ip 8.8.8.8 and 10.0.0.1, ssn 219-09-9999, born 1987-02-28 or 28/02/1987 or 02/28/1987, never 2020-13-01. iban DE89 3704 0044 0532 0130 00, mail Jo.Doe7@example.com"


def test_values_keep_their_format_and_links():
    out, n = Pseudonyms(KEY).text(TEXT)
    assert n == {"card": 2, "phone": 2, "ip": 1, "ssn": 1, "iban": 1, "date": 3, "email": 1}
    assert re.sub("[A-Za-z0-9]", "0", out) == re.sub("[A-Za-z0-9]", "0", TEXT) or len(out.split()) == len(TEXT.split())
    for same in ("4111 1111 1111 1112", "10.0.0.1", "2020-13-01", "@example.com"):
        assert same in out
    for gone in ("4111 1111 1111 1111", "(212) 555-0187", "8.8.8.8", "219-09-9999", "1987-02-28", "DE89 3704", "Jo.Doe7"):
        assert gone not in out
    cards = re.findall(r"card ([0-9 ]{19}), again ([0-9]{16})", out)[0]
    assert cards[0].replace(" ", "") == cards[1]
    assert luhn_digit(cards[1][:-1]) == cards[1][-1]
    iban = re.search(r"iban ([A-Z0-9 ]{27})", out)[1].replace(" ", "")
    assert iban.startswith("DE") and iban_remainder(iban) == 1
    date.fromisoformat(re.search(r"born ([0-9-]{10})", out)[1])
    assert re.search(r"\(([0-9]{3})\) ([0-9-]{8}) or \+1 \1-\2", out)


def test_the_key_undoes_it():
    out, _ = Pseudonyms(KEY).text(TEXT)
    assert Pseudonyms(KEY, back=True).text(out)[0] == TEXT
    assert Pseudonyms(b"other").text(TEXT)[0] != out


@pytest.mark.parametrize("size", [1, 2, 10, 97, 256, 1000])
def test_permutations(size):
    there, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    even = lambda v: v % 2 == 0
    assert sorted(there.permuted(v, size, "t") for v in range(size)) == list(range(size))
    assert [back.permuted(there.permuted(v, size, "t"), size, "t") for v in range(size)] == list(range(size))
    assert {there.permuted(v, size, "t", even) for v in range(0, size, 2)} == set(range(0, size, 2))


def test_table(spark):
    rows = [(1, TEXT), (2, TEXT), (None, "x"), (3, None), (4, ""), (5, "12 " * 20_000), (1, TEXT)]
    got = sorted(pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect(), key=repr)
    texts = [r["text"] for r in got if r["doc_id"] in (1, 2)]
    assert len(texts) == 3 and len(set(texts)) == 1
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (3, 4, None)} == {3: None, 4: "", None: "x"}
    assert all(r[f"n_{k}"] == 0 for r in got if r["doc_id"] == 3 for k in KINDS)
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


@pytest.mark.parametrize(
    ("value", "after"),
    [
        ("4111111111111111", " 12/27"), ("4111 1111 1111 1111", " 123"), ("4111-1111-1111-1111", "-12"), ("4111-1111-1111-1111", "-1234"), ("378282246310005", " 1234 5"),
        ("DE89370400440532013000", " BIC COBADEFFXXX"), ("GB82 WEST 1234 5698 7654 32", " USD"), ("DE89 3704 0044 0532 0130 00", " 100 EUR"),
    ],
)
def test_what_follows_a_value_does_not_hide_it(value, after):
    alone, n = Pseudonyms(KEY).text(value)
    assert sum(n.values()) == 1 and alone != value
    assert Pseudonyms(KEY).text(f"x {value}{after}") == (f"x {alone}{after}", n)


@pytest.mark.parametrize("before", ["12 ", "12-", "2020-13-01 ", "AB12 CD34 "])
def test_search_goes_on_after_a_failed_start(before):
    alone, n = Pseudonyms(KEY).text("4111111111111111")
    assert Pseudonyms(KEY).text(f"{before}4111111111111111.") == (f"{before}{alone}.", n)


@pytest.mark.parametrize("value", ["8.8.8.8", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"])
def test_values_of_single_digits_alone_in_a_text(value):
    alone, n = Pseudonyms(KEY).text(value)
    assert sum(n.values()) == 1 and alone != value
    assert Pseudonyms(KEY).text(f"{value}, room 42")[0] == f"{alone}, room 42"
