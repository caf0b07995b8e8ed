"""Text functions as native column expressions: cleaning, paragraphs, Treebank tokens, word counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAGRAPH_THRESHOLD = 150

#: Control characters but for the line feed; 0x9f is not one of them.
CONTROL = r"[\x00-\x09\x0b-\x1f\x80-\x9e]"

#: The published Penn Treebank tokenisation as ordered substitutions, without lookaround; neighbours that can't touch the same place are
#: one pattern, and what can't occur without a certain character is asked only where that stands. ``$1`` stands for the first group. Fixed values.
TREEBANK: list[tuple[str, str, str | None]] = [
    (r'^"', "``", '"'),
    (r"(``)", " $1 ", "`"),
    (r"([ \(\[{<])(\"|'{2})", "$1 `` ", None),
    (r"([:,])([^\d])", " $1 $2", None),
    (r"([:,])$", " $1 ", None),
    (r"\.\.\.", " ... ", "..."),
    (r"([;@#$%&])", " $1 ", None),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", "$1 $2$3 ", "."),
    (r"([?!])", " $1 ", None),
    (r"([^'])' ", "$1 ' ", "'"),
    (r"(--|[\]\[(){}<>])", " $1 ", None),
    (r"^", " ", None),
    (r"$", " ", None),
    (r'"', " '' ", '"'),
    (r"(\S)('')", "$1 $2 ", "'"),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 ", "'"),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ", "'"),
    (r"(?i)\b(?:(can)(not)|(d)('ye)|(gim)(me)|(gon)(na)|(got)(ta)|(lem)(me)|(mor)('n))\b", " $1$3$5$7$9$11$13 $2$4$6$8$10$12$14 ", None),
    (r"(?i)\b(wan)(na)\s", " $1 $2 ", None),
    (r"(?i) ('t)(is|was)\b", " $1 $2 ", "'"),
]


def clean(text: Column) -> Column:
    """PF1: each control character but the line feed becomes a space."""
    return F.regexp_replace(text, CONTROL, " ")


def split_paragraphs(text: Column) -> Column:
    """PF2: the parts between ``\\n\\n``, empty ones too."""
    return F.split(text, "\n\n", -1)


def filter_paragraphs(parts: Column, threshold: int = PARAGRAPH_THRESHOLD) -> Column:
    """PF3: the parts of more than ``threshold`` code points."""
    return F.filter(parts, lambda p: F.length(p) > threshold)


def paragraphs(text: Column, threshold: int = PARAGRAPH_THRESHOLD) -> Column:
    """PF4: cleaned, split and filtered; a null text gives null."""
    return filter_paragraphs(split_paragraphs(clean(text)), threshold)


def treebank(text: Column) -> Column:
    """The text with a space between any two tokens.

    Wrapping in spaces comes as plain concatenation: engines differ in what ``^`` and ``$`` match beside line ends.
    """
    out = text
    for pattern, put, needs in TREEBANK:
        if pattern in ("^", "$"):
            out = F.concat(F.lit(" "), out) if pattern == "^" else F.concat(out, F.lit(" "))
        else:
            out = F.regexp_replace(out, pattern, put) if needs is None else _where(out, needs, pattern, put)
    return out


def _where(text: Column, needs: str, pattern: str, put: str) -> Column:
    """The substitution, only where a text has the character that its pattern needs. The text is computed once."""
    return F.get(F.transform(F.array(text), lambda x: F.when(F.contains(x, F.lit(needs)), F.regexp_replace(x, pattern, put)).otherwise(x)), F.lit(0))


def tokens(text: Column) -> Column:
    """PF5: Treebank tokens of a text."""
    return F.filter(F.split(treebank(text), r"\s+"), lambda x: x != "")


def count_words(text: Column) -> Column:
    """PF6: the number of Treebank tokens, counted without making them: a letter for each, and nothing between."""
    return F.length(F.regexp_replace(F.regexp_replace(treebank(text), r"\S+", "x"), r"\s+", "")).cast("long")


def nb_words(parts: Column) -> Column:
    """PF7: the tokens of all paragraphs; 0 without any."""
    counts = F.transform(parts, count_words)
    return F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def join_paragraphs(parts: Column) -> Column:
    """PF8: the kept paragraphs, one a line."""
    return F.array_join(parts, "\n")


def key_of_path(path: Column) -> Column:
    """SC4: the file's name without folders and without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def output_name(path: Column, extension: str) -> Column:
    """SK7: the key with another extension."""
    return F.concat(key_of_path(path), F.lit(extension))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
