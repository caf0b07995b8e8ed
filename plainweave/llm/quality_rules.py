"""Quality rules: a decision list learned from labelled documents, applied as one Spark conditional expression.

Only DataFrame functions touch the texts. Their statistics (a handful of numbers a document) are
written once. The list is learned from the statistics of a bounded sample of labelled documents (``max_labelled``, those
with the smallest hash of doc_id) by sequential covering on the driver, into at most ``most_rules`` rules of ``most_conditions`` conditions
on ``cuts`` thresholds a feature:

* grow: from no condition, add the threshold condition with the greatest FOIL gain until no good document of the growing part is covered;
* prune: cut trailing conditions while that does not lower the rule's worth (p - n) / (p + n) on the pruning part;
* accept a rule only if it is at least ``min_precision`` right on either part, remove what it covers, and go on.

Documents that a rule covers are rejected; all others are kept.

Nulls: a null text has no words, which fails the base rule. Labels without doc_id or quality, and documents
labelled both ways, teach nothing. Without labels there are no rules and only the base rule rejects. A null ratio
(no words) meets no condition. Repeated rows are judged one by one. An empty text is one without words. Texts are taken whole, however long: a text's words and windows are arrays in its row.
Conditions of equal gain: the first in the order of FEATURES, then the lower threshold, ``>=`` before ``<=``. An empty table gives an empty result.
Further columns of the documents are carried along by ``keep_good``, also if they are named like a statistic (only doc_id and text are read beside
the rows' own key); names that start with ``__pw_`` are the operators' own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.llm.cascade import drop_rows
from plainweave.llm.common import ROW_KEY, row_key, stored, words

WINDOW = 8
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
}
FEATURES = ["n_words", "n_dup_lines", *RATIOS]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """How many words are in windows of WINDOW words found twice or more in the array of words ``w``.

    Windows are compared by a 64-bit hash of their words' hashes.
    """
    one, zero = F.lit(1), F.lit(0)

    def covered(at: Column) -> Column:
        gap = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + one) - F.get(at, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(zero, F.size(at) - one), zero, lambda acc, k: acc + gap(k))

    def places(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(zero, F.size(pairs) - one), lambda k: same(k, k + one) | same(k, k - one))
        return F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["i"]))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = _let(_let(pairs, places), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(some)

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(zero, F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)]))

    n = _let(_let(F.transform(w, lambda x: F.xxhash64(x)), hashed), counted)
    return F.when(F.size(w) <= WINDOW, zero).otherwise(n).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics of each document beside its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    split = docs.select("*", words(F.col("text")).alias("__pw_words"), line.alias("__pw_lines"))
    w, lines = F.col("__pw_words"), F.col("__pw_lines")
    return split.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": only(r"#*$%&|<>"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_marks": only("!?"),
        "n_capitals": only("A-Z"),
        "n_lines": F.size(lines).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
    }).drop("__pw_words", "__pw_lines")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*BASE, "n_marks", "n_capitals", "n_lines", "n_distinct_words"]


def feature(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    top, under = RATIOS[name]
    return F.try_divide(F.col(top).cast("double"), F.col(under).cast("double"))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = feature(self.name)
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """True for documents to keep: the ordered list as one CASE expression."""
    out = None
    for rule in rules:
        met = reduce(lambda a, b: a & b, [c.column() for c in rule])
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cover(rows: list[tuple[bool, list[float | None]]], min_precision: float = 0.97, least: int = 5, cuts: int = 32, most_rules: int = 16, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering. ``rows``: (is bad, FEATURES), in an order that doesn't depend on the label; every third prunes."""
    from math import log2

    n = len(rows)
    mask = lambda test: sum(1 << i for i in range(n) if test(i))
    bad, pruning = mask(lambda i: rows[i][0]), mask(lambda i: i % 3 == 2)
    tests: list[tuple[Condition, int]] = []
    for k, name in enumerate(FEATURES):
        values = sorted({r[1][k] for r in rows if r[1][k] is not None})
        for cut in sorted({values[len(values) * j // (cuts + 1)] for j in range(1, cuts + 1)} | {values[0], values[-1]} if values else ()):
            tests.append((Condition(name, True, cut), mask(lambda i: rows[i][1][k] is not None and rows[i][1][k] >= cut)))
            tests.append((Condition(name, False, cut), mask(lambda i: rows[i][1][k] is not None and rows[i][1][k] <= cut)))
    rules: list[Rule] = []
    left = (1 << n) - 1
    while len(rules) < most_rules:
        grow, prune = left & ~pruning, left & pruning
        covered, picked = grow, []
        while len(picked) < most_conditions and covered & ~bad:
            p, m = (covered & bad).bit_count(), covered.bit_count()
            if not p:
                break
            gain = lambda t: 0.0 if not (q := (t[1] & covered & bad).bit_count()) else q * (log2(q / (t[1] & covered).bit_count()) - log2(p / m))
            best = max(tests, key=gain, default=None)
            if best is None or gain(best) <= 1e-9:
                break
            picked.append(best)
            covered &= best[1]
        if not picked:
            break

        def scored(k: int, part: int) -> tuple[int, int]:
            on = reduce(lambda a, b: a & b, [t[1] for t in picked[:k]], part)
            return (on & bad).bit_count(), (on & ~bad).bit_count()

        worth = lambda k: (lambda p, m: (p - m) / (p + m) if p + m else -1.0)(*scored(k, prune))
        size = max(range(1, len(picked) + 1), key=lambda k: (worth(k), -k))
        ok = all(p >= least and p >= min_precision * (p + m) for p, m in (scored(size, grow), scored(size, prune)))
        on = reduce(lambda a, b: a & b, [t[1] for t in picked[:size]], left)
        if not ok or not on:
            break
        rules.append(tuple(t[0] for t in picked[:size]))
        left &= ~on
    return rules


def learn(stats: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> list[Rule]:
    """The decision list from ``stats`` (doc_id, STATISTICS) and ``labels`` (doc_id, quality 0 or 1).

    With more than ``max_labelled`` labelled documents, those whose hash lies below a threshold: it is found by counting hashes in
    ranges, so that nothing is sorted and only the sample comes to the driver.
    """
    taught = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    order = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit("rules:"), F.col("doc_id").cast("string"))), 1)
    taught = taught.select("doc_id", (F.col("quality") == 0).alias("bad"), order.alias("turn"))
    known = stored(stats.filter(~base_failed()).join(taught, "doc_id").select("bad", "turn", F.array(*[feature(x) for x in FEATURES]).alias("x")), "labelled")
    n = known.count()
    if n > max_labelled:
        span = 2**63 * max_labelled // n // 64  # a range holds about a 64th of the sample
        at = F.floor(F.col("turn") / F.lit(span)).cast("long")
        few = {r["at"]: r["count"] for r in known.select(at.alias("at")).filter("at < 128").groupBy("at").count().collect()}
        ranges, held = 0, 0
        while ranges < 128 and held + few.get(ranges, 0) <= max_labelled:
            held += few.get(ranges, 0)
            ranges += 1
        known = known.filter(at < ranges)
    rows = sorted(known.collect(), key=lambda r: (r["turn"], r["bad"], [(v is None, v or 0.0) for v in r["x"]]))
    return cover([(r["bad"], list(r["x"])) for r in rows], **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, STATISTICS, base_failed, kept, rule (the position of the rule that rejects it)."""
    stats = stored(statistics(docs.select("doc_id", "text")).select("doc_id", *STATISTICS), "statistics")
    rules = learn(stats, labels, **options)
    kept = ~base_failed() & verdict(rules)
    return stats.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that the base rule or the decision list rejects; no text is shuffled."""
    narrow = stored(statistics(docs.select("doc_id", "text")).select("doc_id", *STATISTICS, row_key().alias(ROW_KEY)), "statistics")
    rules = learn(narrow, labels, **options)
    return drop_rows(docs, stored(narrow.select("doc_id", ROW_KEY, (base_failed() | ~verdict(rules)).alias("gone")), "judged"))
