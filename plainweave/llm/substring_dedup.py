"""Substring deduplication: repeats of ``window`` words are found by recompression and removed from the later documents.

Recompression names the symbols of a text level by level. A round first names runs of one symbol, then pairs: a
hash puts each symbol on the left or right side, and a left symbol followed by a right one becomes one new
symbol. Names are 64-bit hashes of what they replace, so all tasks agree on them without a dictionary, and
equal substrings get the same symbols but for those near their ends. Numbers dealt out by a Spark round a level would name the same runs and pairs, one to one
but for hash collisions; they would shuffle all symbols of all texts four times (a token's 8 bytes and its place, about twice the texts' size, a round), past the
disk that the check allows. So the rounds of a text run in its task, and one Spark round groups the names of the last level. Few rounds keep each symbol's context short, the words that decided
its making; the last level names the shortest row of symbols that has ``PHRASE`` words or more, for every other
first symbol (by its name). A symbol whose context lies within a window stands in every occurrence of that window.

1. Of documents with the same words only the one with the smallest doc_id goes on; the others lose all their windows.
2. A Spark round groups the high-level symbols of all documents by name and keeps those found in two documents or more, as
   a Bloom filter of about ten bits each, at most 2^``most_log2_bits`` bits (32 MB).
3. A window that holds the context of a symbol of no other document occurs nowhere else. Only the other windows are
   named themselves (96 bits of two polynomial hashes of their words): this verifies the repeats where the shared symbols end. A task settles the windows that
   it holds twice, so of each name only those with a task's smallest doc_id are shuffled, once, and sorted by name and doc_id.
4. Words covered by windows that also start in a document with a smaller doc_id are removed.

A fuller Bloom filter only lets more windows through to step 3. Nothing is paired or collected: a sorted name's first row has its smallest doc_id.

Nulls: a null text has no words, a null doc_id counts as larger than any other. Rows that agree in doc_id and text
share their result; equal doc_ids never remove each other's words. An empty text has no words; one of fewer than ``window`` words loses none. Of documents with a window the smallest doc_id
keeps it, wherever in the text it stands. A long text is a chunk of its own and takes some tens of bytes a word in its task. An empty table gives an empty result.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.llm.cascade import drop_rows
from plainweave.llm.common import ROW_KEY, Bloom, joined_by_weight, row_key, stored, words
from plainweave.llm.ragged import chunks, mix, padded, split_words, xxh64

CAP, ROUNDS, PHRASE = 10, 4, 16
NO_ID = (1 << 63) - 1
HELD_WINDOWS = 1_500_000
_COLUMNS = ["a", "b", "id", ROW_KEY, "at", "starts"]
_RUN, _SIDE, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_BASES = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53)


class Symbols:
    """The symbols of some texts' words: names, lengths in words, contexts [left, right), and texts."""

    def __init__(self, word_names: np.ndarray, by_text: np.ndarray):
        n = len(word_names)
        self.name, self.length = word_names, np.ones(n, np.int64)
        self.left, self.right = np.arange(n), np.arange(1, n + 1)
        self.text = np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
        self.by_text = by_text

    def _beside(self) -> np.ndarray:
        """Whether each symbol but the last has its right neighbour in its text."""
        return self.text[1:] == self.text[:-1]

    def _outer(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of the neighbours left of ``first`` and right of ``last``; beyond a text's ends a place outside of it."""
        n = len(self.name)
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        left = np.where((first > 0) & (self.text[before] == self.text[first]), self.left[before], self.by_text[self.text[first]] - 1)
        right = np.where((last < n - 1) & (self.text[after] == self.text[last]), self.right[after], self.by_text[self.text[last] + 1] + 1)
        return left, right

    def runs(self) -> None:
        """Names the runs of one symbol of at most CAP words in all."""
        n = len(self.name)
        first = np.ones(n, bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | ~self._beside()
        start = np.flatnonzero(first)
        times = np.diff(start, append=n)
        end = start + times - 1
        whole = times * self.length[start]
        merged = (times > 1) & (whole <= CAP)
        open_ = 2 * self.length[start] <= CAP  # could be in a run that is named: then the neighbours matter
        left, right = self._outer(start, end)
        run_left = np.where(open_, np.minimum(self.left[start], left), self.left[start])
        run_right = np.where(open_, np.maximum(self.right[end], right), self.right[end])
        run = np.repeat(np.arange(len(start)), times)
        keep = first | ~merged[run]
        of = run[keep]
        named = merged[of]
        name = self.name[keep]
        name[named] = mix(name[named] ^ _RUN, times[of][named].astype(np.uint64))
        self.length = np.where(named, whole[of], self.length[keep])
        self.left = np.where(open_[of], run_left[of], self.left[keep])
        self.right = np.where(open_[of], run_right[of], self.right[keep])
        self.name, self.text = name, self.text[keep]

    def pairs(self, level: int) -> None:
        """Names the pairs of a left and a right symbol of at most CAP words together."""
        n = len(self.name)
        right_side = (mix(self.name ^ _SIDE, np.uint64(level)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        joins = ~right_side[:-1] & right_side[1:] & self._beside() & (self.length[:-1] + self.length[1:] <= CAP)
        head, tail = np.zeros(n, bool), np.zeros(n, bool)
        head[:-1], tail[1:] = joins, joins
        at = np.arange(n)
        left, right = self._outer(at, at)
        alone = ~head & ~tail & (self.length < CAP)
        new_left = np.where(alone & right_side, np.minimum(self.left, left), self.left)
        new_right = np.where(alone & ~right_side, np.maximum(self.right, right), self.right)
        h = np.flatnonzero(head)
        new_left[h] = np.minimum(self.left[h], self.left[h + 1])
        new_right[h] = np.maximum(self.right[h], self.right[h + 1])
        name, length = self.name.copy(), self.length.copy()
        name[h], length[h] = mix(self.name[h], self.name[h + 1]), self.length[h] + self.length[h + 1]
        keep = ~tail
        self.name, self.length, self.left, self.right, self.text = name[keep], length[keep], new_left[keep], new_right[keep], self.text[keep]

    def recompress(self) -> Symbols:
        for level in range(ROUNDS if len(self.name) else 0):
            self.runs()
            self.pairs(level)
        self.phrases()
        return self

    def phrases(self) -> None:
        """The last level: rows of symbols of PHRASE words or more that begin at a symbol of one half of the names."""
        n = len(self.name)
        end = np.cumsum(self.length)
        start = end - self.length
        first = np.flatnonzero((mix(self.name ^ _SIDE, _RUN) >> np.uint64(33) & np.uint64(1)).astype(bool))
        last = np.searchsorted(end, start[first] + PHRASE)
        inside = last < n
        first, last = first[inside], last[inside]
        inside = self.text[last] == self.text[first]
        first, last = first[inside], last[inside]
        name, left, right = self.name[first], self.left[first], self.right[first]
        more, k = np.arange(len(first)), 1
        while len(more := more[first[more] + k <= last[more]]):
            at = first[more] + k
            name[more] = mix(name[more], self.name[at])
            left[more], right[more] = np.minimum(left[more], self.left[at]), np.maximum(right[more], self.right[at])
            k += 1
        self.name, self.left, self.right, self.text = name, left, right, self.text[first]
        self.length = end[last] - start[first]


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, lens, by_text = split_words(data, offsets)
    return xxh64(padded(data), starts, lens, 0), by_text


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... base^n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def window_names(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of two polynomial hashes of each window of words."""
    out = []
    with np.errstate(over="ignore"):
        for k, base in enumerate(_BASES):
            power, inverse = (_powers(x, len(names)) for x in (base, pow(base, -1, 1 << 64)))
            x = mix(names, _SECOND) if k else names
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)])
            out.append((upto[window:] - upto[:-window]) * inverse[: len(names) - window + 1])
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def candidates(symbols: Symbols, shared: np.ndarray, window: int) -> np.ndarray:
    """The starts of the windows that hold no context of a symbol that isn't ``shared``."""
    total = int(symbols.by_text[-1])
    telling = ~shared & (symbols.right - symbols.left <= window)
    out = np.zeros(total + 2, np.int64)
    np.add.at(out, np.maximum(symbols.right[telling] - window, 0), 1)
    np.add.at(out, symbols.left[telling] + 1, -1)
    free = np.cumsum(out)[:total] == 0
    lens = np.diff(symbols.by_text)
    room = np.arange(total) + window <= np.repeat(symbols.by_text[1:], lens)
    return np.flatnonzero(free & room)


def _ordered(doc_id: str = "doc_id") -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID))


def _same_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, __pw_key, n, gone): all documents; gone are those of a window or more whose words are all those of a document with a smaller doc_id."""
    w = words(F.col("text"))
    text = docs.select("doc_id", row_key().alias(ROW_KEY), F.size(w).cast("long").alias("n"), F.xxhash64(w).alias("a"), F.xxhash64(F.lit(1), w).alias("b"))
    text = stored(text, "sequences")
    first = text.filter(F.col("n") >= window).groupBy("a", "b", "n").agg(F.min(_ordered()).alias("first"), F.max(_ordered()).alias("last"), F.count("*").alias("weight"))
    first = stored(first.filter("first < last").drop("last"), "firsts")
    later = stored(joined_by_weight(text, first, ["a", "b", "n"], "weight").filter(_ordered() > F.col("first")).select("doc_id", ROW_KEY, "n").distinct(), "later")
    found = later.select(F.col("doc_id").alias("__pw_id"), F.col(ROW_KEY).alias("__pw_key2"))
    same = (F.col(ROW_KEY) == F.col("__pw_key2")) & F.col("doc_id").eqNullSafe(F.col("__pw_id"))
    maybe = Bloom(later, ROW_KEY).may_contain(F.col(ROW_KEY))
    asked = text.filter(maybe).join(found, same, "left").select("doc_id", ROW_KEY, "n", F.col("__pw_key2").isNotNull().alias("gone"))
    return stored(text.filter(~maybe).select("doc_id", ROW_KEY, "n", F.lit(False).alias("gone")).unionByName(asked), "same")


def _shared_names(docs: DataFrame, window: int) -> DataFrame:
    """(name): the high-level symbols found in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            s = Symbols(*word_names(data, offsets)).recompress()
            some = (np.diff(s.by_text)[s.text] >= window) & (s.right - s.left <= window)
            ids = batch.column(0).to_numpy()
            pair = np.unique(np.rec.fromarrays([s.name[some], ids[s.text[some]]])) if some.any() else None
            if pair is not None:
                yield pa.RecordBatch.from_arrays([pa.array(pair.f0.copy().view(np.int64)), pa.array(pair.f1.copy())], names=["name", "id"])

    found = docs.select(_ordered().alias("id"), "text").mapInArrow(run, "name long, id long")
    return found.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("name")


def _by_document(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row per document with the sorted list of its starts; the other columns keep it apart from windows."""
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    cuts = np.append(np.flatnonzero(new), len(ids)).astype(np.int32)
    ids, keys = ids[new], keys[new]
    zero = np.zeros(len(ids), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(zero), pa.array(ids), pa.array(keys), pa.array(zero), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at))], names=_COLUMNS)


def _settled(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """What a task knows of its windows: those with a smaller doc_id in the task itself are later ones already, as
    lists by document; of each name only the windows with the smallest doc_id go on."""
    if not held:
        return
    a, b, ids, keys, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, a))
    a, b, ids, keys, at = a[order], b[order], ids[order], keys[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (b == b[head]) & (ids > ids[head])
    go = np.flatnonzero(~later)
    for lo in range(0, len(go), 100_000):
        i = go[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(a[i].view(np.int64)), pa.array(b[i].view(np.int32)), pa.array(ids[i]), pa.array(keys[i]), pa.array(at[i]), pa.nulls(len(i), pa.list_(pa.int32()))], names=_COLUMNS)
    if later.any():
        yield _by_document(ids[later], keys[later], at[later])


def repeats(docs: DataFrame, window: int = 50, most_log2_bits: int = 28) -> DataFrame:
    """(doc_id, __pw_key, starts): per document the sorted starts of its windows that also start in a document with a smaller doc_id."""
    probes = 3
    shared_names = stored(_shared_names(docs, window), "names")
    log2_bits = min(most_log2_bits, max(16, (10 * shared_names.count()).bit_length()))
    filled = Bloom(shared_names, "name", log2_bits, probes).table.first()["bits"]
    bits = docs.sparkSession.sparkContext.broadcast(np.array(filled, np.int64).view(np.uint64))

    def shared(names: np.ndarray) -> np.ndarray:
        b, found = bits.value, np.ones(len(names), bool)
        low, high = names & np.uint64(0xFFFFFFFF), names >> np.uint64(32) | np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(probes):
                at = low + high * np.uint64(j) & np.uint64((1 << log2_bits) - 1)
                found &= (b[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch, data, offsets in chunks(batches):
            names, by_text = word_names(data, offsets)
            if len(names) < window:
                continue
            s = Symbols(names, by_text).recompress()
            at = candidates(s, shared(s.name), window)
            if not len(at):
                continue
            a, b = window_names(names, window)
            text = np.searchsorted(by_text, at, "right") - 1
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append((a[at], b[at], ids[text], keys[text], (at - by_text[text]).astype(np.int32)))
            if sum(len(x[0]) for x in held) > HELD_WINDOWS:
                yield from _settled(held)
                held = []
        yield from _settled(held)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by name and doc_id, so the first of a name has its smallest doc_id, also across batches."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ids, keys, at = (batch.column(k).to_numpy() for k in range(5))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = last is None or last[:2] != (a[0], b[0])
            group = np.cumsum(new) - 1
            first = ids[new] if new[0] else np.concatenate([[last[2]], ids[new]])
            first = first[group if new[0] else group + 1]
            last = (a[-1], b[-1], first[-1])
            sent = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            later = np.flatnonzero((ids > first) & ~sent)
            yield _by_document(ids[later], keys[later], at[later]).select(["id", ROW_KEY, "starts"])
            if sent.any():
                yield batch.filter(pa.array(sent)).select(["id", ROW_KEY, "starts"])

    schema = f"a long, b int, id long, {ROW_KEY} long, at int, starts array<int>"
    found = docs.select(_ordered().alias("id"), row_key().alias(ROW_KEY), "text").mapInArrow(run, schema)
    later = found.repartition("a", "b").sortWithinPartitions("a", "b", "id").mapInArrow(judged, f"id long, {ROW_KEY} long, starts array<int>")
    starts = later.groupBy("id", ROW_KEY).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    return starts.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), ROW_KEY, "starts")


def _spans(starts: Column, window: int) -> Column:
    """The maximal spans of words (first, after the last) that sorted window starts cover."""

    def cut(s: Column) -> Column:
        one, w = F.lit(1), F.lit(window)
        index = F.sequence(F.lit(0), F.size(s) - one)
        head = F.filter(index, lambda i: F.coalesce(F.get(s, i) - F.get(s, i - one) > w, F.lit(True)))
        tail = F.filter(index, lambda i: F.coalesce(F.get(s, i + one) - F.get(s, i) > w, F.lit(True)))
        return F.zip_with(head, tail, lambda i, j: F.struct(F.get(s, i).alias("first"), (F.get(s, j) + w).alias("after")))

    return F.get(F.transform(F.array(starts), cut), F.lit(0))


def deduplicate(docs: DataFrame, window: int = 50, most_log2_bits: int = 28) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept: the words that are left, joined by one space."""
    judged = _same_words(docs, window)
    rest, same = drop_rows(docs.select("doc_id", "text"), judged.select("doc_id", ROW_KEY, "gone")), judged.filter("gone")
    spans = repeats(rest, window, most_log2_bits).select("doc_id", ROW_KEY, _spans(F.col("starts"), window).alias("spans"))
    all_of = F.array(F.struct(F.lit(0).alias("first"), F.col("n").cast("int").alias("after")))
    removed = stored(spans.unionByName(same.select("doc_id", ROW_KEY, all_of.alias("spans")).dropDuplicates(["doc_id", ROW_KEY])), "removed")
    removed = removed.withColumnsRenamed({"doc_id": "d_id", ROW_KEY: "d_key"})
    bloom = Bloom(removed.select("d_key"), "d_key")
    keyed = docs.select("doc_id", "text", row_key().alias(ROW_KEY))
    asked = bloom.may_contain(F.col(ROW_KEY))
    whole = keyed.filter(~asked).select("doc_id", words(F.col("text")).alias("w"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("array<string>").alias("left"))
    held = keyed.filter(asked).join(removed, (F.col(ROW_KEY) == F.col("d_key")) & F.col("doc_id").eqNullSafe(F.col("d_id")), "left")
    held = held.select("doc_id", words(F.col("text")).alias("w"), F.coalesce("spans", F.array().cast("array<struct<first:int,after:int>>")).alias("spans"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["after"] - s["first"])

    def between(k: Column) -> Column:
        """The words between the k-th span and the one before."""
        begin = F.coalesce(F.get("spans", k - 1)["after"], F.lit(0))
        return F.slice("w", begin + 1, F.coalesce(F.get("spans", k)["first"], F.size("w")) - begin)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), between))
    held = held.select("doc_id", "w", gone.alias("n_removed"), F.when(gone > 0, left).alias("left"))
    return whole.unionByName(held).select("doc_id", F.size("w").cast("long").alias("n_words"), "n_removed", F.array_join(F.coalesce("left", "w"), " ").alias("kept"))
