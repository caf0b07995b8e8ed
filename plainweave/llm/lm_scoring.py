"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

The corpus's training documents are those whose crc32(doc_id as text) mod 10 is not 0. Their unigrams and
bigrams (from the end token of the text before, as it were) are counted over all of them: summed in each task, then by hash.

The filter holds, of an n-gram of count c, its levels 1 to L = 1 + floor(log2 c), and those of the binary digits after the leading one that are
set: of a bigram the next ``DIGITS``, of a unigram all. A probe asks for level 1, 2, ... until one is missing, then for the digits; counts below 16, and all
counts of unigrams, come back exactly, others as the middle of the counts with these digits. Level 1 has so many bits that over a vocabulary of V words a context
meets few words by mistake, which the model allows for. All bits of an n-gram lie in one line of ``LINE`` bits, and the lines of a range of hashes are one block, so
tasks build blocks from the counts they hold. A probe compares six bits of one word. About half of the bits are set, whatever the size of the corpus: nothing is left out when it grows.

With P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), p(w | v) = (c(v w) + mu P(w)) / (c(v) + mu + F): what follows v adds up to c(v), and F is what
mistakes add to it over the vocabulary (from the bits that are set), so the probabilities add up to 1. mu is such that the unigram part
has, over all training tokens, the mass that bigrams seen once have (Good-Turing). A word or context not in training
is scored by P alone. ``score`` is the sum of log10 p over a text's tokens.

A filter of at most ``most_bytes`` (4 GB, what an executor's disk can be asked to hold) is sent to all workers as one file that they map. A larger one stays a table of blocks: each chunk of texts asks for its distinct
n-grams, the asks are shuffled to their blocks and the answers back.
Both ways read the same bits and give the same scores. What is shuffled grows with the texts, and no task holds more than a block or a chunk.

``base_score`` uses exact counts: those of the most frequent tokens (above a count that at most ``common`` tokens reach) are broadcast,
and all others are joined by hash. Tokens and bigrams are told apart by 64-bit hashes.

Nulls: a null text has the end token only, like an empty one; a null doc_id counts as an empty one (held out). Repeated rows are
documents of their own. Tokens of equal counts are treated alike. A long text is a chunk of its own; its tokens are arrays in one task. An empty table gives an empty result; without training documents N and V are 0.
Columns other than doc_id and text are not read, whatever their names. Bits depend on the number of shuffle partitions only in which mistakes they make; reruns agree.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainweave.llm.common import stored
from plainweave.llm.ragged import LOWER, chunks, mix, padded, split_words, tidy, xxh64
from plainweave.tables import discard, workspace

LINE, DIGITS, LEVELS = 4096, 3, 48
WORDS, BITS, MASKS = LINE // 64, 6, 4096
#: Probes of levels above 1 and of digits, by kind of n-gram (unigrams, bigrams). A probe is of BITS bits in a word of 64.
PROBES = (3, 2)
END = np.uint64(0x9E3779B97F4A7C15)
_BIGRAM = np.uint64(0xD1B54A32D192ED03)
_HELD_ROWS = 3_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 10 == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, an end after each text's words, and the number of tokens of each text."""
    low = LOWER[data]
    starts, lens, by_text = split_words(low, offsets)
    n = np.diff(by_text) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = xxh64(padded(low), starts, lens, 0)
    return out, n


def predecessors(h: np.ndarray) -> np.ndarray:
    """Each token's predecessor; the end token before a text's first."""
    return np.concatenate([[END], h[:-1]]) if len(h) else h


def bigram(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before ^ _BIGRAM, h)


@lru_cache(1)
def _masks() -> np.ndarray:
    """MASKS words of BITS bits each, by a rule: the first different ones that the number's hashes name."""
    out = np.zeros(MASKS, np.uint64)
    for step in range(40):
        place = mix(np.arange(MASKS, dtype=np.uint64), np.uint64(step)) & np.uint64(63)
        out |= np.where(np.bitwise_count(out) < BITS, np.uint64(1) << place, np.uint64(0))
    return out


class LogFrequencyFilter:
    """The words of some blocks, from ``first_block`` on. ``first_probes``: those of level 1."""

    def __init__(self, bits: np.ndarray, blocks: int, lines: int, first_probes: int, first_block: int = 0):
        self.bits, self.blocks, self.lines, self.first_probes, self.first_block = bits, blocks, lines, first_probes, first_block

    @staticmethod
    def block(h: np.ndarray, blocks: int) -> np.ndarray:
        """Blocks are ranges of hashes, a power of two in all."""
        return (h >> np.uint64(65 - blocks.bit_length())).astype(np.int64)

    def base(self, h: np.ndarray) -> np.ndarray:
        """The first word of each n-gram's line."""
        inner = (h << np.uint64(self.blocks.bit_length() - 1)) >> np.uint64(32)
        line = (inner * np.uint64(self.lines) >> np.uint64(32)).astype(np.int64)
        return ((self.block(h, self.blocks) - self.first_block) * self.lines + line) * WORDS

    @staticmethod
    def places(h: np.ndarray, tag: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram, the word within the line and the bits in it that a probe asks for."""
        g = mix(h, np.uint64(tag * 64 + probe // 3)) >> np.uint64(18 * (probe % 3))
        return (g & np.uint64(WORDS - 1)).astype(np.int64), _masks()[(g >> np.uint64(6) & np.uint64(MASKS - 1)).astype(np.int64)]

    def probes(self, tag: int, kind: int) -> int:
        return self.first_probes if tag == 1 else PROBES[kind]

    def put(self, h: np.ndarray, tag: int, kind: int) -> None:
        base = self.base(h)
        for probe in range(self.probes(tag, kind)):
            word, mask = self.places(h, tag, probe)
            np.bitwise_or.at(self.bits, base + word, mask)

    def holds(self, h: np.ndarray, base: np.ndarray, tag: int, kind: int) -> np.ndarray:
        """The places of those n-grams that have all bits of an entry."""
        at = np.arange(len(h))
        for probe in range(self.probes(tag, kind)):
            word, mask = self.places(h, tag, probe)
            ok = self.bits[base + word] & mask == mask
            if not ok.all():
                at, h, base = at[ok], h[ok], base[ok]
            if not len(at):
                break
        return at

    def counts(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The counts of some n-grams, as the filter has them."""
        base, level = self.base(h), np.zeros(len(h), np.int64)
        at = np.arange(len(h))
        for tag in range(1, LEVELS):
            at = at[self.holds(h[at], base[at], tag, kind)]
            if not len(at):
                break
            level[at] = tag
        out = np.where(level > 0, np.exp2(level - 1.0), 0.0)
        lowest = np.maximum(level - 1 - DIGITS, 0) if kind else np.zeros(len(h), np.int64)
        for digit in range(int(level.max(initial=0)) - 1):
            some = np.flatnonzero((level - 1 > digit) & (digit >= lowest))
            found = some[self.holds(h[some], base[some], LEVELS + digit, kind)]
            out[found] += float(1 << digit)
        return out + np.where(level > 0, (np.exp2(lowest) - 1) / 2, 0.0)


def _entries(c: np.ndarray, kind: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, places of the n-grams that have it) for n-grams of counts ``c``."""
    level = np.floor(np.log2(c)).astype(np.int64) + 1
    for tag in range(1, int(level.max(initial=0)) + 1):
        yield tag, np.flatnonzero(level >= tag)
    lowest = np.maximum(level - 1 - DIGITS, 0) if kind else np.zeros(len(c), np.int64)
    for digit in range(int(level.max(initial=0)) - 1):
        yield LEVELS + digit, np.flatnonzero((level - 1 > digit) & (digit >= lowest) & (c >> digit & 1).astype(bool))


class Numbers:
    """What the model needs beside the filter."""

    def __init__(self, total: int, distinct: int, mu: float, mistakes: float):
        self.total, self.distinct, self.mu, self.mistakes = total, distinct, mu, mistakes

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def probability(self, one: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """p(w | v) from the counts of w, v and v w."""
        known = (before > 0) & (one > 0)
        pair = np.where(known, np.minimum(pair, np.minimum(one, before)), 0.0)
        under = np.where(before > 0, before + self.mistakes, 0.0) + self.mu
        return (pair + self.mu * self.unigram(one)) / under


class Ask:
    """The distinct n-grams of some tokens, and what their counts say of each token."""

    def __init__(self, h: np.ndarray):
        self.one, back = np.unique(np.append(h, END), return_inverse=True)
        self.back, self.end = back[:-1], back[-1]
        self.pairs, self.again = np.unique(bigram(predecessors(h), h), return_inverse=True)

    def log10(self, numbers: Numbers, one: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        each = one[self.back]
        before = np.concatenate([[one[self.end]], each[:-1]]) if len(each) else each
        return np.log10(numbers.probability(each, before, pairs[self.again]))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], ranges: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct hashes of ``parts``, each sorted, and the sums of their counts: a range of hashes at a time, so that what the sums need is small beside the parts."""
    if not parts:
        return
    bounds = np.arange(1, ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length())
    cuts = [[0, *np.searchsorted(h, bounds), len(h)] for h, _ in parts]
    for k in range(ranges):
        h, c = (np.concatenate([part[i][at[k] : at[k + 1]] for part, at in zip(parts, cuts, strict=True)]) for i in (0, 1))
        if not len(h):
            continue
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        yield h[first], np.add.reduceat(c, first, dtype=np.int64)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        taught = [not held_out(i) for i in batch.column(0).to_pylist()]
        yield batch.filter(pa.array(taught, pa.bool_()))


def block_count(partitions: int) -> int:
    """How many blocks to cut the hashes into: more than tasks, so that these get even shares."""
    return max(1024, 1 << (4 * partitions - 1).bit_length())


def count(docs: DataFrame, partitions: int) -> DataFrame:
    """(block, kind, h, c): exact counts of the training documents' unigrams (kind 0) and bigrams (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                for h, c in _summed(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(c)], names=["kind", "h", "c"])
                parts.clear()

        rows = 0
        for _, data, offsets in chunks(_train_batches(batches)):
            h, _ = tokens(data, offsets)
            for kind, x in ((0, h), (1, bigram(predecessors(h), h))):
                keys, c = np.unique(x, return_counts=True)
                held[kind].append((keys, c.astype(np.int32)))
                rows += len(keys)
            if rows > _HELD_ROWS:
                yield from out()
                rows = 0
        yield from out()
        tidy()

    parts = docs.select("doc_id", "text").mapInArrow(run, "kind byte, h long, c long")
    block = F.shiftrightunsigned("h", 65 - block_count(partitions).bit_length()).cast("int").alias("block")
    # One shuffle, by block: the sums need no further one, and the stored files hold whole blocks.
    summed = parts.select(block, "kind", "h", "c").repartition(partitions, "block").groupBy("block", "kind", "h").agg(F.sum("c").alias("c"))
    out = stored(summed, "counts")
    docs.sparkSession._jvm.System.gc()  # lets Spark remove the files of this shuffle, the largest one, now that it is a table
    return out


def first_probes(distinct: int) -> int:
    """So many that a context meets few words by mistake over the vocabulary: a probe of six bits in a word half full finds them by chance once in 20 to 36 times."""
    return max(2, ceil(log(max(1, distinct) / 4) / log(30)))


def _probes(probes: int) -> Column:
    """How many bits a row of ``counts`` sets at most."""
    level = F.floor(F.log2("c")).cast("int")
    drop = F.when(F.col("kind") == 1, F.greatest(level - DIGITS, F.lit(0))).otherwise(F.lit(0))
    digits = F.bit_count(F.call_function("shiftright", F.col("c"), drop)) - 1
    return BITS * (F.lit(probes) + (level + digits) * F.when(F.col("kind") == 1, PROBES[1]).otherwise(PROBES[0]))


def build(counts: DataFrame, blocks: int, probes: int) -> tuple[DataFrame, int]:
    """(table of block, bits, mistakes; lines a block): the filter, each block made in the task that holds its counts. ``mistakes``: how often level 1 is found by chance, summed over the block's lines."""
    wanted = counts.agg(F.sum(_probes(probes))).first()[0] or 0
    lines = max(1, ceil(wanted / log(2) / (blocks * LINE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(made: LogFrequencyFilter) -> pa.RecordBatch:
            # Of each word, how many of the masks would be found in it, on average over a share of them; a probe meets any word of its line.
            some = _masks()[:64, None, None]
            chance = (made.bits.reshape(1, lines, WORDS) & some == some).mean(axis=(0, 2))
            return pa.RecordBatch.from_arrays([pa.array([made.first_block], pa.int32()), pa.array([made.bits.tobytes()], pa.binary()), pa.array([float((chance**probes).sum())])], names=["block", "bits", "mistakes"])

        now = None
        for batch in batches:
            block, kind, h, c = (batch.column(k).to_numpy() for k in range(4))
            key = block.astype(np.int64) * 2 + kind
            for idx in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(idx):
                    continue
                k, of, grams = int(block[idx[0]]), int(kind[idx[0]]), h[idx].view(np.uint64)
                if now is None or k != now.first_block:
                    if now is not None:
                        yield out(now)
                    now = LogFrequencyFilter(np.zeros(lines * WORDS, np.uint64), blocks, lines, probes, k)
                for tag, at in _entries(c[idx], of):
                    now.put(grams[at], tag, of)
        if now is not None:
            yield out(now)
        now = None
        tidy()

    made = counts.select("block", "kind", "h", "c").sortWithinPartitions("block", "kind").mapInArrow(run, "block int, bits binary, mistakes double")
    return stored(made, "filter"), lines


def sent(table: DataFrame, blocks: int, lines: int) -> str:
    """The filter as one file, which the driver writes block by block and workers map (``mapped``): in the shared folder if that is
    mounted as a file system, else sent to each executor once by ``SparkContext.addFile``."""
    spark = table.sparkSession
    folder, name = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark)), f"plainweave-lm-{uuid.uuid4().hex}"
    mounted = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    path = os.path.join(folder.toUri().getPath() if mounted else SparkFiles.getRootDirectory(), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    out = np.memmap(path, np.uint64, "w+", shape=(blocks, lines * WORDS))
    for row in table.select("block", "bits").toLocalIterator(prefetchPartitions=True):
        out[row["block"]] = np.frombuffer(row["bits"], np.uint64)
    out.flush()
    del out
    if mounted:
        return path
    spark.sparkContext.addFile(path)
    return name


def mapped(name: str) -> np.ndarray:
    """The words of a file that ``sent`` has made."""
    return np.memmap(name if os.path.isabs(name) else SparkFiles.get(name), np.uint64, "r").view(np.ndarray)


def good_turing(counts: DataFrame) -> float:
    """mu: over all training tokens the unigram part has the mass of the bigrams seen once."""
    single = counts.filter("kind = 1 AND c = 1").count()
    level = F.floor(F.log2("c") * 16)
    seen = counts.filter("kind = 0").groupBy(level.alias("level")).agg(F.sum("c").alias("sum"), F.count("*").alias("n")).collect()
    total, mean = np.array([float(r["sum"]) for r in seen]), np.array([r["sum"] / r["n"] for r in seen])
    low, high = 0.1, 1e6
    for _ in range(60):
        mu = (low * high) ** 0.5
        if (total * mu / (mean + mu)).sum() < single:
            low = mu
        else:
            high = mu
    return mu


def _scores(numbers: Numbers, known: tuple[np.ndarray, np.ndarray], ids: pa.Array, h: np.ndarray, n: np.ndarray, each: np.ndarray, row: int) -> pa.RecordBatch:
    """The rows of a chunk: sums by text of the score and of the frequent tokens' base, and the hashes of the other tokens."""
    keys, c = known
    text = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
    base = np.zeros(len(h))
    base[found] = np.log10(numbers.unigram(c[at[found]]))
    # The other tokens of each text, each once with how often it stands there.
    h, of = h[~found], text[~found]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    times = np.diff(np.flatnonzero(new), append=len(h))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(n)))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + len(n))), ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(n),
        pa.array(np.bincount(text[found], minlength=len(n))), pa.array(np.bincount(text, base, len(n))), pa.array(np.bincount(text, each, len(n))),
        pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[new].view(np.int64))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
    ], names=["row", "doc_id", "held_out", "n_tokens", "n_common", "base_common", "score", "rare", "times"])


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_common long, base_common double, score double, rare array<long>, times array<int>"


def _scored_by_file(docs: DataFrame, name: str, made: Callable[[np.ndarray], LogFrequencyFilter], numbers: Numbers, known) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = made(mapped(name)), TaskContext.get().partitionId() << 40
        for batch, data, offsets in chunks(batches):
            h, n = tokens(data, offsets)
            ask = Ask(h)
            one = bits.counts(ask.one, 0)
            yield _scores(numbers, known.value, batch.column(0), h, n, ask.log10(numbers, one, bits.counts(ask.pairs, 1)), row)
            row += len(n)
        tidy()

    return docs.mapInArrow(run, SCORED)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ...: of small or like numbers most of these are runs that compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(body: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _scored_by_blocks(docs: DataFrame, table: DataFrame, blocks: int, made: Callable[..., LogFrequencyFilter], numbers: Numbers, known, partitions: int) -> DataFrame:
    """Each chunk's distinct n-grams go to their blocks, and their counts come back to the chunk; hashes are sorted, so that the answers' order is theirs.

    What is left of a chunk, the place of each token among its distinct ones, goes the same way with any block and meets its answers after it, so texts are read once.
    """
    schema = "chunk long, kind byte, block int, body binary, ids array<long>, n array<long>"
    names = ["chunk", "kind", "block", "body", "ids", "n"]

    def rows(chunk: list[int], kind: int, block: list[int], body: list[bytes], ids=None, n=None) -> pa.RecordBatch:
        none = pa.nulls(len(chunk), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([kind] * len(chunk), pa.int8()), pa.array(block, pa.int32()), pa.array(body, pa.binary()), none if ids is None else pa.array([ids], pa.list_(pa.int64())), none if n is None else pa.array([n], pa.list_(pa.int64()))], names=names)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch, data, offsets in chunks(batches):
            h, n = tokens(data, offsets)
            ask = Ask(h)
            for kind, keys in ((0, ask.one), (1, ask.pairs)):
                block = LogFrequencyFilter.block(keys, blocks)
                parts = np.split(keys, np.flatnonzero(np.diff(block)) + 1)
                yield rows([at] * len(parts), kind, [int(x) for x in block[np.cumsum([0, *map(len, parts[:-1])])]], [_planes(np.diff(x, prepend=np.uint64(0))) for x in parts])
            yield rows([at], 2, [zlib.crc32(str(at).encode()) % blocks], [_planes(ask.back.astype(np.uint32))], batch.column(0).to_pylist(), n.tolist())
            at += len(n)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            at = 0
            for (block, kind), of in groupby(zip(*(batch.column(k).to_pylist() for k in (2, 1, 0, 3)), strict=True), lambda r: r[:2]):
                chunk, body = zip(*(r[2:] for r in of), strict=True)
                if kind < 0:
                    now = (block, made(np.frombuffer(body[0], np.uint64), block))
                elif kind < 2:
                    # A block answers all chunks of a batch at once.
                    each = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in body]
                    h = np.concatenate(each)
                    found = (now[1].counts(h, kind) if now and now[0] == block else np.zeros(len(h))).astype(float)
                    back = np.split(found, np.cumsum([len(x) for x in each])[:-1])
                    # A chunk takes its tokens' hashes from these answers, so they go back with the counts.
                    yield rows(list(chunk), kind, [block] * len(chunk), [(x if kind == 0 else b"") + _planes(y) for x, y in zip(body, back, strict=True)])
                else:
                    yield batch.slice(at, len(chunk))
                at += len(chunk)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        keys: list[np.ndarray] = []
        for batch in batches:
            for chunk, kind, _, body, ids, n in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if kind < 2:
                    half = len(body) // 2 if kind == 0 else 0
                    keys += [np.cumsum(_from_planes(body[:half], np.uint64), dtype=np.uint64)] if kind == 0 else []
                    held[kind].append(_from_planes(body[half:], float))
                    continue
                h, n = np.concatenate(keys)[_from_planes(body, np.uint32)], np.array(n, np.int64)
                one, pairs = (np.concatenate(held[k]) if held[k] else np.zeros(0) for k in (0, 1))
                yield _scores(numbers, known.value, pa.array(ids, pa.int64()), h, n, Ask(h).log10(numbers, one, pairs), chunk)
                held, keys = {0: [], 1: []}, []

    asked = docs.mapInArrow(asks, schema)
    bits = table.select(F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("byte").alias("kind"), "block", F.col("bits").alias("body"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("n"))
    found = asked.unionByName(bits).repartition(partitions, "block").sortWithinPartitions("block", "kind").mapInArrow(answers, schema)
    return found.repartition(partitions, "chunk").sortWithinPartitions("chunk", "kind", "block").mapInArrow(scores, SCORED)


def _frequent(words: DataFrame, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the tokens above a count that at most ``common`` reach, found by counting the tokens of like counts."""
    level = F.floor(F.log2("c") * 16).cast("int")
    held, above = 0, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > common:
            break
        above = r["level"]
    if above is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = words.filter(level >= above).toPandas()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def score(docs: DataFrame, common: int = 1 << 18, most_bytes: int = 1 << 32) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark: SparkSession = docs.sparkSession
    docs, partitions = docs.select("doc_id", "text"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, counts = block_count(partitions), count(docs, partitions)
    words = stored(counts.filter("kind = 0").select("h", "c"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    probes = first_probes(distinct)
    table, lines = build(counts, blocks, probes)
    by_chance = table.agg(F.coalesce(F.sum("mistakes"), F.lit(0.0))).first()[0] / (blocks * lines)
    numbers = Numbers(total, distinct, good_turing(counts), by_chance * distinct)
    discard(counts)
    known = spark.sparkContext.broadcast(_frequent(words, common))

    def made(bits: np.ndarray, block: int = 0) -> LogFrequencyFilter:
        return LogFrequencyFilter(bits, blocks, lines, probes, block)

    if blocks * lines * LINE // 8 <= most_bytes:
        rows = _scored_by_file(docs, sent(table, blocks, lines), made, numbers, known)
        discard(table)
    else:
        rows = _scored_by_blocks(docs, table, blocks, made, numbers, known, partitions)
    scored = stored(rows, "scored")
    one = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("n")))).join(words, "h", "left")
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * one).alias("base_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    joined = scored.drop("rare", "times").join(sums, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), "score",
    )
