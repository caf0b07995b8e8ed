"""Byte-level BPE ids of many texts at once, equal to those of the ``tokenizers`` library.

Texts of Latin-1 characters without apostrophes are cut into pieces by array
operations; only pieces not seen before go to the library. All other texts go to it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

from plainweave.llm.ragged import gather, padded, xxh64

_SLOW = re.compile(rb"['\x1c-\x1f\x85\xa0]")
_SEP = 0x1C
_KIND = np.array([1 if regex.fullmatch(r"\p{L}", c) else 2 if regex.fullmatch(r"\p{N}", c) else 0 if c.isspace() else 3 for c in map(chr, range(256))], np.uint8)
_KIND[_SEP] = 4
SLOTS = 1 << 20
MOST_PIECES = 1_500_000
#: The library gets so many characters at a time, or one longer text: it returns some hundred bytes of objects a token.
MOST_ASKED = 1 << 17


class Bpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.rows = np.zeros(0, np.int64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.slot_key, self.slot_row = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        upto = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MOST_ASKED, "right")))
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
            lo = hi
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        quick: list[int] = []
        raw: list[bytes] = []
        for i, t in enumerate(texts):
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if not _SLOW.search(b):
                quick.append(i)
                raw.append(b)
        if raw:
            for i, ids in zip(quick, self._quick(raw), strict=True):
                out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _quick(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\x1c".join(raw) + b"\x1c", np.uint8)
        kind = _KIND[data]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        # A blank run before a word: its last character joins the word if it is a space, else stands alone.
        words = np.flatnonzero(first[1:] & (kind[:-1] == 0) & (kind[1:] < 4)) + 1
        first[words[data[words - 1] == 0x20]] = False
        first[words - 1] = True
        first |= kind == 4
        starts = np.flatnonzero(first)
        lens = np.diff(starts, append=len(data))
        piece = data[starts] != _SEP
        ends = np.flatnonzero(~piece)
        per_text = np.diff(ends, prepend=-1) - 1
        starts, lens = starts[piece], lens[piece]
        rows = self._rows(data, starts, lens)
        n = self.n[rows]
        flat = self.ids[gather(self.at[rows], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        cuts = upto[np.cumsum(per_text)]
        return np.split(flat, cuts[:-1]) if len(raw) > 1 else [flat]

    def _rows(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Where each piece is in the store; new pieces are added."""
        if len(self.at) > MOST_PIECES:
            self._forget()
        h = xxh64(padded(data), starts, lens, 0)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        rows = np.where(self.slot_key[slot] == h, self.slot_row[slot], -1)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            keys, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pos = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = pos < len(self.keys)
            known[inside] = self.keys[pos[inside]] == keys[inside]
            new = np.flatnonzero(~known)
            if len(new):
                at = miss[where[new]]
                made = self.whole([data[s : s + n].tobytes().decode("latin-1") for s, n in zip(starts[at], lens[at], strict=True)])
                n = np.array([len(x) for x in made], np.int64)
                self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
                self.rows = np.insert(self.rows, pos[new], np.arange(len(self.n), len(self.n) + len(n)))
                self.keys = np.insert(self.keys, pos[new], keys[new])
                self.n = np.concatenate([self.n, n])
                self.ids = np.concatenate([self.ids, *made])
                pos = np.searchsorted(self.keys, keys)
            found = self.rows[pos]
            rows[miss] = found[back]
            s = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            free = self.slot_row[s] < 0
            self.slot_key[s[free]], self.slot_row[s[free]] = keys[free], found[free]
        return rows
