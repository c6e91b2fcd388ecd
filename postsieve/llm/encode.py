"""Encoding of a corpus with a public byte-level BPE vocabulary.

Speculate and verify: a greedy longest match over the vocabulary proposes the
tokens of each word, and a vectorised check tests every adjacent pair of all
proposals of a batch at once. A proposal whose pairs are all compatible is the
encoding; only the other words are merged exactly, pair by pair in rank order.

Two adjacent tokens are compatible if, undoing the merges of both from the seam
outwards in reverse rank order, no merge across the seam would have come first.
A sequence of tokens that encode to themselves is the encoding of its bytes
exactly if all adjacent pairs are compatible.

Defined cases: null and empty texts give an empty list; special tokens are never
produced, their strings are ordinary text; lone surrogates, which UTF-8 cannot
hold, become U+FFFD; texts are encoded whole, however long. The path of the
vocabulary is a parameter; it must be readable on every worker. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.json"
MEMO_WORDS, MEMO_CHARS = 200_000, 40  # words kept per worker, and the longest kept
_NEVER = np.int64(1) << 40

#: Fixed value: the word pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the merge that made each token, and the lookup of merges by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        ids = model["vocab"]
        self.by_bytes = {bytes(letters[c] for c in t): i for t, i in ids.items() if all(c in letters for c in t)}
        n = max(ids.values()) + 1
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        rank = np.zeros(n, dtype=np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = ids[a + b]
            self.left[t], self.right[t], rank[t] = ids[a], ids[b], r + 1
            self.merge[(ids[a], ids[b])] = (r, t)
        self.rank = rank  # 0 for bytes, else 1 + position of the merge
        keys = self.left * n + self.right
        made = np.flatnonzero(rank > 0)
        order = np.argsort(keys[made])
        self._keys, self._ranks, self.n = keys[made][order], rank[made][order], n
        self.longest = max(map(len, self.by_bytes))
        self.byte_id = [self.by_bytes[bytes([b])] for b in range(256)]
        self.sound = self._sound()

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def _sound(self) -> np.ndarray:
        """Tokens that encode to themselves: the parts are sound and meet only by the token's own merge."""
        ok = np.ones(self.n, dtype=bool)
        made = np.flatnonzero(self.rank > 0)
        ok[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair: does it stand, with no merge across the seam before ``below`` (default: any)?"""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER) if below is None else below.astype(np.int64)
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            crossed = self.pair_rank(x, y) < lim
            out[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            ended = (rx == 0) & (ry == 0)
            go = ~(crossed | ended)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            # undo the later merge of the two; a merge across the seam then had to come before it.
            # Among equal ranks the left one happens first, so undoing the right one leaves its own rank possible on the left
            undo_x = rx > ry
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
            limit[live] = np.where(undo_x, rx, ry + 1)
        return out

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, table = [], 0, len(word), self.by_bytes
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = table.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first, with a heap over a linked list: n log n for a word of n bytes."""
        tok = [self.byte_id[b] for b in word]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = self.merge.get((tok[i], tok[i + 1]))
            if m:
                heap.append((m[0], i, tok[i], tok[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, t = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != x or j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = t, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                m = self.merge.get((t, tok[nxt[i]]))
                if m:
                    heapq.heappush(heap, (m[0], i, t, tok[nxt[i]], m[1]))
            if prv[i] >= 0:
                m = self.merge.get((tok[prv[i]], t))
                if m:
                    heapq.heappush(heap, (m[0], prv[i], tok[prv[i]], t, m[1]))
        return [t for t in tok if t >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, path: str = f"{TOKENIZERS}/{DEFAULT}", pattern: str = PATTERN):
        self.vocab = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}
        self.n_exact = 0

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct words."""
        v = self.vocab
        raw = [w.encode("utf-8", "replace") if w.isascii() else w.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode() for w in words]
        spec = [v.greedy(b) for b in raw]
        flat = np.fromiter((t for s in spec for t in s), dtype=np.int64)
        sizes = np.array([len(s) for s in spec])
        owner = np.repeat(np.arange(len(spec)), sizes)
        bad = np.zeros(len(spec), dtype=bool)
        if len(flat):
            np.logical_or.at(bad, owner, ~v.sound[flat])
            inner = owner[1:] == owner[:-1]
            a, b, o = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
            if len(a):
                # the same pair occurs in many words: each distinct one is checked once
                key, back = np.unique(a * v.n + b, return_inverse=True)
                fine = v.compatible(key // v.n, key % v.n)
                bad[o[~fine[back]]] = True
        for i in np.flatnonzero(bad):
            spec[i] = v.exact(raw[i])
        self.n_exact += int(bad.sum())
        return dict(zip(words, spec))

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        memo = self.memo
        fresh = {w for p in pieces for w in p if w not in memo}
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = {w for p in pieces for w in p}
        known = self.words(list(fresh)) if fresh else {}
        memo.update((w, t) for w, t in known.items() if len(w) <= MEMO_CHARS)
        out = []
        for p in pieces:
            ids: list[int] = []
            for w in p:
                ids += memo[w] if w in memo else known[w]
            out.append(ids)
        return out


def encode_column(df: DataFrame, key: str, text: str = "text", path: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """(key, ids array<int>): the token ids of each text."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            ids = enc.batch(b.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(op, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", path: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """(keys..., n_tokens bigint): the number of tokens of each text, 0 for null and empty ones."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            n = pa.array([len(x) for x in enc.batch(b.column(len(keys)).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), n], [*keys, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(op, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens bigint")
