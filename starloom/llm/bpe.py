"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are split into pre-tokens by the tokenizer's pattern. A pre-token's bytes are merged by rank,
lowest first and leftmost of equals, with a queue made for very long pre-tokens: each rank has a
bucket of positions in a linked list of pieces, and a hierarchical bitmap over the ranks finds the
next rank that has any in a few find-first-set steps. Entries whose pair has changed since are
skipped. Every merge costs a handful of steps, whatever the length.

Pre-tokens repeat heavily, so their ids are kept in a table of bounded size for each worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens and their ids that a worker keeps. A full table makes way for a new one, which takes
#: over from it what is met again; so at most twice as many are held.
KEPT = 200_000
#: Longer pre-tokens aren't kept.
KEPT_LENGTH = 64


#: Ids that three levels of 64 reach.
LARGEST = 64**3


class RankBitmap:
    """A set of numbers below LARGEST with find-first: words of 64 bits, and two levels above that
    have a bit for each word that isn't empty."""

    def __init__(self):
        self.low, self.middle, self.top = [0] * 64**2, [0] * 64, [0]

    def add(self, x: int) -> None:
        i = x >> 6
        self.low[i] |= 1 << (x & 63)
        self.middle[i >> 6] |= 1 << (i & 63)
        self.top[0] |= 1 << (i >> 6)

    def discard(self, x: int) -> None:
        i = x >> 6
        self.low[i] &= ~(1 << (x & 63))
        if not self.low[i]:
            self.middle[i >> 6] &= ~(1 << (i & 63))
            if not self.middle[i >> 6]:
                self.top[0] &= ~(1 << (i >> 6))

    def first(self) -> int:
        """The smallest number, or -1."""
        w = self.top[0]
        if not w:
            return -1
        x = (w & -w).bit_length() - 1
        w = self.middle[x]
        x = (x << 6) | ((w & -w).bit_length() - 1)
        w = self.low[x]
        return (x << 6) | ((w & -w).bit_length() - 1)


def ascii_pattern(pattern: str) -> str | None:
    """The pattern as it reads on texts of ASCII characters only; None if it names other classes than
    letters, numbers and white space. The standard library matches it over twice as fast."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain else plain


class Encoder:
    def __init__(self, path: str, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.split = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.split_ascii = re.compile(plain, re.ASCII).findall if plain else self.split
        if max(self.ranks.values()) >= LARGEST:
            raise ValueError(f"ids must be below {LARGEST}")
        self.queue = RankBitmap()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was kept before the table filled up

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The steps of RankBitmap are written out where they are taken: they
        run several times a byte."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # pieces are a linked list over byte positions: piece i ends where piece after[i] starts
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts at i, as it is now
        buckets: dict[int, list[int]] = {}
        low, middle, top = self.queue.low, self.queue.middle, self.queue.top

        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise: a heap already
                else:
                    buckets[rank] = [i]
                    w = rank >> 6
                    low[w] |= 1 << (rank & 63)
                    middle[w >> 6] |= 1 << (w & 63)
                    top[0] |= 1 << (w >> 6)
        while bits := top[0]:
            w = (bits & -bits).bit_length() - 1
            bits = middle[w]
            w = (w << 6) | ((bits & -bits).bit_length() - 1)
            bits = low[w]
            bit = bits & -bits
            rank = (w << 6) | (bit.bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)  # leftmost
            else:
                i = bucket[0]
                del buckets[rank]
                bits ^= bit
                low[w] = bits
                if not bits:
                    bits = middle[w >> 6] ^ (1 << (w & 63))
                    middle[w >> 6] = bits
                    if not bits:
                        top[0] ^= 1 << (w >> 6)
            if pair[i] != rank:  # stale
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            pair[j] = -1
            for a, b in ((before[i], k), (i, after[k] if k < n else -1)):
                if a < 0:
                    continue
                rank = rank_of(piece[a:b]) if b >= 0 else None
                if rank is None:
                    pair[a] = -1
                    continue
                pair[a] = rank
                if rank in buckets:
                    heappush(buckets[rank], a)
                else:
                    buckets[rank] = [a]
                    w = rank >> 6
                    low[w] |= 1 << (rank & 63)
                    middle[w >> 6] |= 1 << (w & 63)
                    top[0] |= 1 << (w >> 6)
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return ids

    def _ids(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = array("i", self.merge(token.encode("utf-8", "replace"))).tobytes()
        if len(token) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[token] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        tokens = self.split_ascii(text) if text.isascii() else self.split(text)
        parts = list(map(self.kept.get, tokens))
        if None in parts:
            parts = [self._ids(t) if p is None else p for t, p in zip(tokens, parts)]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_corpus(
    docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", carry: list[str] = ()
) -> DataFrame:
    """``doc_id, ids`` and the ``carry`` columns: one row for each document, ids without special tokens.

    Null and empty texts have no ids: an empty list. Strings of special tokens are ordinary text.
    ``path`` names the vocabulary file (rank lines) on every executor; without it each worker looks the
    public one up for itself.
    """
    seen_here = path or default_path()
    names = [doc_id, "ids", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            there = path or default_path()
        except ImportError:  # a worker without the lookup has the file where the driver has it
            there = seen_here
        encode = encoder(there).encode_bytes
        for batch in batches:
            parts = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            flat = np.frombuffer(b"".join(parts), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *batch.columns[2:]], names=names)

    rows = docs.select(F.col(doc_id), F.col(text), *[F.col(c) for c in carry])
    types = dict(docs.dtypes)
    ddl = ", ".join([f"`{doc_id}` {types[doc_id]}", "ids array<int>", *[f"`{c}` {types[c]}" for c in carry]])
    return rows.mapInArrow(run, ddl)
