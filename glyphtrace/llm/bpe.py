"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

Each merge rank owns a bucket of linked-list positions. A bitmap of two levels marks the buckets that
hold something: words of ranks, and a word of words, each about as wide as the square root of the
number of ranks. Find-first-set on both picks the next rank in a constant number of steps.
Entries whose pair has changed since they were queued are skipped. A pre-token of n bytes takes
O(n log n) whatever its length.

Cases: a null or empty text has no ids; invalid input cannot occur (Spark strings are UTF-8); equal
rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import documents, kept, map_arrow

#: Encoded pre-tokens kept per Python worker, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 1 << 19, 64


class RankQueue:
    """Positions by rank, taken by rank and then by position; empty again after every pre-token, so one serves all."""

    def __init__(self, ranks: int):
        self.shift = max(1, ((ranks - 1).bit_length() + 1) // 2)
        self.words = [0] * ((ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> self.shift
        self.words[word] |= 1 << (rank & ((1 << self.shift) - 1))
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        rank = (word << self.shift) | ((bits & -bits).bit_length() - 1)
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encoder and decoder over ranks of byte strings."""

    def __init__(self, vocabulary: bytes, pattern: str):
        pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size = max(self.ranks.values(), default=0) + 1
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.pieces = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        push, pop, buckets, words, shift = queue.push, queue.pop, queue.buckets, queue.words, queue.shift
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * (n + 1)
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while top := queue.top:
            word = (top & -top).bit_length() - 1  # find-first-set on both levels
            bits = words[word]
            rank = (word << shift) | ((bits & -bits).bit_length() - 1)
            if len(buckets[rank]) > 1:
                rank, i = pop()
            else:
                i = buckets.pop(rank)[0]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    queue.top = top & (top - 1)
            if pair[i] != rank:  # stale: one side was merged meanwhile
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                r = rank_of(piece[i : after[end]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
            left = before[i]
            if left >= 0:
                r = rank_of(piece[left:end])
                pair[left] = -1
                if r is not None:
                    pair[left] = r
                    push(r, left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Pre-tokens encoded before; emptied when full, so its size is bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker; the vocabulary is a file that every node has installed."""

    def make():
        with open(path, "rb") as f:
            return Codec(f.read(), pattern)

    return kept(__name__, (path, pattern), make)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again; digests of both, and with ``keep`` the ids themselves."""

    def run(batch):
        c, out = codec(path, pattern), {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        for text in batch.column("text").to_pylist():
            ids = c.encode(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            if keep:
                out["ids"].append(np.frombuffer(ids, "<u4").astype("int32"))
        return out | {"doc_id": batch.column("doc_id")}

    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep)
