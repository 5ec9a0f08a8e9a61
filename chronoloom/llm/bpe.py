"""Byte-level BPE encoding of a corpus with a public vocabulary.

Two-tier lookup. A minimal perfect hash (hash and displace) over the vocabulary resolves every pre-token that is a
vocabulary entry with one probe; the others are merged by rank with a heap over linked bytes, in O(n log n) for a
pre-token of n bytes. The tables are built once on the driver from a vocabulary file of fixed size and broadcast;
texts are encoded where they lie, so the corpus is read once and never shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.arrow import bound_batches

#: Fixed value: the published pattern that splits text before the merges, with white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern on ASCII text.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+")
_MASK = (1 << 64) - 1
_TRIES = 32
#: Pre-tokens resolved at a time, and resolved pre-tokens kept by a worker; they bound memory and change no result.
GROUP, KEPT = 200_000, 500_000
VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDER = "/opt/tokenizers"


def read_vocabulary(path: str) -> list[bytes]:
    """Entries by rank of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n keys in n slots, two hashes and one displacement a probe."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        low = np.array([x & _MASK for x in h], np.uint64)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(h):
            groups[(x >> 64) % self.buckets].append(i)
        displacement = array("q", [0]) * self.buckets
        taken = np.zeros(n, bool)
        self.slots = array("i", [0]) * n
        free = iter(())
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            g = groups[b]
            if not g:
                break
            if len(g) == 1:  # a single key takes any free slot, written as -slot - 1
                s = next(free, None)
                if s is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                    s = next(free)
                displacement[b] = -s - 1
                self.slots[s] = g[0]
                continue
            d = 1
            while True:  # a row per displacement, a column per key
                at = self._mix_many(low[g], np.arange(d, d + _TRIES, dtype=np.uint64)) % np.uint64(n)
                ok = ~taken[at].any(axis=1)
                ok[ok] = [len(set(x)) == len(g) for x in at[ok].tolist()]
                if ok.any():
                    break
                d += _TRIES
            row = int(ok.argmax())
            displacement[b] = d + row
            for i, s in zip(g, at[row].tolist()):
                taken[s] = True
                self.slots[s] = i
        self.displacement = displacement

    @staticmethod
    def _mix_many(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The same as _mix, for all pairs."""
        x = h[None, :] ^ (d[:, None] * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    @staticmethod
    def _mix(h: int, d: int) -> int:
        x = ((h & 0xFFFFFFFFFFFFFFFF) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 32)

    def index(self, key: bytes) -> int:
        """The only index that `key` can have; the caller compares the key there."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.displacement[(h >> 64) % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._mix(h, d) % self.n]


class Encoder:
    """Encodes texts; `vocabulary` has the entries by rank, all 256 single bytes among them."""

    def __init__(self, vocabulary: list[bytes], hashed: PerfectHash | None = None) -> None:
        import regex

        self.vocabulary = vocabulary
        self.hashed = hashed or PerfectHash(vocabulary)
        self.ranks = {t: i for i, t in enumerate(vocabulary)}
        self.split = regex.compile(PATTERN)
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges neighbours by least rank, the leftmost first among equals."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into its left neighbour
        before = list(range(-1, n))  # start of the part on the left
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            before[e] = i
            if e < n and end[e]:
                r = ranks.get(piece[i : end[e]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0:
                r = ranks.get(piece[p:e])
                if r is not None:
                    heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token: one probe of the perfect hash, else merges."""
        piece = token.encode("utf-8", "surrogatepass")
        i = self.hashed.index(piece)
        return (i,) if self.vocabulary[i] == piece else self.merge(piece)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, some at a time."""
        split = _ASCII if text.isascii() else self.split
        if len(text) < 4 * GROUP:
            yield split.findall(text)
            return
        found = (m.group() for m in split.finditer(text))
        while some := list(islice(found, GROUP)):
            yield some

    def encode_into(self, text: str, out: array) -> None:
        for tokens in self.pieces(text):
            kept = self.kept
            if len(kept) > KEPT:
                kept.clear()
            for t in set(tokens).difference(kept):
                kept[t] = self.resolve(t)
            out.extend(chain.from_iterable(map(kept.__getitem__, tokens)))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


_ENCODERS: dict[int, Encoder] = {}


def _encode_batches(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(tables.id) or _ENCODERS.setdefault(tables.id, Encoder(*tables.value))
        for b in batches:
            ids, offsets, done = array("i"), [0], 0
            texts = b.column(1)
            for i in range(len(texts)):
                text = texts[i].as_py()
                if text:
                    enc.encode_into(text, ids)
                offsets.append(len(ids))
                if len(ids) > 10 * GROUP or i == len(texts) - 1:
                    values = pa.array(np.frombuffer(ids, np.int32)) if len(ids) else pa.array([], pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, i + 1 - done), lists], names=["doc_id", "ids"])
                    ids, offsets, done = array("i"), [0], i + 1

    return run


class _Tables:
    """A broadcast with an id that tells a worker's encoders apart."""

    def __init__(self, broadcast, key: int) -> None:
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def encode_corpus(documents: DataFrame, vocabulary: str = f"{FOLDER}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (list of integers) of every row, without special tokens.

    Null and empty texts give the empty list; strings of special tokens in a text are ordinary text; rows that repeat
    come out as often as they go in, with a null id too; no rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    entries = read_vocabulary(vocabulary)
    shipped = spark.sparkContext.broadcast((entries, PerfectHash(entries)))
    key = xxhash.xxh3_64_intdigest(b"\0".join(entries))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(_Tables(shipped, key)), "doc_id long, ids array<int>")
