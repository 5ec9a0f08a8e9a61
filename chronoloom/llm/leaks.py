"""Evaluation items that leaked into a corpus, fully or partly.

SimHash of windows, multi-index Hamming blocks, exact check. Items and texts are cut into windows of a few words; a
window's fingerprint takes, bit by bit, the majority of its words' hashes. An item leaks in parts, so the windows
are sized to the smallest part that must be found (a run of WINDOW clean words), not to the whole item, whose
fingerprint says nothing about a third of it. Fingerprints are indexed by RADIUS + 1 blocks of bits: two that differ
in at most RADIUS bits agree in one block, so every window within the radius is found. Beside them, runs of SEED equal
words are looked up, so that stretches whose slips leave no clean window have a candidate too. Candidates are then aligned
word by word from the matching windows and runs, over slips in single words. Where other words stand in place of the item's,
the weighted similarity of the stretch (words that many items have weigh little) tells a copy from a sentence of the same
shape. The share of the item's own words (weight 0 for wording that many items share) in stretches of STRETCH or more
decides.

The items are a stated query set: up to ITEMS of them are indexed and broadcast together, each text is read once where
it lies, and nothing but the found rows leaves a task. More items take a pass for each ITEMS of them.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.arrow import bound_batches

WINDOW = 5
#: Equal words in a row that make a candidate: one slip in a stretch of 8 leaves four, slips in every fourth word three.
SEED = 3
RADIUS = 3
STRETCH = 8
SHARE = 1 / 3
#: A shingle found in at least this share of the items (and in MANY items) is shared wording.
SHARED, MANY = 0.05, 8
#: Items searched for in one pass over the corpus.
ITEMS = 100_000
#: Stretches in which other words stand between runs of SEED equal words count if they are this long and this similar.
LONG, SIMILAR = 2 * STRETCH, 0.6
#: Words fingerprinted at a time; bounds memory, not the result.
CHUNK = 200_000

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile("[-\u00ad\u2010\u2011][ \\t]*\\r?\\n\\s*(?=\\w)")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
#: Marks and invisible characters that take no part in a word: format characters, combining marks, variation selectors.
_DROP = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")


def words(text: str | None) -> list[str]:
    """Words in their plain form: entities, tags, case, character forms, marks, hyphens at line ends and invisible characters undone."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _BREAK.sub("", text)
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def _hashes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    for w in set(ws).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every window of `window` (odd) words: bit by bit the majority of the words' hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    total = bits[:n].copy()
    for i in range(1, window):
        total += bits[i : i + n]
    return np.packbits(total > window // 2, axis=1).view(np.uint64).ravel()


def seeds(hashes: np.ndarray) -> np.ndarray:
    """A hash of every SEED words in a row."""
    n = max(0, len(hashes) - SEED + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SEED):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shared_shingles(passages: list[list[str]], share: float = SHARED, many: int = MANY) -> set[tuple[str, ...]]:
    """Shingles that stand in so many items that they are wording of the suite, not of an item: `share` of the items, `many` at least."""
    found = Counter()
    for ws in passages:
        found.update({tuple(ws[i : i + WINDOW]) for i in range(len(ws) - WINDOW + 1)})
    least = max(many, share * len(passages))
    return {s for s, n in found.items() if n >= least}


class ItemIndex:
    """Windows of items by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]], shared: set[tuple[str, ...]] | None = None) -> None:
        self.ids = [i for i, _ in items]
        vocabulary: dict[str, str] = {}
        self.words = [[vocabulary.setdefault(w, w) for w in words(p)] for _, p in items]
        held = Counter(w for ws in self.words for w in set(ws))
        #: Weight of each word of the items: low for words that many items have.
        self.weight = {w: math.log(1 + len(items) / n) for w, n in held.items()}
        shared = shared_shingles(self.words) if shared is None else shared
        self.own: list[np.ndarray] = []
        known: dict[str, int] = {}
        prints, item_of, at = [], [], []
        runs: list[tuple[np.ndarray, int, list[int]]] = []
        for k, ws in enumerate(self.words):
            own = np.ones(len(ws), bool)
            for i in range(len(ws) - WINDOW + 1):
                if tuple(ws[i : i + WINDOW]) in shared:
                    own[i : i + WINDOW] = False
            self.own.append(own)
            h = _hashes(ws, known)
            f = fingerprints(h)
            g = seeds(h)
            some = [i for i in range(len(g)) if own[i : i + SEED].any()]
            runs.append((g[some], k, some))
            keep = [i for i in range(len(f)) if own[i : i + WINDOW].any()]
            prints.append(f[keep])
            item_of += [k] * len(keep)
            at += keep
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.item_of, self.at = np.array(item_of, np.int32), np.array(at, np.int32)
        self.blocks = RADIUS + 1
        self.bits = 64 // self.blocks
        self.tables = []
        for b in range(self.blocks):
            part = self._part(self.prints, b)
            order = np.argsort(part, kind="stable").astype(np.int32)
            count = np.bincount(part, minlength=1 << self.bits).astype(np.int32)
            self.tables.append((order, count, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int32)))

        run = np.concatenate([g for g, _, _ in runs]) if runs else np.zeros(0, np.uint64)
        order = np.argsort(run, kind="stable")
        self.runs = run[order]
        self.run_item = np.array([k for _, k, some in runs for _ in some], np.int32)[order]
        self.run_at = np.array([i for _, _, some in runs for i in some], np.int32)[order]
        #: Low bits of the runs' hashes, to pass over most words of a text.
        self.mask = np.uint64((1 << max(20, (16 * len(self.runs)).bit_length())) - 1)
        self.run_bits = np.zeros(int(self.mask) + 1, bool)
        self.run_bits[(self.runs & self.mask).astype(np.int64)] = True

    def _part(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in `prints`, indexed window) within the radius."""
        left, right = [], []
        for b, (order, count, start) in enumerate(self.tables):
            part = self._part(prints, b)
            n = count[part]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            place = np.repeat(hit, n)
            first = np.repeat(start[part[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            window = order[first + np.arange(len(place))]
            ok = np.bitwise_count(prints[place] ^ self.prints[window]) <= RADIUS
            left.append(place[ok])
            right.append(window[ok])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(left), np.concatenate(right)

    def equal_runs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in the hashes of `seeds`, place in `runs`) that are equal."""
        hit = np.flatnonzero(self.run_bits[(hashes & self.mask).astype(np.int64)])
        lo, hi = np.searchsorted(self.runs, hashes[hit], "left"), np.searchsorted(self.runs, hashes[hit], "right")
        n = hi - lo
        place = np.repeat(hit, n)
        return place, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(place))


def similar(a: str, b: str) -> bool:
    """One edit apart: a letter more, less, other, or two neighbours swapped (two edits in words of nine letters or more)."""
    if a == b:
        return True
    most = 2 if min(len(a), len(b)) >= 9 else 1
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 2:
        return False
    i, la, lb = 0, len(a), len(b)
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    x, y = a[i:la], b[i:lb]
    if max(len(x), len(y)) <= 1 or (len(x) == len(y) == 2 and x == y[::-1]):
        return True
    return most == 2 and max(len(x), len(y)) <= 2


def _same(p: list[str], d: list[str], i: int, j: int, n: int, step: int) -> bool:
    """The next `n` words from i and j on are equal."""
    for k in range(n):
        a, b = i + step * k, j + step * k
        if not (0 <= a < len(p) and 0 <= b < len(d)) or p[a] != d[b]:
            return False
    return True


def _extend(p: list[str], d: list[str], i: int, j: int, step: int, others: int = 4, slips: list[int] | None = None) -> tuple[int, int]:
    """From (i, j) on in direction `step`, over equal words and slips in single words: the last place reached.

    Another word may stand in place of one between `others` equal words on either side (0: nowhere); the places of
    such words in the item are added to `slips`.
    """
    run = others
    while 0 <= i < len(p) and 0 <= j < len(d):
        a, b = p[i], d[j]
        if a == b:
            i, j, run = i + step, j + step, run + 1
            continue
        ni, nj = i + step, j + step
        two = (b + d[nj] if step > 0 else d[nj] + b) if 0 <= nj < len(d) else ""
        one = (a + p[ni] if step > 0 else p[ni] + a) if 0 <= ni < len(p) else ""
        if two and similar(a, two):
            i, j, run = ni, nj + step, 0
        elif one and similar(one, b):
            i, j, run = ni + step, nj, 0
        elif similar(a, b):
            i, j, run = ni, nj, 0
        elif _same(p, d, i, nj, 2, step):  # a word too many
            j, run = nj, 0
        elif _same(p, d, ni, j, 2, step):  # a word left out
            i, run = ni, 0
        elif others and run >= others and _same(p, d, ni, nj, others, step):  # another word in its place
            if slips is not None:
                slips.append(i)
            i, j, run = ni, nj, 0
        else:
            break
    return i - step, j - step


def similarity(p: list[str], left: int, right: int, slips: list[int], weight: dict[str, float]) -> float:
    """Weighted share of the item's words left..right that the text has too, those at `slips` being other words there.

    Words that many items have weigh little, so sentences of one shape with other names and numbers are not similar.
    """
    total = sum(weight[p[k]] for k in range(left, right + 1))
    return 1 - sum(weight[p[k]] for k in slips) / total if total else 0.0


def covered(p: list[str], d: list[str], anchors: list[tuple[int, int]], stretch: int = STRETCH, runs: Sequence[tuple[int, int]] = (), weight: dict[str, float] | None = None) -> np.ndarray:
    """Which words of the item `p` stand in the text `d` in stretches of `stretch` or more; anchors are equal windows (place in p, place in d).

    From `runs` of SEED equal words slips are passed over, and other words only where the stretch is LONG or longer and
    its weighted similarity at least SIMILAR: sentences of one shape with other names and numbers in it share such runs
    without being one another's copies.
    """
    out = np.zeros(len(p), bool)
    spans: list[tuple[int, int, int, int]] = []
    for i, j in sorted(set(anchors)):
        if any(a <= i <= b and c <= j <= e for a, b, c, e in spans[-8:]):
            continue
        # the window may hold the words in another order: start from a word that is equal
        k = next((k for k in range(WINDOW) if i + k < len(p) and j + k < len(d) and p[i + k] == d[j + k]), None)
        if k is None:
            continue
        right, down = _extend(p, d, i + k, j + k, 1)
        left, up = _extend(p, d, i + k, j + k, -1)
        spans.append((left, right, up, down))
        if right - left + 1 >= stretch:
            out[left : right + 1] = True
    for i, j in sorted(set(runs)):
        if any(a <= i <= b and c <= j <= e for a, b, c, e in spans[-8:]):
            continue
        slips: list[int] = []
        right, down = _extend(p, d, i, j, 1, SEED, slips)
        left, up = _extend(p, d, i, j, -1, SEED, slips)
        if not slips or weight is None or right - left + 1 < LONG or similarity(p, left, right, slips, weight) < SIMILAR:
            right, down = _extend(p, d, i, j, 1, 0)
            left, up = _extend(p, d, i, j, -1, 0)
        spans.append((left, right, up, down))
        if right - left + 1 >= stretch:
            out[left : right + 1] = True
    return out


def item_share(p: list[str], d: list[str], own: np.ndarray, anchors: list[tuple[int, int]], runs: Sequence[tuple[int, int]] = (), weight: dict[str, float] | None = None) -> float:
    """Share of the item's own words that stand in the text."""
    total = int(own.sum())
    return float((covered(p, d, anchors, runs=runs, weight=weight) & own).sum()) / total if total else 0.0


def leaks_in(texts: list[list[str]], index: ItemIndex, known: dict[str, int], share: float = SHARE) -> list[tuple[int, int, float]]:
    """(place in `texts`, place in the index, share) of all items found."""
    out = []
    flat = [w for ws in texts for w in ws]
    if len(flat) < WINDOW:
        return out
    starts = np.cumsum([0, *map(len, texts)])
    hashes = _hashes(flat, known)
    near = []
    for lo in range(0, len(flat) - SEED + 1, CHUNK):  # a single text may be longer than a chunk
        p, w = index.near(fingerprints(hashes[lo : lo + CHUNK + WINDOW - 1]))
        near.append((p + lo, index.at[w], index.item_of[w], np.full(len(p), WINDOW)))
        p, w = index.equal_runs(seeds(hashes[lo : lo + CHUNK + SEED - 1]))
        near.append((p + lo, index.run_at[w], index.run_item[w], np.full(len(p), SEED)))
    place, at, item, length = (np.concatenate(x) for x in zip(*near))
    text = np.searchsorted(starts, place, "right") - 1
    inside = place + length <= starts[text + 1]
    place, at, item, length, text = place[inside], at[inside], item[inside], length[inside], text[inside]
    order = np.lexsort((place, item, text))
    place, at, text, item, length = place[order], at[order], text[order], item[order], length[order]
    cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
        if lo == hi:
            continue
        t, k = int(text[lo]), int(item[lo])
        base = int(starts[t])
        near = list(zip(at[lo:hi].tolist(), (place[lo:hi] - base).tolist(), length[lo:hi].tolist()))
        anchors, runs = [(a, b) for a, b, n in near if n == WINDOW], [(a, b) for a, b, n in near if n == SEED]
        s = item_share(index.words[k], texts[t], index.own[k], anchors, runs, index.weight)
        if s >= share - 1e-9:
            out.append((t, k, s))
    return out


def _search(shipped, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shipped.value, {}
        for b in batches:
            ids, texts, size, found = [], [], 0, []
            col, doc = b.column(1), b.column(0)
            for i in range(len(col)):
                ws = words(col[i].as_py())
                ids.append(doc[i].as_py())
                texts.append(ws)
                size += len(ws)
                if size >= CHUNK or i == len(col) - 1:
                    found += [(ids[t], index.ids[k], s) for t, k, s in leaks_in(texts, index, known, share)]
                    ids, texts, size = [], [], 0
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for p in b.column(0):
            ws = words(p.as_py())
            out += {" ".join(ws[i : i + WINDOW]) for i in range(len(ws) - WINDOW + 1)}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["shingle"])


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id and the share of the item's own words found, one row per page and item.

    Null and empty texts and passages and null ids give no rows, nor do passages of fewer than STRETCH words, which no
    stretch can cover, and passages of wording that many items share only, of which no word counts; rows of `documents`
    that repeat give one row; every mirror of a page is found by itself; an empty table on either side gives no rows;
    other columns are ignored. Texts are read whole, whatever their length.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    items = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage")).distinct()
    n = items.count()
    # at most (words of an item) / SHARED shingles can be so frequent: a bound that doesn't grow with the items
    counts = items.select("passage").mapInArrow(_item_shingles, "shingle string").groupBy("shingle").count()
    shared = {tuple(r.shingle.split(" ")) for r in counts.where(F.col("count") >= max(MANY, SHARED * n)).toLocalIterator()}
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    blocks = max(1, -(-n // block))
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == i).orderBy("item_id", "passage")
        index = ItemIndex([(r.item_id, r.passage) for r in part.collect()], shared)
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(index), share), "doc_id long, item_id long, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
