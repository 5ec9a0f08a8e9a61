"""Leak search against brute force and on built cases."""

import random

import numpy as np
import pytest

from chronoloom.llm import leaks

ITEMS = "item_id long, passage string"
rng = random.Random(7)
WORDS = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]


def text(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_index_finds_all_within_the_radius():
    r = random.Random(1)
    index = leaks.ItemIndex([(i, text(40, r)) for i in range(30)])
    g = np.random.default_rng(1)
    flips = np.zeros(2000, np.uint64)
    for i in range(2000):
        for b in g.choice(64, g.integers(0, 6), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    probes = index.prints[g.integers(0, len(index.prints), 2000)] ^ flips
    got = set(zip(*map(np.ndarray.tolist, index.near(probes))))
    near = np.bitwise_count(probes[:, None] ^ index.prints[None, :]) <= leaks.RADIUS
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_plain_form():
    same = "If 56 gears, turn one kettle – above Punwurton"
    forms = ["IF 56 GEARS turn\none kettle above punwurton", "If&nbsp;56 gears turn one ket-\ntle above Pun­wurton", "If 56 ge​ars turn one kettle above Pu⁠nwurton", "<p>If 56 gears</p> turn one kettle above Punwurton", "Ｉｆ ５６ gears turn one kettle above Púnwurton"]
    for f in forms:
        assert leaks.words(f) == leaks.words(same)
    assert leaks.words(None) == leaks.words("") == leaks.words(" ​—") == []


@pytest.mark.parametrize("a,b,want", [("fence", "fecne", True), ("minutes", "mnutes", True), ("to", "toe", True), ("nuku", "nuuk", True), ("82", "41", False), ("kulge", "duru", False), ("baqui", "baqui", True)])
def test_slips(a, b, want):
    assert leaks.similar(a, b) is want and leaks.similar(b, a) is want


def slip(w, r):
    i = r.randrange(len(w))
    return r.choice([w[:i] + w[i + 1 :] or w, w[:i] + "e" + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :] if i else w])


def test_built_cases(spark):
    r = random.Random(3)
    wording = "Read the following passage carefully and then choose the one answer that fits it best."
    items = [(i, (wording + " " if i % 2 else "") + text(60, r)) for i in range(40)]
    docs, want = [], set()
    for d in range(300):
        around = [text(80, r), text(80, r)]
        i, p = r.choice(items)
        own = p.removeprefix(wording + " ").split()
        kind = d % 6
        if kind == 0:
            piece, hit = own, True
        elif kind == 1:
            piece, hit = own[10:36], True  # 26 of 60
        elif kind == 2:
            piece, hit = own[10:24], False  # 14 of 60
        elif kind == 3:
            piece, hit = [w if k % 9 else slip(w, r) for k, w in enumerate(own, 4)], True
        elif kind == 4:
            piece, hit = wording.split(), False
        else:
            piece, hit = [w for k in range(0, 60, 10) for w in (*own[k : k + 6], r.choice(WORDS), r.choice(WORDS), r.choice(WORDS))], False  # runs of six
        docs.append((d, around[0] + "\n" + " ".join(piece) + ". " + around[1]))
        if hit:
            want.add((d, i))
    docs += [(1000, docs[0][1]), (0, docs[0][1]), (2000, None), (2001, ""), (None, docs[0][1]), (2002, docs[0][1] + " " + text(300_000, r))]
    want |= {(1000, next(i for d, i in want if d == 0)), (2002, next(i for d, i in want if d == 0))}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as passage", "1 as item_id", "'x' as share").repartition(5)
    q = spark.createDataFrame([*items, items[0], (90, None), (91, ""), (92, "too short"), (None, items[1][1])], ITEMS).selectExpr("*", "passage as text")
    got = leaks.find_leaks(df, q).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    blocks = leaks.find_leaks(df, q, block=9).collect()
    assert {(x.doc_id, x.item_id) for x in blocks} == want and len(blocks) == len(want)
    assert leaks.find_leaks(df.limit(0), q).count() == 0 and leaks.find_leaks(df, q.limit(0)).count() == 0


@pytest.mark.parametrize("place", range(8))
@pytest.mark.parametrize("wrong", [lambda w: w[:2] + "x" + w[2:], lambda w: w[:2] + w[3:], lambda w: w[:2] + " " + w[2:]])
def test_a_slip_anywhere_in_eight_words(place, wrong):
    r = random.Random(place)
    items = [(i, text(24, r)) for i in range(20)]
    index = leaks.ItemIndex(items)
    part = items[5][1].split()[9:17]
    part[place] = wrong(part[place])
    page = leaks.words(f"{text(50, r)} {' '.join(part)} {text(50, r)}")
    assert [(t, k, s) for t, k, s in leaks.leaks_in([page], index, {})] == [(0, 5, pytest.approx(1 / 3))]


def test_sentences_of_one_shape_are_no_copies():
    index = leaks.ItemIndex([(1, "The gazax comet returns outside to Neskbriton every 94 years, though Fano painted 92 from the loose tables of Farana")])
    page = leaks.words("So the daxandy comet returns outside to Penuwick every 94 years though Taslus described 41 from the bright tables of Kiljol")
    assert leaks.leaks_in([page], index, {}) == []


def brute(doc, item, own, k=4):
    """Share of the item's own words in runs of eight or more equal words, by all pairs of places."""
    hit = np.zeros(len(item), bool)
    for i in range(len(item)):
        for j in range(len(doc)):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            if n >= leaks.STRETCH:
                hit[i : i + n] = True
    return (hit & own).sum() / max(1, own.sum())


def test_no_clean_leak_is_missed(spark, data):
    docs = [(r.doc_id, leaks.words(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "passage").collect()
    index = leaks.ItemIndex([(r.item_id, r.passage) for r in rows])
    found = {(docs[t][0], index.ids[k]) for t, k, _ in leaks.leaks_in([w for _, w in docs], index, {})}
    runs = {}
    for k, ws in enumerate(index.words):
        for i in range(len(ws) - 7):
            runs.setdefault(tuple(ws[i : i + 8]), set()).add(k)
    for d, ws in docs:
        near = {k for j in range(len(ws) - 7) for k in runs.get(tuple(ws[j : j + 8]), ())}
        for k in near:
            if brute(ws, index.words[k], index.own[k]) >= leaks.SHARE:
                assert (d, index.ids[k]) in found


@pytest.mark.parametrize("every,least", [(4, 0.95), (5, 0.95), (6, 0.95)])
def test_dense_slips(data, spark, every, least):
    """Another word in place of every fourth, fifth or sixth word of a whole passage."""
    rows = spark.read.parquet(f"{data}/eval_items.parquet").where("passage is not null").select("item_id", "passage").collect()
    index, r, known = leaks.ItemIndex([(x.item_id, x.passage) for x in rows]), random.Random(every), {}
    hit = 0
    for k, ws in enumerate(index.words):
        page = text(40, r).split() + [w if (i + 1) % every else r.choice(WORDS) for i, w in enumerate(ws)] + text(40, r).split()
        hit += any(x == k for _, x, _ in leaks.leaks_in([page], index, known))
    assert hit >= least * len(rows)


def test_similarity_weighs_shared_words_little():
    index = leaks.ItemIndex([(i, f"the {a} comet returns to {b} every year") for i, (a, b) in enumerate(zip(WORDS[:40], WORDS[40:80]))])
    p = index.words[0]
    names = leaks.similarity(p, 0, 7, [1, 5], index.weight)
    shape = leaks.similarity(p, 0, 7, [0, 2], index.weight)
    assert names < 0.5 < shape < 1 and leaks.similarity(p, 0, 7, [], index.weight) == 1


def test_many_items_take_one_pass(spark, monkeypatch):
    """The corpus is read once for all items up to ITEMS."""
    passes = []
    search = leaks._search
    monkeypatch.setattr(leaks, "_search", lambda *a: passes.append(1) or search(*a))
    r = random.Random(2)
    q = spark.createDataFrame([(i, text(12, r)) for i in range(6000)], ITEMS)
    leaks.find_leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), q)
    assert len(passes) == 1
