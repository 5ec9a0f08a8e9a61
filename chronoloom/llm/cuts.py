"""Texts cut off by field limits or broken transfers.

Intact texts are cut artificially to make positives; a logistic regression over hashed features of the closing
characters, the closing line, its punctuation and the length relative to the source's limits is trained on them and
scores every text. Statistics (limits of each source, how often a closing line occurs) cover all documents; only the
labelled rows that the classifier is fitted on are a bounded sample.

Scoring needs the end of a text and its lengths, so texts are read once where they lie and only narrow rows move.
Without labelled rows of both kinds (a corpus of a few short texts) nothing can be told: scores are null and no text
counts as cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import checkpointed, sized_join

#: Documents that the classifier is fitted on, and artificial cuts of each.
TRAIN_DOCS, CUTS = 12_000, 3
#: Characters at the end of a text that hold the closing line and the one before.
TAIL = 600
BITS = 18
#: Training rows that must have a feature for it to get a weight; a feature of a single text would only tell it apart.
SUPPORT = 6
THRESHOLD = 0.5
#: Log odds from which a text taken as it is counts as cut when the rows for the fit are cleaned.
SURE = 3.0
#: Marks that sites set in place of the rest, put on artificial cuts.
MARKS = ("…", "...", " …", " ...", " [...]", " […]", "... (more)", "… (more)", " … Read more »", "... Read more", " [+1234 chars]", " (continued)", " [truncated]", "…»")

_INNER = re.compile(r"[.!?。？！…;:][\"”»)’']*\s+|[。？！]")
_END = re.compile(r"[.!?。？！][\"”»)’']*$")
_DIGIT = re.compile(r"\d+")


def _lengths(documents: DataFrame, keep: list[str]) -> DataFrame:
    text = F.regexp_replace(F.col("text").cast("string"), r"[\s\p{Z}\p{Cf}\p{Cc}]+$", "")
    return documents.select(*keep, text.alias("text")).where(F.length("text") > 0)


def narrow(documents: DataFrame) -> DataFrame:
    """doc_id, source, declared (short, full, odd or none), n (characters), nb (bytes), tail, text of every text that is not blank."""
    declared = F.try_to_number(F.nullif(F.regexp_extract(F.col("headers").cast("string"), r"(?im)^content-length:\s*(\d{1,15})", 1), F.lit("")), F.lit("9" * 15)).cast("long")
    got = F.octet_length("raw")
    state = F.when(declared.isNull() | got.isNull() | (declared == 0), "none").when(declared > got, "short").when(declared == got, "full").otherwise("odd")
    rows = _lengths(documents.withColumn("declared", state), ["doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "declared"])
    return rows.select("doc_id", "source", "declared", F.length("text").alias("n"), F.octet_length("text").alias("nb"), F.right("text", F.lit(TAIL)).alias("tail"), "text")


def _line(tail: Column, source: Column) -> Column:
    """Hash of the closing line with the site's name and numbers masked; 64 bits, so lines that meet by chance are rarer than any count tells."""
    last = F.element_at(F.split(tail, "\n"), -1)
    last = F.when(F.length(source) > 0, F.replace(last, source, F.lit("§"))).otherwise(last)
    return F.xxhash64(F.regexp_replace(last, r"\d+", "0"))


def length_stats(rows: DataFrame) -> DataFrame:
    """For each source and length n in use: same (texts of that length), near (within 16 characters), total (of the source)."""
    per = rows.groupBy("source", "n").agg(F.count("*").alias("same"))
    w = Window.partitionBy("source").orderBy("n")
    return per.select("source", "n", "same", F.sum("same").over(w.rangeBetween(-16, 16)).alias("near"), F.sum("same").over(Window.partitionBy("source")).alias("total"))


def byte_stats(rows: DataFrame) -> DataFrame:
    """The same by length in bytes, over texts in which a character may take several bytes: source, nb, bsame, bnear, btotal."""
    several = rows.where(F.col("nb") != F.col("n")).select("source", F.col("nb").alias("n"))
    return length_stats(several).toDF("source", "nb", "bsame", "bnear", "btotal")


def _peak(b: str = "") -> Column:
    """Lengths that many texts of a source share, exactly or nearly: signs of a limit."""
    same, near, total = F.col(f"{b}same"), F.col(f"{b}near"), F.col(f"{b}total")
    exact = (same >= 5) & (same * 3 >= near)
    return F.coalesce(exact | ((near >= 10) & (near * 8 >= total)), F.lit(False))


def limits(stats: DataFrame, b: str = "") -> DataFrame:
    """Lengths at which a source seems to cut: source, limits (all of them); `b` is "b" for bytes.

    A peak holds a third of the texts within 16 characters or lies in a band with an eighth of the source's texts, so a
    source has few for its range of lengths, whatever the number of its texts.
    """
    n = "nb" if b else "n"
    return stats.where(_peak(b)).groupBy("source").agg(F.sort_array(F.collect_list(n)).alias(f"{b}limits"))


def seems_intact() -> Column:
    """Texts to take as whole for the fit: their length is no sign of a limit and their transfer was not short, or they end a sentence."""
    ends = F.col("tail").rlike("[.!?。？！][\"”»)’']*$") & ~F.col("tail").rlike("(\\.\\.|[…»\\])])[\"”)’']*$")
    return ends | (~_peak() & ~_peak("b") & (F.col("declared") != "short"))


def artificial(sample: DataFrame, cuts: int = CUTS) -> DataFrame:
    """Artificial cuts of texts, at a limit of the source or anywhere, some with a mark: the columns of `narrow`.

    Cuts that end a sentence or a line are left out: they look like whole texts.
    """
    u = lambda name: F.pmod(F.xxhash64("doc_id", "cut", F.lit(name)), F.lit(1 << 20)) / float(1 << 20)
    rows = sample.where(F.col("n") >= 60).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    pick = lambda xs: F.try_element_at(xs, (F.lit(1) + F.floor(u("which") * F.size(xs))).cast("int"))
    even, several = F.col("cut") % 2 == 0, F.col("nb") != F.col("n")
    rows = rows.withColumn("_n", F.when(even, pick(F.filter("limits", lambda x: x < F.col("n")))))
    rows = rows.withColumn("_nb", F.when(even & several, pick(F.filter("blimits", lambda x: x < F.col("nb")))))
    free = (F.lit(20) + u("at") * (F.col("n") - 25)).cast("int")
    at = F.coalesce((F.col("_nb") * F.col("n") / F.col("nb")).cast("int"), F.col("_n"), free)
    at_limit = F.col("_n").isNotNull() | F.col("_nb").isNotNull()
    rows = rows.withColumn("at", at).withColumn("_limit", at_limit).withColumn("next", F.substr("text", F.col("at") + 1, F.lit(1)))
    mark = F.when(u("mark") < 0.3, F.element_at(F.array(*map(F.lit, MARKS)), (F.lit(1) + F.floor(u("kind") * len(MARKS))).cast("int"))).otherwise("")
    rows = rows.withColumn("mark", mark)
    body = F.substr("text", F.lit(1), F.col("at"))
    body = F.when(F.col("mark") != "", F.regexp_replace(body, r"\s*\S*$", "")).otherwise(F.regexp_replace(body, r"\s+$", ""))
    rows = rows.withColumn("body", body).where((F.length("body") > 5) & ~F.col("body").rlike("[.!?。？！…:;\\]\"”»)]$") & (F.col("next") != "\n"))
    cut = F.concat("body", "mark")
    short = F.when(F.col("_limit"), F.col("declared")).when(F.col("declared").isin("full", "odd"), "short").otherwise(F.col("declared"))
    return rows.select("doc_id", "source", short.alias("declared"), F.when(F.col("_limit"), F.col("at")).otherwise(F.length(cut)).cast("int").alias("n"), F.coalesce("_nb", F.octet_length(cut)).alias("nb"), F.right(cut, F.lit(TAIL)).alias("tail"))


def with_stats(rows: DataFrame, stats: DataFrame, bstats: DataFrame, lines: DataFrame, own: int) -> DataFrame:
    """`rows` with the statistics of their length and closing line; `own` is 1 where they are counted among them."""
    out = rows if "line" in rows.columns else rows.withColumn("line", _line(F.col("tail"), F.col("source")))
    out = sized_join(out, stats, ["source", "n"], "left", salt_of=["doc_id"])
    out = sized_join(out, bstats, ["source", "nb"], "left", salt_of=["doc_id"])
    out = sized_join(out, lines, ["line"], "left", salt_of=["doc_id"])
    several = F.col("nb") != F.col("n")  # only such texts are counted in the statistics by bytes
    num = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - own, F.lit(0)).cast("double").alias(c)
    return out.select("doc_id", "source", "declared", "n", "tail", num("same"), num("near"), num("total"), num("lines"), *[F.when(several, num(c)).otherwise(0.0).alias(c) for c in ("bsame", "bnear", "btotal")])


def _bucket(x: float) -> int:
    return int(x).bit_length()


def _kind(c: str) -> str:
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "c" if ord(c) > 0x2E80 else "A" if c.isupper() else "a"
    return c


def features(tail: str, source: str, declared: str, n: int, same: float, near: float, total: float, lines: float, bsame: float, bnear: float) -> list[str]:
    """Names of the features of a text."""
    if source:
        tail = tail.replace(source, "§")
    parts = tail.rsplit("\n", 6)
    last = parts[-1].strip()
    blank = len(parts) > 1 and not parts[-2].strip()
    above = [_DIGIT.sub("0", x.strip()) for x in parts[-2::-1] if x.strip()]
    before = above[0] if above else ""
    upper = above[1] if len(above) > 1 else ""
    ws = last.split()
    masked = [_DIGIT.sub("0", w) for w in ws]
    frag = _INNER.split(last)[-1]
    fws = frag.split()
    end = last[-1:] or " "
    kind = _kind(end)
    inner = len(frag) < len(last)
    dots = last.endswith(("..", "…"))
    closed = "e" if dots else "t" if _END.search(last) else kind if not kind.isalnum() else "w"
    long = min(len(fws), 12)
    first = fws[0] if fws else ""
    shape = ("•" if last[:1] in "•-*–—#>" else _kind(last[:1] or " ")) + _kind((fws[0] if fws else " ")[:1])
    spike = f"{_bucket(same)}/{_bucket(8 * same / near) if near else 0}"
    crowd = f"{_bucket(16 * near / total) if total > 20 else 'x'}"
    bspike = f"{_bucket(bsame)}/{_bucket(8 * bsame / bnear) if bnear else 0}"
    quotes = last.count('"') % 2
    out = [
        f"end {end}", f"kind {kind}", f"end2 {last[-2:]}", f"end4 {_DIGIT.sub('0', last[-6:])}", f"closed {closed}",
        f"inner {inner} {closed}", f"frag {long} {closed} {inner}", f"shape {shape} {closed} {inner}",
        f"words {min(len(ws), 15)} {closed}", f"w1 {masked[-1] if masked else ''}", f"w2 {' '.join(masked[-2:])}", f"w3 {' '.join(masked[-3:])}",
        f"first {first} {closed}", f"two {' '.join(masked[:2])} {closed}", f"line {' '.join(masked)}", f"one {masked[0] if masked else ''} {len(ws) == 1}",
        f"lines {_bucket(lines)}", f"lines {_bucket(lines)} {closed}", f"spike {spike}", f"spike {spike} {closed} {inner}", f"same {_bucket(same)} {closed}",
        f"bspike {bspike} {closed}", f"bsame {_bucket(bsame)} {closed}", f"limit {bsame >= 4 or (same >= 4 and same * 4 >= near)} {closed}",
        f"crowd {crowd} {closed}", f"round {n % 50 == 0 or n % 64 == 0} {closed}", f"declared {declared} {closed}", f"declared {declared} {_bucket(lines)}",
        f"quotes {quotes} {closed}", f"comma {end == ','}", f"blank {blank} {closed} {inner}", f"before {bool(_END.search(before))} {blank} {closed} {shape}",
        f"lower {sum(w[:1].islower() for w in fws) > len(fws) / 2} {closed} {inner} {min(long, 4)}", f"lastup {(fws[-1][:1] if fws else ' ').isupper()} {closed} {min(long, 4)}",
        f"hascomma {',' in frag} {closed}", f"len {_bucket(len(last))} {closed}", f"rel {len(last) > len(before)} {closed} {blank}", "bias",
        f"w-2 {masked[-2] if len(masked) > 1 else ''} {min(len(ws), 8)} {closed}", f"w-3 {masked[-3] if len(masked) > 2 else ''} {closed}",
        f"above {before} {closed}", f"upper {upper} {closed}", f"above2 {' '.join(before.split()[:2])} {closed}", f"aboveend {before[-1:]} {min(len(ws), 3)} {closed}",
        f"abovewords {min(len(before.split()), 9)} {min(len(ws), 9)} {closed}", f"uppers {sum(w[:1].isupper() for w in ws)} {min(len(ws), 8)} {closed}",
    ]
    out += [f"has {w}" for w in set(masked[-12:])]
    return out


def hashed(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names], np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 16, rate: float = 0.1, decay: float = 5e-5) -> np.ndarray:
    """Logistic regression by AdaGrad over hashed features, both labels weighted alike, in a fixed order of rows."""
    theta = np.zeros(1 << BITS)
    if not len(rows):
        return theta
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    names = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= SUPPORT)
    place = np.full(1 << BITS, -1, np.int32)
    place[names] = np.arange(len(names))
    ids = place[flat]
    used = ids >= 0
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[used]
    ids = ids[used]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=len(rows)))])
    weights = np.where(labels == 1, 0.5 * len(labels) / max(1, labels.sum()), 0.5 * len(labels) / max(1, (labels == 0).sum()))
    w, gain = np.zeros(len(names)), np.full(len(names), 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 256):
            batch = order[lo : lo + 256]
            n = starts[batch + 1] - starts[batch]
            at = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            row, x = np.repeat(np.arange(len(batch)), n), ids[at]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[x], len(batch)), -30, 30)))
            g = np.bincount(x, ((p - labels[batch]) * weights[batch])[row], len(names)) / len(batch) + decay * w
            gain += g * g
            w -= rate * g / np.sqrt(gain)
    theta[names] = w  # features below the support have kept 0
    return theta


def train(x: list[np.ndarray], split: np.ndarray, labels: np.ndarray, folds: int = 3) -> np.ndarray:
    """Weights of the classifier from features, a hash that splits the rows, and labels.

    Some texts taken as they are (label 0) were cut in truth. Each fold is scored by a classifier that has not seen
    it, those that surely look cut are left out, and the classifier is fitted on the rest.
    """
    fold = split % folds
    keep = labels == 1
    for f in range(folds):
        seen = np.flatnonzero(fold != f)
        theta = fit([x[i] for i in seen], labels[seen])
        for i in np.flatnonzero((fold == f) & (labels == 0)):
            keep[i] = theta[x[i]].sum() < SURE
    kept = np.flatnonzero(keep)
    return fit([x[i] for i in kept], labels[kept])


_COLUMNS = ["tail", "source", "declared", "n", "same", "near", "total", "lines", "bsame", "bnear"]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the fit: doc_id, n, label, a hash of the closing characters, hashed features."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in _COLUMNS]
        ids = [hashed(features(*r)) for r in zip(*cols)]
        split = [zlib.crc32(t[-60:].encode("utf-8", "surrogatepass")) for t in cols[0]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("label"), pa.array(split, pa.int64()), lists], names=["doc_id", "n", "label", "split", "ids"])


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = shipped.value
        for b in batches:
            cols = [b.column(c).to_pylist() for c in _COLUMNS]
            z = np.array([theta[hashed(features(*r))].sum() for r in zip(*cols)])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(score, pa.float64())], names=["doc_id", "source", "score"])

    return run


def score_cuts(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, source and score (chance that the text was cut) of every text that is not null, empty or blank.

    A null source counts as the source ''; rows that repeat are scored as often as they occur; an empty table gives
    no rows. `train_docs` bounds the documents that the classifier is fitted on: a hash of doc_id picks that many on
    average at every size, and the rows with the least hashes up to twice that many are kept. All scores are null where
    the picked texts give no whole text or no cut one to learn from.
    """
    spark = documents.sparkSession
    rows = narrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "headers", "raw", "text"))
    short = checkpointed(rows.drop("text").withColumn("line", _line(F.col("tail"), F.col("source"))))  # narrow rows that every step below reads
    lines = checkpointed(short.groupBy("line").agg(F.count("*").alias("lines")))
    stats, bstats = checkpointed(length_stats(short)), checkpointed(byte_stats(short))
    total = F.lit(max(1, documents.count()))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), total) < train_docs)
    sample = picked.join(limits(stats), "source", "left").join(limits(bstats, "b"), "source", "left")
    sample = sample.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("limits", "blimits")})
    cut = with_stats(artificial(sample), stats, bstats, lines, 0).withColumn("label", F.lit(1))
    whole = with_stats(picked.drop("text"), stats, bstats, lines, 1).where(seems_intact()).withColumn("label", F.lit(0))
    got = cut.unionByName(whole).mapInArrow(_featurize, "doc_id long, n int, label int, split long, ids array<int>")
    got = got.orderBy(F.xxhash64("doc_id", F.lit("keep")), "doc_id", "label", "n", "split").limit(2 * train_docs * (1 + CUTS)).toArrow()
    got = got.sort_by([(c, "ascending") for c in ("label", "doc_id", "n", "split")])
    labels = got["label"].to_numpy()
    theta = np.zeros(1)
    if (labels == 0).any() and (labels == 1).any():
        flat = got["ids"].combine_chunks()
        x = np.split(flat.flatten().to_numpy(), flat.offsets.to_numpy()[1:-1] - flat.offsets[0].as_py())
        theta = train(x, got["split"].to_numpy(), labels)
    if not theta.any():  # no row of a kind, or no feature that enough rows have
        return short.select("doc_id", "source", F.lit(None).cast("double").alias("score"))
    scored = with_stats(short, stats, bstats, lines, 1)
    return scored.mapInArrow(_score(spark.sparkContext.broadcast(theta)), "doc_id long, source string, score double")


def cut_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of every text that was cut."""
    return score_cuts(documents).where(F.col("score") >= threshold).select("doc_id").distinct()


def cut_rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: texts (not blank), cut, and rate (cut / texts; null where no text could be judged)."""
    s = score_cuts(documents)
    return s.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.col("score") >= threshold).alias("cut"), F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("rate"))
