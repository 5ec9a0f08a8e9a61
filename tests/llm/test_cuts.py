"""Cut texts: held-out accuracy on built texts, and dirty rows."""

import random

import pytest

from chronoloom.llm import cuts

SCHEMA = "doc_id long, source string, headers string, raw binary, text string"
NOUNS = "harbour kettle ladder meadow orchard signal tunnel valve lantern bridge market garden compass bakery".split()
VERBS = "painted sorted counted followed weighed guarded opened praised".split()
FOOT = ["Imprint | Privacy | Terms", "Powered by Wickerpress", "All rights reserved", "Back to top\nContact\nNewsletter"]


def sentence(r):
    return f"The {r.choice(NOUNS)} near the {r.choice(NOUNS)} {r.choice(VERBS)} {r.randrange(99)} {r.choice(NOUNS)}s, and {r.choice(NOUNS)}s were {r.choice(VERBS)} again{r.choice('..?!')}"


def page(r):
    body = " ".join(sentence(r) for _ in range(r.randint(4, 30)))
    k = r.random()
    if k < 0.4:
        return body
    if k < 0.7:
        return body + "\n" + r.choice(FOOT)
    if k < 0.8:
        return body + f"\n• {r.choice(NOUNS)}\n• {r.choice(NOUNS)}\n• {r.randrange(90)} {r.choice(NOUNS)}s"
    if k < 0.9:
        return body + f"\nok thanks that {r.choice(NOUNS)} worked for me"
    return body + f"\nAnd so the {r.choice(NOUNS)} went on…"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    rows, cut = [], set()
    for d in range(3000):
        text, source = page(r), f"site{r.randrange(12)}.example"
        raw = text.encode()
        headers = f"HTTP/1.1 200 OK\r\nContent-Length: {len(raw)}\r\n" if r.random() < 0.6 else None
        if source in ("site1.example", "site2.example") and len(text) > 900:
            text = text[:900] if source == "site1.example" else text[:880].rsplit(" ", 1)[0].rstrip(".,?!") + " [...]"
            raw = text.encode()
            headers = None
        elif r.random() < 0.03:
            at = r.randrange(60, len(text) - 10)
            text = text[:at].rstrip()
            raw = raw[:at]
        if text[-1] not in ".?!…" and not text.endswith(tuple(f.split("\n")[-1] for f in FOOT)) and not text.split("\n")[-1].startswith(("•", "ok thanks")):
            cut.add(d)
        rows.append((d, source, headers, raw if r.random() < 0.9 else None, text))
    odd = [(5000, None, None, None, "Nothing else. It ends well."), (5001, "s", "x", b"", None), (5002, "s", None, b"", ""), (5003, "s", None, b"", " \n "), (None, None, None, None, "A text."), (5004, "s", "Content-Length: 99999999999999999999", b"x", "Hi."), rows[0]]
    return spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "'x' as score", "1 as n", "'y' as tail", "'z' as line").repartition(5), cut


def test_found(corpus):
    df, cut = corpus
    got = {r.doc_id for r in cuts.cut_documents(df).collect()}
    assert len(cut) > 200
    recall, precision = len(got & cut) / len(cut), len(got & cut) / len(got)
    assert recall > 0.93 and precision > 0.93, (recall, precision)
    assert not got & {5000, 5001, 5002, 5003}


def test_rates(corpus):
    df, cut = corpus
    rates = {r.source: r for r in cuts.cut_rates(df).collect()}
    assert "" in rates and sum(r.texts for r in rates.values()) == 3000 + 4
    assert rates["site1.example"].rate > 0.3 and rates["site5.example"].rate < 0.12


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cuts.cut_documents(none).count() == 0 and cuts.cut_rates(none).count() == 0


def test_fit_separates():
    rows = [cuts.hashed([f"a {i % 2}", f"b {i % 7}", "bias"]) for i in range(400)]
    labels = cuts.np.array([i % 2 for i in range(400)])
    theta = cuts.fit(rows, labels)
    assert all((theta[x].sum() > 0) == bool(y) for x, y in zip(rows, labels))


def test_too_few_texts_to_learn_from(spark):
    """No whole or no cut text to learn from: nothing is judged and nothing counts as cut."""
    whole = [(i, "s", None, None, "It is whole.") for i in range(3)]
    for rows in (whole, whole[:1], [(i, f"s{i % 3}", None, None, f"All {i} is well that ends well.") for i in range(40)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert cuts.cut_documents(df).count() == 0
        assert all(r.rate is None or r.rate == 0 for r in cuts.cut_rates(df).collect())
    scores = cuts.score_cuts(spark.createDataFrame(whole, SCHEMA)).collect()
    assert len(scores) == 3 and all(r.score is None for r in scores)


def test_a_tiny_share_of_the_documents_still_fits(corpus):
    """`train_docs` far below the documents: some rows are picked at any share, or nothing is judged; never are all flagged."""
    df, _ = corpus
    for n in (1, 30):
        assert cuts.score_cuts(df, train_docs=n).where("score >= 0.5").count() < 0.6 * 3000
