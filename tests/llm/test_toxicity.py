import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import toxicity

BAD = ["vile", "rotten", "foul", "nasty", "awful"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) * y):
            t.insert(rng.randrange(len(t)), rng.choice(BAD))
        docs.append((i, " ".join(t)))
        labels.append((i, int(rng.random() < 0.9), y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.query(docs, labels).collect() if r["held_out"]]
    assert len(rows) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    hit = [r for r in rows if r["predicted"]]
    assert all(r["evidence"] for r in hit)


def test_held_out_labels_do_not_matter(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda lab: sorted(map(repr, toxicity.query(docs, lab).collect()))
    assert rows(labels) == rows(turned)


def brute_force(docs, labelled, queries):
    """Cosines of queries with all examples: TF-IDF over every word and beginning, weighed by the correlation with the label; texts by id."""
    def tf(text):
        out = {}
        for word in re.findall(r"\w+", (text or "").lower()):
            for t in [word] + [word[:4] + "*"] * (len(word) > 4):
                out[t] = out.get(t, 0) + 1
        return out

    counted, examples = [tf(t) for t in docs.values()], {i: tf(docs[i]) for i in labelled}
    df = {}
    for c in counted:
        for t in c:
            df[t] = df.get(t, 0) + 1
    n, ones = len(examples), sum(labelled.values())
    weight = {}
    for t in {t for c in examples.values() for t in c}:
        x = np.array([t in c for c in examples.values()], float)
        y = np.array([labelled[i] for i in examples], float)
        p, q, both = x.sum() / n, ones / n, (x * y).sum() / n
        weight[t] = abs(both - p * q) / max((p * (1 - p) * q * (1 - q)) ** 0.5, 1e-9) * (np.log((1 + len(docs)) / (1 + df[t])) + 0.05)

    def unit(c):
        v = {t: (1 + np.log(k)) * weight[t] for t, k in c.items() if t in weight}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()} if size else {}

    vectors = {i: unit(c) for i, c in examples.items()}
    for q in queries:
        own = unit(tf(docs[q]))
        yield {i: sum(x * own.get(t, 0) for t, x in v.items()) for i, v in vectors.items()}


def test_nearest_are_exact(corpus):
    docs, labels = corpus
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labelled = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id < 400").collect()}
    index = toxicity.fit(docs, labels.filter("doc_id < 400").select("doc_id", "toxic"))
    assert len(index.vocabulary) == len({t for i in labelled for t in toxicity.terms(texts[i])})
    queries = list(range(300, 420))
    for q, full in zip(queries, brute_force(texts, labelled, queries)):
        slots, cosines = index.nearest([index.vector(texts[q]), index.vector("")])[0]
        want = np.sort([c for c in full.values() if c > 1e-12])[::-1][: toxicity.K]
        assert np.allclose(cosines, want, atol=1e-6) and np.allclose([full[index.ids[s]] for s in slots], cosines, atol=1e-6)


def test_scores_are_the_calibrated_votes(corpus):
    """Votes and isotonic calibration by plain loops give the scores."""
    docs, labels = corpus
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labelled = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id < 300").collect()}
    share = sum(labelled.values()) / len(labelled)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("doc_id < 300").select("doc_id", "toxic"))).collect()}

    def vote(full, skip=None):
        best = sorted((c for i, c in full.items() if i != skip and c > 1e-12), reverse=True)[: toxicity.K]
        floor = best[-1] if best else 1
        near = [i for i, c in full.items() if i != skip and c >= floor]
        w = [full[i] ** 2 for i in near]
        return (sum(x * labelled[i] for x, i in zip(w, near)) + 0.5 * share) / (sum(w) + 0.5)

    own = sorted(labelled)
    raw = [vote(f, i) for i, f in zip(own, brute_force(texts, labelled, own))]
    points = sorted({round(r, 12) for r in raw})
    groups = [[[y for r, y in zip(raw, map(labelled.get, own)) if round(r, 12) == p], p, p] for p in points]
    changed = True
    while changed:  # pool neighbours that fall
        changed = False
        for k in range(len(groups) - 1):
            if np.mean(groups[k][0]) >= np.mean(groups[k + 1][0]):
                groups[k : k + 2] = [[groups[k][0] + groups[k + 1][0], groups[k][1], groups[k + 1][2]]]
                changed = True
                break
    xs = [x for _, lo, hi in groups for x in (lo, hi)]
    ys = [np.mean(y) for y, _, _ in groups for _ in (0, 1)]
    queries = list(range(300, 360))
    for q, full in zip(queries, brute_force(texts, labelled, queries)):
        r = vote(full)
        assert abs(got[q] - (0.98 * np.interp(r, xs, ys) + 0.02 * r)) < 1e-4


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    pool = [chr(c) for c in range(256)] * 2 + list("abc _\t\n") * 20 + ["\u0130", "Ω", "語", "\u2028", "ǅ"]
    for k in range(400):
        text = "".join(rng.choices(pool if k % 4 == 0 else pool[:-5], k=60))
        assert toxicity.words(text) == Counter(re.findall(r"\w+", text.lower()))
    assert not toxicity.words(None) and not toxicity.words(" - ")


def test_sample_bounds():
    assert toxicity._within([(1, 0, 5), (2, 1, 9), (3, 0, 6), (4, 0, 5), (5, 1, 2)], 10) == [1, 2, 4]


def test_document_frequencies_cover_all_rows(corpus):
    docs, _ = corpus
    df, n = toxicity._count(docs.union(docs), ["vile", "v1", "absent"])
    texts = [set(toxicity.terms(r["text"])) for r in docs.collect()]
    assert n == 1800 and df.tolist() == [2 * sum(t in x for x in texts) for t in ("vile", "v1", "absent")]


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, 500).astype(float)
    y = (rng.random(500) < x / 30).astype(float)
    xs, ys = toxicity.isotonic(x, y, np.ones(500))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= -1e-12).all() and abs(np.interp(x, xs, ys).mean() - y.mean()) < 1e-9


def test_messy(spark, messy, none, corpus):
    docs, labels = corpus
    both = docs.union(messy.select("doc_id", "text"))
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (3, 1, 1), (3, 1, 0), (10**9, 1, 1)], labels.schema))
    got = toxicity.query(both, odd).collect()
    assert len(got) == both.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert {r["score"] for r in toxicity.query(messy, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.query(messy, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.query(none, labels).count() == 0
    same = toxicity.query(docs.withColumns({c: F.lit("own") for c in ("score", "lang", "source", "evidence", "toxic")}), labels)
    assert sorted(map(repr, same.collect())) == sorted(map(repr, toxicity.query(docs, labels).collect()))
