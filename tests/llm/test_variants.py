import random
import re
import zlib
from collections import Counter

import pytest
from conftest import as_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import variants


def one_edit(x, y):
    """Exactly one insertion, deletion or replacement, by comparing both ends."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    x, y = sorted((x, y), key=len)
    p = 0
    while p < len(x) and x[p] == y[p]:
        p += 1
    return x[p + (len(x) == len(y)) :] == y[p + 1 :]


def slow(vocabulary, ratio=10):
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append(repr((w, form[w], root, n, len(near[w]), vocabulary.get(form[w]))))
    return sorted(out)


def slow_vocabulary(rows, least=7):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            words[w] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= 2}


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("ab", max_size=6), max_size=30), st.integers(1, 4))
def test_walk_finds_every_pair_of_its_range(words, width):
    def place(x, y):
        return next((p for p, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

    for middles, w in ((sorted(words), variants.OPEN), (sorted(x for x in words if len(x) <= width + 1), width)):
        got = sorted(tuple(sorted((middles[i], middles[j]))) for i, j in variants.near_words(middles, w))
        assert got == sorted((x, y) for k, x in enumerate(middles) for y in middles[k + 1 :] if one_edit(x, y) and place(x, y) < w and min(len(x), len(y)) <= w)


def seeded(n, seed, alphabet="abcdé", sizes=(7, 13)):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(r.choice(alphabet) for _ in range(r.randrange(*sizes)))
        out[w] = r.choice([2, 3, 20, 40, 400, 5000])
        for _ in range(r.randrange(4)):
            p = r.randrange(len(w) + 1)
            v = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice(alphabet) + w[p:], w[:p] + r.choice(alphabet) + w[p + 1 :]])
            if len(v) >= sizes[0]:
                out.setdefault(v, r.choice([2, 3, 30, 300]))
    return out


@pytest.mark.parametrize("limit", [20_000, 3])
def test_equals_brute_force_also_where_groups_are_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(variants, "GROUP_WORDS", limit)
    rounds = []
    placed = variants._placed
    monkeypatch.setattr(variants, "_placed", lambda *a: rounds.append(1) or placed(*a))
    v = seeded(250, 4) | {"aaaaaaa" + "a" * k: 2 * 10**k for k in range(9)} | {"x" * 300 + c: 2 for c in "abc"}
    got = variants.variants(spark.createDataFrame(list(v.items()), "word string, n long"))
    assert as_rows(got) == slow(v)
    pairs = variants.near_pairs(spark.createDataFrame(list(v.items()), "word string, n long"))
    assert as_rows(pairs) == sorted(repr((x, v[x], y, v[y])) for x in v for y in v if x < y and one_edit(x, y))
    assert (len(rounds) > 4) == (limit == 3)


def test_one_prefix_holds_a_third_of_all(spark, monkeypatch):
    """Groups are never larger than the limit, but for ranges of one place; counted, not assumed."""
    monkeypatch.setattr(variants, "GROUP_WORDS", 30)
    sizes = []
    members = variants._members
    monkeypatch.setattr(variants, "_members", lambda g: sizes.extend(r[0] for r in g.where("b - a > 1").groupBy("key").count().select("count").collect()) or members(g))
    r = random.Random(8)
    v = {"prefix" + "".join(r.choice("ab") for _ in range(k)): 2 + k for k in range(1, 12) for _ in range(40)} | seeded(200, 9)
    assert as_rows(variants.variants(spark.createDataFrame(list(v.items()), "word string, n long"))) == slow(v)
    assert max(sizes) <= 30


def test_chains_ties_and_roots(spark):
    v = {"variant": 5, "variants": 50, "variantsa": 500, "variantsab": 5000, "abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "lonely word".replace(" ", ""): 3}
    got = {r["word"]: r for r in variants.variants(spark.createDataFrame(list(v.items()), "word string, n long")).collect()}
    assert got["variant"]["root"] == got["variantsa"]["root"] == "variantsab" and got["variant"]["form"] == "variants"
    assert got["abcdefg"]["form"] == "abcdefh" and got["abcdefg"]["n_near"] == 2 and got["abcdefh"]["form"] is None
    assert tuple(got["lonelyword"])[1:] == (None, "lonelyword", 3, 0, None)


def test_texts(spark, messy, none, documents):
    words = [("Ünïçødé straßenbahn ÉCOLESUP écolesup", 2), ("ÉCOLESUP straßenbahn STRASSEN÷× strassen÷×", 3), ("longer LONGERX longerx longerx longerxy longerxy", 4), (None, 5), ("", 6), ("x" * 50_000 + " " + "x" * 50_000, None), ("y" * 50_001 + " " + "y" * 50_000 + " " + "y" * 50_001 + " " + "y" * 50_000, 7)]
    frame = spark.createDataFrame([(i, t) for t, i in words], "doc_id long, text string").withColumns({"word": F.lit("own"), "n": F.lit(1), "key": F.lit("k")})
    for df in (frame, messy.unionByName(messy)):
        want = slow(slow_vocabulary([(r["doc_id"], r["text"]) for r in df.collect()]))
        got = variants.query(df)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and as_rows(got) == want
    assert variants.query(none).count() == 0
    want = slow_vocabulary([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert as_rows(variants.vocabulary(variants.words_of(documents))) == sorted(repr(x) for x in want.items())
