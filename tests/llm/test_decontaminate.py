import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import decontaminate

RNG = random.Random(2)
WORDS = [f"term{i}" for i in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    items = [prose(40) for _ in range(30)] + [prose(9), prose(3)]
    docs, want = [], []
    for i, item in enumerate(items):
        docs.append(prose(50) + item + prose(50))
        want.append({i} if len(item) >= 8 else set())
        changed = list(item)
        for k in range(3, len(changed), 9):  # one word in nine is another
            changed[k] = "other"
        docs.append(prose(20) + [w.upper() + "," for w in changed] + prose(20))
        want.append({i} if len(item) >= 13 else None)
        docs.append(prose(100))
        want.append(set())
        docs.append(prose(40) + item[:7] + prose(40))  # too short a part
        want.append(set() if len(item) > 9 else None)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"), bench, want


def test_planted_passages(planted):
    docs, bench, want = planted
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.query(docs, bench).collect()}
    assert all(got[i] == w for i, w in enumerate(want) if w is not None)
    left = {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()}
    assert left == {i for i in got if not got[i]}


def test_blocks_of_the_benchmark_give_the_same(planted):
    docs, bench, _ = planted
    one = decontaminate.find(docs, bench)
    many = decontaminate.find(docs, bench, chars=1000)
    assert len(list(decontaminate.blocks(bench, chars=1000))) > 5
    key = lambda df: sorted((r["doc_id"], sorted(map(tuple, r["__hits"]))) for r in df.collect())
    assert key(one) == key(many)


def test_spans_are_where_the_words_agree(planted):
    docs, bench, _ = planted
    items = {str(r["item_id"]): decontaminate.tokens(r["text"]) for r in bench.collect()}
    for r in decontaminate.find(docs, bench).filter(F.size("__hits") > 0).collect():
        own = decontaminate.tokens(r["text"])
        for h in r["__hits"]:
            item = items[h["item"]]
            assert any(sum(a == b for a, b in zip(own[h["first"] : h["end"]], item[k:])) == h["equal"] for k in range(len(item)))
            assert h["equal"] >= decontaminate.MIN_AGREE * (h["end"] - h["first"])


def slow_hits(own, items):
    """Items that a text overlaps, by every window of every diagonal."""
    found = set()
    for i, item in items.items():
        n = len(item)
        for shift in range(-n + 1, len(own)):
            lo, hi = max(0, shift), min(len(own), shift + n)
            eq = [own[k] == item[k - shift] for k in range(lo, hi)]
            if len(eq) == n and 4 <= n and (all(eq) if n < 8 else 5 * sum(eq) >= 4 * n):
                found.add(i)
            if sum(eq) < 11:
                continue
            run = [0]
            for x in eq:
                run.append(run[-1] + x)
            if any(5 * (run[e] - run[s]) >= 4 * (e - s) for s in range(len(eq) - 12) if eq[s] for e in range(s + 13, len(eq) + 1) if eq[e - 1]):
                found.add(i)
    return found


def test_matches_a_slow_search(spark, small, documents):
    """The contaminated documents and their items are those of a search of every diagonal."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.tokens(r["text"]) for r in bench.collect()}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.query(documents, bench).collect()}
    hit = [i for i, x in got.items() if x]
    some = [r for r in documents.orderBy(F.length("text")).collect() if r["doc_id"] in hit][:6] + documents.orderBy(F.length("text")).limit(60).collect()
    assert hit and len(some) > 60
    for r in some:
        assert got[r["doc_id"]] == slow_hits(decontaminate.tokens(r["text"]), items)


def test_one_word_repeated():
    """A text and an item of one word each agree on every diagonal."""
    index = decontaminate.build([(1, "la " * 300)])
    assert decontaminate.overlaps("la " * 5000, index)


def test_messy(spark, messy, none, planted):
    _, bench, _ = planted
    clean = decontaminate.clean_documents(messy, bench)
    assert clean.columns == messy.columns and sorted(map(str, clean.collect())) == sorted(map(str, messy.collect()))
    odd = bench.union(spark.createDataFrame([(None, "a b"), (99, None), (99, ""), (5, bench.first()["text"])], bench.schema))
    assert decontaminate.query(messy, odd).count() == messy.count()
    assert decontaminate.query(messy, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.query(none, bench).count() == 0 and decontaminate.clean_documents(none, bench).count() == 0


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 25])
def test_masks_hit_every_window(n):
    """All places of as many substituted words as are allowed; from 16 words on a run of four is certain."""
    for bad in combinations(range(n), n - -(-n * 4 // 5)):
        assert any(all(a + o not in bad for o in m) for m in decontaminate.MASKS for a in range(n - m[-1]))


@pytest.mark.parametrize("n,k", [(8, 1), (10, 2), (13, 2), (15, 3), (16, 3), (18, 3)])
def test_whole_items_with_any_words_substituted(n, k):
    item = [f"i{j}" for j in range(n)]
    index = decontaminate.build([(7, " ".join(item))])
    for bad in combinations(range(n), k):
        text = " ".join(["x"] * 5 + ["other" if j in bad else w for j, w in enumerate(item)] + ["y"] * 5)
        assert [(i, n_equal >= 0.8 * (e - s)) for i, s, e, n_equal in decontaminate.overlaps(text, index)] == [(7, True)]
    bad = set(range(0, n, 3))  # more than are allowed
    assert not decontaminate.overlaps(" ".join("other" if j in bad else w for j, w in enumerate(item)), index)


def test_windows_are_the_longest_on_the_diagonal():
    for _ in range(300):
        eq = np.array([RNG.random() < 0.75 for _ in range(40)])
        fits = [(e - s, s, e) for s in range(40) for e in range(s + 13, 41) if eq[s] and eq[e - 1] and 5 * eq[s:e].sum() >= 4 * (e - s)]
        got = decontaminate._windows(eq, 13, 0.8)
        assert bool(got) == bool(fits) and (not fits or max(e - s for s, e in got) == max(fits)[0])
        assert all((e - s, s, e) in fits for s, e in got) and len({x for s, e in got for x in range(s, e)}) == sum(e - s for s, e in got)


@pytest.mark.parametrize("item", ["who wrote the odyssey", "what is dark matter made of?", "日本の首都はどこですか。", "เมืองหลวงของไทยคืออะไร", "法国首都"])
def test_short_items_and_scripts_without_spaces(item):
    index = decontaminate.build([(1, item), (2, "")])
    size = len(decontaminate.tokens(item))
    found = decontaminate.overlaps(f"some words before {item} and some after", index)
    assert found == [(1, 3, 3 + size, size)]
    glued = f"これは{item}それ" if not item.isascii() else item.upper()
    assert [x[0] for x in decontaminate.overlaps(glued, index)] == [1]
    assert not decontaminate.overlaps("some words before " + " ".join(item.split()[:3]) if item.isascii() else item[: len(item) // 2], index)
