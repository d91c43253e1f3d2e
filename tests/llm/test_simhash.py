import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import simhash


def slow_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, linked):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_components(documents):
    d = documents.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in d]
    roots = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, k in zip(d, roots):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    got = {r["doc_id"]: r for r in simhash.query(documents).collect()}
    for r, f, k in zip(d, fps, roots):
        assert got[r["doc_id"]]["fingerprint"] == f"{f:016x}" and got[r["doc_id"]]["component_id"] == least[k]


@pytest.mark.parametrize("how,tile", [(simhash.EXACT, 4096), (simhash.EXACT, 8), (simhash.Linking(3, 5), 16), (simhash.Linking(3, 9, 20), 32)])
def test_links_lose_nothing_in_tiles(spark, how, tile):
    """Chains and clusters of fingerprints, with keys cut into small tiles."""
    rng = random.Random(tile)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rng.choice((1, 2, 3))):
                x ^= 1 << rng.randrange(64)
    rows = [(f, rng.getrandbits(64) if how.both is not None and rng.random() < 0.1 else f ^ rng.getrandbits(3)) for f in sorted(fps)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(a), signed(b) if how.both is not None else 0) for i, (a, b) in enumerate(rows)], "node long, fp long, fp2 long")

    def linked(p, q):
        near = (p[0] ^ q[0]).bit_count()
        return near <= how.radius and (how.both is None or near + (p[1] ^ q[1]).bit_count() <= how.both)

    want = slow_components(rows, linked)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, how, tile)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_of_population_counts_skip_no_link():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(1), fps ^ np.uint64(1 << 62)]))
    zero = np.zeros(len(fps), np.uint64)
    x, y = simhash._forest(fps, zero, np.zeros(len(fps), np.int32), simhash.EXACT, block=16)
    want = slow_components([int(f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(fps) - len(x) == len(set(want))
    assert all(want[i] == want[j] for i, j in zip(x, y))


def test_keep_one(spark, messy, none):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and all(r["fp"] == "own fp" for r in kept.collect())
    texts = [r["text"] for r in kept.collect()]
    assert sorted(r["doc_id"] or 0 for r in kept.collect() if r["text"] and r["text"].startswith("word0")) == [4]
    assert sum(not (t or "").strip() for t in texts) == 1 and len(texts) == len(set(texts))
    assert simhash.keep_one(none).count() == 0 and simhash.query(none).count() == 0
    got = {(r["doc_id"], r["component_id"]) for r in simhash.query(messy).collect()}
    assert (5, 4) in got and (3, 2) in got and (None, 2) in got and (None, 1) in got


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(60)]
    rows, truth = [], []
    for k, b in enumerate(base):
        rows.append(" ".join(b))
        truth.append(k)
        for _ in range(2 if k % 3 == 0 else 0):
            c = list(b)
            for _ in range(4):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(" ".join(c))
            truth.append(k)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    left = [truth[r["doc_id"]] for r in simhash.keep_one(df).collect()]
    assert set(left) == set(range(60)) and len(left) <= 62


def test_ties_keep_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e", "y"), (1, "a b c d e", "x"), (1, "A b c d e", "z"), (None, "a b c d e", "n")], "doc_id long, text string, lang string")
    assert simhash.keep_one(df).count() == 1 and simhash.keep_one(df).first()["doc_id"] == 1
    assert simhash.keep_one(df.filter("doc_id is null").union(df.filter("doc_id is null"))).count() == 1
    assert df.select(F.count("*")).first()[0] == 4


def slow_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def families():
    """Copies of some texts with few to many words changed, about the threshold, and one line that is in many texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    line, out = [rng.choice(words) for _ in range(15)], []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(12, 200))] + line * (k % 2)
        for _ in range(6):
            c = list(base)
            for _ in range(rng.randrange(0, 1 + len(c) // 22)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c[: rng.randrange(len(c) - 3, len(c) + 1)]))
    return out


@pytest.mark.parametrize("tile", [simhash.TEXT_TILE, 3])
def test_near_groups_are_those_of_all_pairs(spark, tile, monkeypatch):
    """Whole groups by brute force: no link below 0.8, and none at 0.8 or more left out."""
    texts = families()
    sets = list(map(slow_shingles, texts))
    want = slow_components(sets, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))
    assert 60 < len(set(want)) < 200
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.NEAR, tile, simhash.WORD_TILE))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, how=simhash.NEAR).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(want)


def test_near_groups_of_documents(documents):
    d = documents.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [slow_shingles(r["text"]) for r in d]
    roots = slow_components(sets, lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b))
    assert {r["doc_id"] for r in simhash.keep_one(documents).collect()} == {d[k]["doc_id"] for k in roots}


def test_near_groups_come_from_fingerprints(spark):
    """Without the keys of least hashes, SimHash alone proposes: the similar pairs of groups of fingerprints within the radius."""
    texts = families()
    how = simhash.Similar(bands=0)
    sets = list(map(slow_shingles, texts))
    fps = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for h in ({xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in slow_shingles(t, how.pair)} for t in texts)]
    near = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= how.radius)
    want = slow_components(list(zip(near, sets)), lambda a, b: a[0] == b[0] and 10 * len(a[1] & b[1]) >= 8 * len(a[1] | b[1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), how=how).collect()}
    assert [got[i] for i in range(len(texts))] == want
    alone = len(set(slow_components(list(map(tuple, map(sorted, sets))), lambda a, b: a == b)))
    every = len(set(slow_components(sets, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))))
    assert alone - len(set(want)) > (alone - every) / 2  # they join most of what there is to join


def test_bands_miss_one_pair_in_a_thousand_million():
    assert (1 - 0.8**simhash.NEAR.rows) ** simhash.NEAR.bands < 1.1e-9


def test_tiles_of_a_hot_key_by_population_count(spark):
    """Fingerprints that share most blocks: those far apart in population count never meet, and no link is lost."""
    rng = random.Random(12)
    low = [sum(1 << b for b in rng.sample(range(16), rng.randrange(17))) for _ in range(1500)]
    fps = sorted(set(low))
    df = spark.createDataFrame([(i, f, 0) for i, f in enumerate(fps)], "node long, fp long, fp2 long")
    tile, radius = 64, 2
    edges = [(r["a"], r["b"]) for r in simhash.links(df, simhash.Linking(3, radius), tile).collect()]
    roots = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == roots
    # a unit of two tiles holds only what may be near the other tile (places in a population count are hashed), and a tile meets few others
    units = {}
    for u in simhash._units(df, simhash.Linking(3, radius), tile).collect():
        units.setdefault(u["unit"], []).append((u["side"], u["fp"].bit_count()))
    for rows in units.values():
        one, two = [[p for s, p in rows if s == k] for k in (1, 2)]
        if one and two:
            assert all(min(two) - 2 * radius <= p <= max(two) + 2 * radius for p in one)
    tiles = len(fps) // tile
    keys = math.comb(radius + 2, 2)
    assert sum(map(len, units.values())) < 0.8 * tiles * len(fps) * keys / 2
