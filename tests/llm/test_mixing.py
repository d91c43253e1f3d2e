import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import mixing


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.floats(0.1, 2.5))
def test_targets(sizes, share):
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    total = share * sum(sizes)
    t = mixing.targets(sizes, weights, total)
    assert all(a <= 2 * n + 1e-6 for a, n in zip(t, sizes))
    assert abs(sum(t) - min(total, 2 * sum(sizes))) < 1e-6 * max(1, total)
    open_ = [(a / w) for a, w, n in zip(t, weights, sizes) if a < 2 * n - 1e-6]
    assert not open_ or max(open_) - min(open_) < 1e-6 * max(1, total)
    assert all(a / w <= min(open_) + 1e-6 for a, w, n in zip(t, weights, sizes) if open_ and a >= 2 * n - 1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1025])
def test_permutations(spark, n):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("n"), F.lit(99).cast("long").alias("key"))
    got = [r["o"] for r in mixing.permuted_col(df, "k", "n", "key", "o").orderBy("k").collect()]
    assert sorted(got) == list(range(n)) and got == [mixing.permuted(k, n, 99) for k in range(n)]
    assert got[mixing._inverse(n, 99)] == n - 1


def check(df, block, **options):
    rows = mixing.taken(df, block=block, **options).collect()
    assert sorted(repr((r["doc_id"], r["source"])) for r in rows) == sorted(repr((r["doc_id"], r["source"])) for r in df.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for own in by.values():
        size = sum(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {size}
        assert sum(r["taken"] for r in own) == min(round(own[0]["target"]), 2 * size)
    mix = mixing.blocks(df, block=block, **options).collect()
    assert Counter(r["source"] for r in mix for _ in range(r["n_words"])) == Counter({s: t for s, own in by.items() if (t := sum(r["taken"] for r in own))})
    assert all(len(r["text"].split(" ")) == r["n_words"] <= block for r in mix)
    assert len({(r["shard"], r["position"]) for r in mix}) == len({(r["source"], r["epoch"], r["block"]) for r in mix}) == len(mix)
    words = defaultdict(Counter)
    for r in df.collect():
        words[r["source"]].update((r["text"] or "").split())
    for s, own in by.items():
        used = Counter(w for r in mix if r["source"] == s for w in r["text"].split(" "))
        assert all(n <= 2 * words[s][w] for w, n in used.items())
    return mix


@pytest.mark.parametrize("block,slots", [(1, 7), (16, 5), (512, 4096)])
def test_mix_of_documents(documents, block, slots):
    check(documents.filter("doc_id < 60") if block == 1 else documents, block, shard_slots=slots)


def test_messy(messy, none):
    ascii_only = messy.withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7f]", "u"))
    check(ascii_only, 64)
    assert mixing.query(none).count() == 0 and mixing.blocks(none).count() == 0
    null = {r["doc_id"]: r for r in mixing.query(messy).collect() if r["source"] is None}
    assert set(null) == {1, None} and null[None]["size"] == 0 and null[None]["taken"] == 0


def test_reruns_and_partitions_agree(documents):
    rows = lambda df: sorted(map(repr, map(tuple, mixing.query(df).collect())))
    assert rows(documents) == rows(documents.repartition(7))
    first = sorted(map(repr, mixing.blocks(documents).collect()))
    assert first == sorted(map(repr, mixing.blocks(documents.repartition(3)).collect()))


def test_shards_are_drawn_near_the_shares():
    sources = [mixing.Source(i, str(i), 0, 0.0, 10**6, n, 1) for i, n in enumerate((600_000, 200_000, 200_000))]
    groups = mixing.draw_groups(sources, 10_000, 3, drawn=60)
    assert len(groups) == 20 and [g[0] for g in groups] == list(range(0, 100, 5))
    runs = [r for g in groups for r in mixing.draw_shards(*g, 10_000, 3)]
    assert all(sum(n for shard, *_, n, _ in runs if shard == k) == 10_000 for k in range(100))
    total = Counter()
    for shard, i, first, n, at in runs:
        assert first == total[i]
        total[i] += n
    assert total == {0: 600_000, 1: 200_000, 2: 200_000}
    counts = [n for shard, i, first, n, at in runs if i == 0 and shard < 80]
    assert all(abs(n - 6000) < 400 for n in counts) and len(set(counts)) > 20


def test_many_sources_are_joined(spark, documents, monkeypatch):
    df = documents.withColumn("source", F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")))
    rows = lambda: sorted(map(repr, map(tuple, mixing.query(df).collect())))
    first = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == first


def slow_taken(rows, block, seed):
    """What a mix takes by laying out all words one by one; ``rows``: (doc_id, text, source) in the order of the streams."""
    by = defaultdict(list)
    for i, (_, text, source) in enumerate(rows):
        by[source] += [i] * len((text or "").split())
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [len(by[s]) for s in names]
    goals = mixing.targets(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))], 1.5 * sum(sizes))
    out = Counter()
    for k, (s, goal) in enumerate(zip(names, goals)):
        n, left, epoch = -(-len(by[s]) // block), min(round(goal), 2 * len(by[s])), 0
        while left:
            for b in [mixing.permuted(j, n, (seed * 1_000_003 + k * 8_191 + epoch * 131) % 1_000_000_007) for j in range(n)]:
                for i in by[s][b * block : (b + 1) * block][:left]:
                    out[i] += 1
                left -= min(left, len(by[s][b * block : (b + 1) * block]))
            epoch += 1
    return sorted((r[0], r[2], out[i]) for i, r in enumerate(rows))


def test_taken_by_brute_force(spark):
    """With ids that come in the order of the streams (one bucket), every word that is taken is known."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.randrange(40))), rng.choice("abcde")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = sorted((r["doc_id"], r["source"], r["taken"]) for r in mixing.taken(df, block=8).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == slow_taken(rows, 8, mixing.SEED)


def test_repeated_rows_without_words_stay(spark):
    rows = [(1, "", "a"), (1, "", "a"), (1, None, "a"), (1, " ", "a"), (1, " ", "a"), (None, None, None), (None, None, None), (2, "x y z", "a"), (2, "x y z", "a")]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=2).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == {(1, "a", 0): 5, (None, None, 0): 2, (2, "a", 3): 2}
    assert all(r["taken"] == 0 for r in got if not r["size"])
