import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import repeats


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    where = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            where.setdefault(d[p : p + length], []).append((i, p))
    gone = [np.zeros(len(d), bool) for d in data]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for d, g in zip(data, gone):
        edge = np.diff(np.concatenate([[0], g.astype(int)]))
        out.append((len(d), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~g])).hexdigest()))
    return out


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, repeats.remove(df, **options).drop("spans").collect()))
    want = [(i, *w) for i, w in enumerate(slow(texts, options.get("length", repeats.LENGTH)))]
    assert got == want


def test_planted_repeats(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma délta epsilon zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(n))
    shared = [prose(n) for n in (60, 80, 120, 300)]
    texts = []
    for i in range(40):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) // 3))
            parts += [s[a : len(s) - rng.randrange(len(s) // 3)], prose(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += [shared[0] + shared[0], shared[3], shared[3], shared[3] + "!", "x" + shared[3]]
    check(spark, texts)


def test_edges_and_periods(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh", k=399))
    texts = ["a" * 399, "a" * 400, "a" * 401, "b" * 400, "ab" * 500, "abc" * 300 + "x" + "abc" * 300, base, base + "1", "1" + base, base + "2", base + "1z", None, "", "é" * 199, "é" * 201, "日本" * 150, "本日" * 150]
    check(spark, texts)


def test_small_alphabets(spark):
    rng = random.Random(9)
    s = ["".join(rng.choices("ab", k=rng.randint(300, 900))) for _ in range(10)]
    texts = s + [s[0][50:] + s[1][:600], s[1][100:550] + "c" + s[2][:420], s[3] + s[3][-450:]]
    check(spark, texts)
    for length in (160, 200, 300, 500):
        check(spark, texts, length=length)
    with pytest.raises(ValueError):
        repeats.remove(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=100)


def test_least_of_windows():
    h = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    h[100:160] = h[0]
    for width in (1, 2, 7, 100, 273, 500):
        got = repeats._least(h, width)
        assert all(h[g] == h[i : i + width].min() and g == i + int(np.argmin(h[i : i + width])) for i, g in enumerate(got))


def test_choice_of_equals_depends_on_the_window_alone():
    h = np.random.default_rng(1).integers(0, 1 << 63, 600, dtype=np.uint64)
    h[100:160], h[300:400:7] = 5, 7
    got = repeats._chosen(h, 80)
    for i in range(0, 300, 13):
        moved = np.concatenate([h[i : i + 200], h[:50]])
        assert (repeats._chosen(moved, 80)[:121] + i == got[i : i + 121]).all()
    assert (h[got] == [h[i : i + 80].min() for i in range(len(got))]).all()
    assert len(set(got[30:180].tolist())) < 30  # a stretch of 60 equals, seen coming and going


def test_long_periodic_texts(spark):
    """Runs of short periods among other text, of one text and of two, against every window."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    runs = ["a" * 3000, "abc" * 900, "-" * 420, "=-" * 260, "0123456789" * 150, word(130) * 20, "-" * 300 + "\n" + "-" * 300]
    texts = [word(50) + r + word(60) for r in runs] + [word(300) + r[7:] + word(500) for r in runs] + [runs[0] + word(30) + runs[1] + word(20) + runs[0][:1500], "a" * 3001, "a" * 399 + "b" + "a" * 399]
    check(spark, texts)


@pytest.mark.parametrize("part", [1 << 20, 3000])
def test_periodic_texts_have_few_anchors(part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    for unit in (b"a", b"abc", b"0123456789abcdef" * 5):
        data, local = np.frombuffer(unit * (20_000 // len(unit)) + b"end", np.uint8), []
        place, first, last = repeats.anchors(data, local=local)[3:]
        assert len(place) < 200 + 1000 * (part < 5000)
        seen = {w for x, y in zip(first, last) for w in range(x, y + 1)} | {w for x, y in local for w in range(x, y + 1)}
        assert seen == set(range(len(data) - 399))


def test_ten_megabytes_of_one_period(spark):
    rng = random.Random(6)
    other = "".join(rng.choices("abcdefgh ", k=5000))
    rows = [(1, "z" * 10_000_000), (2, "xyz" * 3_333_334), (3, other + "z" * 5000), (4, other[:300])]
    got = {r[0]: tuple(r)[1:4] for r in repeats.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (10_000_000, 10_000_000, 1), 2: (10_000_002, 10_000_002, 1), 3: (10_000, 5000, 1), 4: (300, 0, 0)}


def test_identifiers_do_not_depend_on_the_place():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"xxhello wonderful world", b"hello wonderful wo"))
    for k in (0, 1):
        assert repeats.Pointers(a).of(16, k)[2] == repeats.Pointers(b).of(16, k)[0] != repeats.Pointers(b).of(16, k)[1]


def test_parts_of_long_texts(spark, monkeypatch):
    """What is read in parts has the result of what is read at once; parts are set before workers start on them."""
    rng = np.random.default_rng(2)
    data = np.frombuffer(bytes(rng.integers(97, 99, 3000, dtype=np.uint8)) * 2 + b"c" * 900, np.uint8)
    place, first, last = repeats.anchors(data)[3:]
    whole = repeats.runs(data, place, first, last)
    monkeypatch.setattr(repeats, "PART", 512)
    b, _, _, p, f, l = repeats.anchors(data)
    assert set(zip(b, p)) >= set(zip(repeats.anchors(data)[0], p)) and sum(l - f + 1) == len(data) - 399
    windows = lambda place, first, last: {(w, p) for p, x, y in zip(place, first, last) for w in range(x, y + 1)}
    assert windows(p, f, l) == windows(place, first, last)
    assert all((x == y).all() for x, y in zip(whole, repeats.runs(data, place, first, last)))


def test_messy(spark, messy, none):
    got = repeats.query(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        if r["doc_id"] in (4, 5):  # copies of each other
            assert r["n_removed"] == r["n_bytes"] > 100_000 and r["n_spans"] == 1 and r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        if r["doc_id"] in (6, 7):  # repeats inside one text
            assert r["n_removed"] == r["n_bytes"]
        if r["doc_id"] in (2, 3, 8):
            assert r["n_removed"] == 0
    assert repeats.query(none).count() == 0
    spans = repeats.remove(messy.select("doc_id", "text")).filter("doc_id = 4").select(F.col("spans")[0]["to"]).first()[0]
    assert spans > 100_000
