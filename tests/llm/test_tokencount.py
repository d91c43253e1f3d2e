from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weirflow.llm import tokencount


def slow(word, first, later):
    n, i, vocabulary = 0, 0, first
    while i < len(word):
        j = len(word)
        while word[i:j] not in vocabulary:
            j -= 1
        i, n, vocabulary = j, n + 1, later
    return n


ALL = {bytes([b]) for b in range(256)}
words = st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b))


@given(st.sets(words.filter(len), max_size=12), st.sets(words.filter(len), max_size=12), st.lists(words, max_size=20))
def test_counts_are_greedy(first, later, texts):
    first, later = first | ALL, later | ALL
    a = tokencount.Automaton(first, later)
    assert [a.count(w) for w in texts] == [slow(w, first, later) for w in texts]


def test_public_vocabulary(spark, messy, none, documents):
    if not Path(tokencount.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    first, later = tokencount.read_vocabulary(Path(tokencount.VOCABULARY).read_bytes())
    known = {}
    for df in (documents, messy):
        for r, t in zip(sorted(tokencount.query(df).collect(), key=repr), sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)):
            w = (t[1] or "").encode().split()
            if len(w) and max(map(len, w)) < 1000 and df is documents:
                assert r["n_tokens"] == sum(known.setdefault(x, slow(x, first, later)) for x in w)
            assert r["n_tokens"] >= r["n_words"]
    got = {r["doc_id"]: r for r in tokencount.query(messy).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[None]["n_words"] * 0 == 0 or got[None]["n_words"] > 0
    assert got[4]["n_words"] == 30_000 and got[6]["n_bytes"] == 100_000 and got[6]["n_tokens"] < 100_000
    assert tokencount.query(none).count() == 0


def test_another_file(tmp_path, spark):
    import base64

    p = tmp_path / "v"
    p.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b" ab", b"abc", b" a", b"ab"])))
    df = spark.createDataFrame([(1, "ababc abcab"), (2, "ab")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.query(df, str(p)).collect()} == {1: 2 + 3, 2: 1}


def test_missing_file(spark, documents):
    with pytest.raises(FileNotFoundError):
        tokencount.query(documents, "/nowhere/vocabulary")
