import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.Vocabulary(Path(bpe.VOCABULARY).read_bytes())


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def slow(v, word):
    """Joins the first pair of least rank until there is none."""
    ids = [v.inner[b] for b in word[:-1]] + [v.final[b] for b in word[-1:]]
    while pairs := [(m // v.size, i, m % v.size) for i in range(len(ids) - 1) if (m := v.merges.get(ids[i] * v.size + ids[i + 1])) is not None]:
        _, i, to = min(pairs)
        ids[i : i + 2] = [to]
    return ids


@settings(deadline=None)
@given(st.text("abcdefgehinrst", max_size=60) | st.binary(max_size=24).map(lambda b: b.decode("latin-1")))
def test_queue_is_the_slow_merge(word):
    v = bpe.vocabulary(Path(bpe.VOCABULARY).read_bytes())
    assert v.merge(word.encode()) == slow(v, word.encode())


def test_every_character(ours, theirs):
    texts = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(texts), 50_000):
        part = texts[k : k + 50_000]
        assert [x for x, e in zip(part, theirs.encode_batch(part, add_special_tokens=False)) if e.ids != numbers(ours.encode(x))] == []


def test_mixed_texts(ours, theirs):
    r = random.Random(3)
    pool = ["'s", "'LL", "don't", "Σ", "ΑΣ", "é", "é", "́", "\x1c", "\x1f x", "\x85", " ", "　", " ", "  ", "\n", "a", "B", "The", "quick", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>"]
    pool += ["가", "각", "ﬁ", "İ", "ß", "1", "²", "½", "१२", "!!", "$", "€uro", "😀", "👨‍👩‍👧", "ab" * 60, "'", "ﷺ", "Ⅷ", "﻿", "​", "Ǆ", "Å"]
    for _ in range(5000):
        x = "".join(r.choice(pool) for _ in range(r.randrange(12)))
        e = theirs.encode(x, add_special_tokens=False)
        got = ours.encode(x)
        assert e.ids == numbers(got) and bpe.strings(Path(bpe.VOCABULARY).read_bytes()).decode(got) == theirs.decode(e.ids, skip_special_tokens=False), repr(x)


def test_documents(spark, documents, messy, none, theirs):
    for df in (documents, messy):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        want = []
        for (i, t), e in zip(rows, theirs.encode_batch([t for _, t in rows], add_special_tokens=False)):
            text = theirs.decode(e.ids, skip_special_tokens=False)
            want.append(repr((i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
        got = bpe.query(df)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)
    assert bpe.query(none).count() == 0


def test_ids_and_other_columns(spark, theirs):
    df = spark.createDataFrame([("x", "a quick fox"), ("y", ""), (None, None)], "name string, body string").withColumn("ids", F.lit(3))
    out = bpe.encode(df, id_col="name", text="body")
    got = {r["name"]: (r["n_tokens"], r["n"]) for r in out.select("name", "n_tokens", bpe.ids_of(F.col("ids")).alias("n")).collect()}
    ids = theirs.encode("a quick fox", add_special_tokens=False).ids
    assert got == {"x": (len(ids), ids), "y": (0, []), None: (0, [])}
    back = bpe.decode(out.withColumn("ids", F.when(F.col("name") == "x", F.col("ids")))).collect()
    assert {r["name"]: r["decoded"] for r in back} == {"x": "a</w> quick</w> fox</w>", "y": "", None: ""}


def test_long_texts_and_full_memory(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 50)
    monkeypatch.setattr(bpe, "MEMORY", 20)
    r = random.Random(9)
    for _ in range(200):
        x = " ".join("".join(r.choice("abCde'1!") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(60)))
        assert numbers(ours.encode(x)) == theirs.encode(x, add_special_tokens=False).ids
    x = "".join(r.choice("abcdefgh") for _ in range(100_000))
    assert numbers(ours.encode(x)) == theirs.encode(x, add_special_tokens=False).ids


def test_another_file_is_refused(tmp_path, documents):
    p = tmp_path / "v.json"
    p.write_text(json.dumps(json.loads(Path(bpe.VOCABULARY).read_text()) | {"decoder": {"type": "ByteLevel"}}))
    with pytest.raises(ValueError):
        bpe.encode(documents, str(p))
    with pytest.raises(FileNotFoundError):
        bpe.encode(documents, "/nowhere/vocabulary")
