import re
from collections import Counter

from weirflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))


def test_every_measurement_is_stored(documents, messy):
    for df in (documents, messy):
        want = sorted(sum(a == b for a, b in zip(w, w[1:])) for w in (WORD.findall(r["text"] or "") for r in df.collect()))
        assert sorted(r["n_stutter"] for r in quality.ledger(df).collect()) == want


def test_measurements(documents, messy):
    for df in (documents, messy):
        texts = [r["text"] for r in df.collect()]
        got = quality.query(df).collect()
        assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(map(slow, texts))
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_policies_and_ablation(documents):
    entries = quality.ledger(documents).cache()
    rows = entries.collect()
    for (name, version), p in quality.POLICIES.items():
        kept = quality.apply_policy(entries, p)
        assert kept.filter("kept").count() == sum(not r["fail_bits"] & p.mask for r in rows)
        assert kept.first()["policy"] == f"{name}-v{version}"
        for a in quality.ablation(entries, p).collect():
            bit = 1 << a["bit"]
            masked = [r["fail_bits"] & p.mask for r in rows]
            assert a["failed"] == sum(bool(m & bit) for m in masked) and a["failed_alone"] == sum(m == bit for m in masked)
            assert a["kept_without"] == sum(not m & ~bit for m in masked)


def test_rejects_junk_and_keeps_prose(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    junk = [" ".join(f"w{i}$$$" for i in range(60)), " ".join(f"WORD{i}!!" for i in range(60)).upper(), " ".join(["same"] * 60), "\n".join(["a line of its own"] * 9), "few words", " ".join(x for i in range(12) for x in [f"st{i}"] * 6), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([prose, *junk])], "doc_id long, text string")
    assert [r["doc_id"] for r in quality.filter_documents(df).collect()] == [0]


def test_stage_carries_columns(messy, none):
    kept = quality.filter_documents(messy)
    assert kept.columns == messy.columns and {r["text"] for r in kept.collect()} <= {r["text"] for r in messy.collect()}
    assert all(r["n_words"] == "own n_words" for r in kept.collect())
    assert quality.query(none).count() == 0 and quality.filter_documents(none).count() == 0 and quality.ablation(quality.ledger(none)).count() == 0
