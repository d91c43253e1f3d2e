import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F
from test_decontaminate import slow_hits
from test_pii import BASE as KINDS

import corpus_pipeline
from weirflow.llm import decontaminate, quality, simhash
from weirflow.llm.common import WORD


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]


def test_stages_on_documents(spark, small, documents, tmp_path):
    docs = documents
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert new.columns == documents.columns
            ids = {r[0] for r in new.select("doc_id").collect()}
            assert ids <= {r[0] for r in docs.select("doc_id").collect()}
            seen.append(ids)
        docs = new
    first, second, third, fourth = seen
    assert first == {r["doc_id"] for r in quality.query(documents).filter("kept").collect()}
    kept = documents.filter(F.col("doc_id").isin(list(first)))
    groups = simhash.classes(kept, how=simhash.NEAR).collect()
    assert second == {r["component_id"] for r in groups}
    left = documents.filter(F.col("doc_id").isin(list(second)))
    assert third == {r["doc_id"] for r in decontaminate.query(left, spark.read.parquet(f"{small}/benchmark.parquet")).filter("not contaminated").collect()}
    assert fourth == third
    masked = spark.read.parquet(str(tmp_path / "pii"))
    assert masked.filter(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    words = masked.select(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    mix = spark.read.parquet(str(tmp_path / "mixing"))
    assert abs(mix.select(F.sum("n_words")).first()[0] - 1.5 * words) <= 20
    assert {i for r in mix.select("doc_ids").collect() for i in r[0]} <= fourth


def test_run_and_repeat(spark, small):
    rows = lambda: sorted(map(repr, corpus_pipeline.run(spark, small).collect()))
    first = rows()
    assert first and first == rows()


def test_messy(spark, small, messy, none, tmp_path):
    for k, start in enumerate((messy, none)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "mixing":
                assert out.columns == start.columns
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() == 0) == (k == 1)


def junk(text):
    """Whether the quality rules reject a text, by their definitions."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = len(w), sum(map(len, w))
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = {i + k for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = sum(c.isupper() for c in t)
    return (
        n < 20
        or 100 * len(repeated) > 30 * n
        or 100 * sum(c in "#*$%&|<>" for c in t) > 20 * n
        or 100 * upper > 40 * chars
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or 2 * chars < 3 * n
        or chars > 30 * n
        or 100 * sum(a == b for a, b in zip(w, w[1:])) > 50 * n
    )


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_by_brute_force(spark, small, documents):
    """What each of the first four stages keeps, by plain loops over all rows and pairs."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {i for i, t in texts.items() if not junk(t)}
    sets = {i: shingles(texts[i]) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(kept), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    single = {i for i in kept if find(i) == i}
    items = {r["item_id"]: decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    clean = {i for i in single if not slow_hits(decontaminate.tokens(texts[i]), items)}
    docs, want = documents, [kept, single, clean, clean]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, small)
        assert {r[0] for r in docs.select("doc_id").collect()} == ids, name
    for r in docs.collect():
        for name, pattern, ok in KINDS:
            left = [m for m in re.finditer(pattern, r["text"]) if ok(m.group())]
            assert not left or any(ok(m.group()) is False for m in re.finditer(pattern, texts[r["doc_id"]])), (name, r["doc_id"])
        if not any(ok(m.group()) for _, p, ok in KINDS for m in re.finditer(p, texts[r["doc_id"]])) and "<" not in r["text"]:
            assert r["text"] == texts[r["doc_id"]]
