import hashlib
import random
import re

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from weirflow.llm import fim


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=7, marks=fim.MARKS):
    text = text or ""
    units = re.findall(pattern, text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", p, m, s, marks[1] + s + marks[0] + p + marks[2] + m)
    return (doc_id, n, "psm", p, m, s, marks[0] + p + marks[1] + s + marks[2] + m)


def texts():
    r = random.Random(5)
    alphabet = ["\n", "\n", " ", "a", "b", ".", "!", "é", "😀", "\t", "\r", "<P", "<", "S>", " ", "x\n"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(400)]
    return [*out, "\n", "\n\n", "a", "a\n", "\na", "a<P>b\nc", "<M>", "<", "a <S> b", None, "", "😀😀\n😀", "line\r\nline\r", "w " * 50_000, "l\n" * 50_000, "x" * 200_000]


@pytest.mark.parametrize("units", sorted(fim.GRAMMARS))
def test_units_cuts_and_the_way_back(spark, units):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb"), (3, "again\nand"), (3, "again\nand"), (-5, "a\nb\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate, spm, marks in ((100, 50, fim.MARKS), (40, 0, ("[pre]", "[suf]", "[mid]"))):
        out = fim.transform(df, units, rate, spm, 11, marks)
        want = sorted(repr(slow(i, t, fim.GRAMMARS[units].pattern, rate, spm, 11, marks)) for i, t in rows)
        assert as_rows(out) == want
        back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"), marks))
        assert as_rows(back) == sorted(repr((i, t or "")) for i, t in rows)


def test_query(spark, messy, none, documents):
    for df in (messy, documents):
        got = as_rows(fim.query(df))
        want = []
        for r in df.collect():
            i, n, form, p, m, _, out = slow(r["doc_id"], r["text"])
            size = [None if x is None else len(x) for x in (p, m)]
            want.append(repr((i, n, form, *size, sha(out), sha(r["text"] or ""))))
        assert got == sorted(want)
    assert fim.query(none).count() == 0
    assert {r["form"] for r in fim.query(documents).collect()} == {"spm", "psm"}


def test_native(documents):
    plan = fim.query(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_marks_are_checked(documents):
    for marks in (("a", "a", "b"), ("", "b", "c"), ("<S", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(documents, marks=marks)
