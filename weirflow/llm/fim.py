r"""Fill-in-the-middle: a text cut into units, two seeded cuts, and the three parts in another order.

A unit grammar (``each``, ``run``, ``leading``) is translated into a regular expression that matches nothing but
the place between two neighbouring characters, by their classes. Spark's split at such places keeps every character,
so units are the pieces of one split and need no search of their own; the empty text, which a split gives back as one
empty piece, is handled apart and has no units.

A document's two cuts and its form come from sha256 of ``seed:id``, so reruns and other layouts agree. Forms:
``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part
after its mark. A text that holds a mark stays plain, so marks in an output are always cuts and ``restored`` rebuilds
the exact text.

Everything is a projection of one row: no shuffle, no Python.

Defined results: null and empty texts have no units and are plain, with an empty output; very long texts are cut
whole; a null id draws as an empty one; equal ids draw the same shares of their own number of units; repeated rows give repeated rows;
an empty table gives an empty result; other columns do not enter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of


@dataclass(frozen=True)
class Grammar:
    r"""How a text falls into units; ``chars`` is the inside of a character class.

    each: every one of the characters closes a unit; run: a run of them does; leading: a run of them begins one.
    """

    kind: str
    chars: str

    @property
    def pattern(self) -> str:
        """The units as matches from left to right."""
        c, other = f"[{self.chars}]", f"[^{self.chars}]"
        return {"each": f"{other}*{c}|{other}+", "run": f"{other}*{c}+|{other}+", "leading": f"{c}*{other}+|{c}+"}[self.kind]

    @property
    def boundary(self) -> str:
        """The places between units: a class of characters before, a class after, nothing in between."""
        c, other = f"[{self.chars}]", f"[^{self.chars}]"
        before, after = {"each": (c, r"[\s\S]"), "run": (c, other), "leading": (other, c)}[self.kind]
        return f"(?<={before})(?={after})"


GRAMMARS = {
    "lines": Grammar("each", r"\n"),
    "paragraphs": Grammar("run", r"\n"),
    "sentences": Grammar("run", ".!?"),
    "words": Grammar("leading", r"\x20\x09-\x0D"),
    "characters": Grammar("each", r"\s\S"),
}

#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


def units_of(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(units, (start + 1).cast("int"), (stop - start).cast("int")), "")


def transform(docs: DataFrame, units: str | Grammar = "lines", rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (units), form, prefix, middle, suffix (null where plain) and output of every row.

    ``rate`` percent of the texts are transformed, of these ``spm`` percent in the order suffix, prefix, middle.
    """
    grammar = GRAMMARS[units] if isinstance(units, str) else units
    if len(set(marks)) != 3 or not all(marks) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must be three different strings, none within another")
    rows = docs.select(F.col(f"`{id_col}`"), text_of(F.col(f"`{text}`")).alias("__t"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = settled(rows, F.struct(units_of(F.col("__t"), grammar).alias("u"), digest.alias("d")), "__s")
    u, d, t = F.col("__s.u"), F.col("__s.d"), F.col("__t")
    n = F.size(u).cast("long")
    cuts = [_draw(d, k) % (n + 1) for k in (0, 1)]
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(t, F.lit(m))
    plain = (t == "") | held | (_draw(d, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(d, 3) % 100 < spm, "spm").otherwise("psm")
    rows = settled(rows, F.struct(n.alias("n"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), form.alias("form")), "__c")
    n, a, b, form = (F.col(f"__c.{x}") for x in ("n", "a", "b", "form"))
    parts = F.when(form != "plain", F.struct(_joined(u, F.lit(0), a).alias("p"), _joined(u, a, b).alias("m"), _joined(u, b, n).alias("s")))
    rows = settled(rows, parts, "__p")
    p, m, s = (F.col(f"__p.{x}") for x in "pms")
    before, after, mid = (F.lit(x) for x in marks)
    output = F.when(form == "plain", t).when(form == "psm", F.concat(before, p, after, s, mid, m)).otherwise(F.concat(after, s, before, p, mid, m))
    return rows.select(F.col(f"`{id_col}`"), n.alias("n"), form.alias("form"), p.alias("prefix"), m.alias("middle"), s.alias("suffix"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from an output and its form alone: each mark is there once, and a split at them gives the parts."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def query(docs: DataFrame) -> DataFrame:
    """op13: lines of every document, all transformed, half of them suffix first; digests of what comes out and of the text rebuilt from it."""
    out = transform(docs)

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    chars = (F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle"))
    return out.select("doc_id", "n", "form", *chars, sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
