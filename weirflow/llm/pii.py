"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Positions of all matches come from two built-in functions: cutting a text at a pattern gives the gaps,
extracting the pattern gives the matches, and running sums of both lengths give start and end, in code
points. Patterns are written so that matching is linear in the text: runs are possessive, and a match
may start inside a run only where the one before it ended.

Kinds. Base, in this order: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to
15 digits). Added by this operator: iban (mod-97 of the letters-to-numbers form is 1), secret (a value
of 12 or more characters assigned to a name such as password or token, or a cloud access key id).
Base spans are always reported; an added span is reported where its score reaches ``min_score``.

Scores, for all kinds: what the checksum or format alone is worth, raised where one of the kind's
context words stands within the 40 characters before the match.

Defined results: a null or empty text has no spans; repeated rows are judged each on their own; very long
texts and very many matches are found whole; an empty
table gives an empty result; columns of the input other than doc_id and text do not enter, and
:func:`redact_documents` carries them whatever their names are. Everything is a built-in Spark expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of

CONTEXT_CHARS = 40
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test that every text with a match passes, as a regular expression
    score: float
    context: str  # words that raise the score
    sql: str  # the same pattern for engines without possessive runs and look-behind


EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SECRET = (
    r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key))\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_=-]{12,}[\x22']?"
    r"|\bA[KS]IA[A-Z0-9]{16}\b"
)

BASE = (
    Kind("email", EMAIL, "@", 0.9, "mail|contact|write", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    Kind("ip", IP, r"[0-9]\.[0-9]", 0.6, "ip|address|host|server", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, "card|visa|credit|payment|karte|carte|tarjeta", r"[0-9](?:[\x20-]?[0-9])+"),
    Kind("phone", PHONE, r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax", PHONE),
)
ADDED = (
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|compte|cuenta", IBAN),
    Kind("secret", SECRET, r"[=:]|A[KS]IA", 0.7, "key|login|auth|secret", SECRET),
)
KINDS = BASE + ADDED


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the Luhn sum of a string of digits is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where the number that an IBAN stands for leaves 1 when divided by 97."""
    flat = F.regexp_replace(iban, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97) == 1


def _part_ok(p: Column) -> Column:
    p = F.ltrim(p, F.lit("0"))
    return (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)


def confirmed(kind: str, s: Column) -> Column:
    """Whether a proposed match of a kind stands."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), _part_ok)
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(s, "[^A-Z0-9]", "")).between(15, 34), mod97(s)).otherwise(False)
    return F.lit(True)


#: Items that a running value goes over before its results are put aside.
RUN = 64


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of what ``step`` puts into ``out`` of its state, a struct (at, out), as it goes over ``items``; ``kind``: the type of ``out``.

    Appending copies an array, so results are gathered in runs, and the runs in an array of arrays.
    """
    def one(acc: Column, run: Column) -> Column:
        state = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
        done = F.aggregate(F.slice(items, run * RUN + 1, RUN), state, step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    runs = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")))
    return F.aggregate(runs, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: F.flatten(acc["out"]))


def _proposals(k: Kind, text: Column) -> Column:
    """Array of (kind, start, end, score, text) of the confirmed matches of one kind; null where there are none."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    gaps = F.split(text, k.pattern, -1)
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct(end.alias("at"), F.when(confirmed(k.name, x["match"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    placed = running(pairs, F.lit(0), step, "array<struct<start:int,end:int,match:string,before:string>>")
    near = lambda x: x["before"].rlike(rf"(?i)\b(?:{k.context})")
    scored = F.transform(
        placed,
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), x["end"].alias("end"), F.lit(k.name).alias("kind"), F.when(near(x), F.least(F.lit(1.0), F.lit(k.score + 0.2))).otherwise(F.lit(k.score)).alias("score"), x["match"].alias("match")),
    )
    return F.when(text.rlike(k.hint), scored)


NONE = "array<struct<start:int,rank:int,end:int,kind:string,score:double,match:string>>"


def find(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` plus ``__spans``: all confirmed spans by start, then kind in listed order."""
    a = docs.withColumn("__t", text_of(text))
    a = a.withColumns({f"__k{i}": _proposals(k, F.col("__t")) for i, k in enumerate(KINDS)})
    empty = F.array().cast(NONE)
    base = [F.coalesce(F.col(f"__k{i}"), empty) for i in range(len(BASE))]
    added = [F.filter(F.coalesce(F.col(f"__k{i}"), empty), lambda x: x["score"] >= min_score) for i in range(len(BASE), len(KINDS))]
    some = F.coalesce(*[F.col(f"__k{i}") for i in range(len(KINDS))]).isNotNull()
    a = settled(a, F.when(some, F.sort_array(F.concat(*base, *added))).otherwise(empty), "__spans")
    return a.drop("__t", *[f"__k{i}" for i in range(len(KINDS))])


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<KIND>``; of overlapping spans the leftmost, then first-listed, stands, widened over those it overlaps.

    Spans are taken in runs; a run's part of the text is cut out once, and its gaps from that.
    """
    def one(acc: Column, run: Column) -> Column:
        own = F.slice(spans, run * RUN + 1, RUN)
        part = F.substring(text, acc["at"] + 1, F.array_max(F.transform(own, lambda x: x["end"])) - acc["at"])

        def step(state: Column, x: Column) -> Column:
            gap = F.substring(state["part"], state["at"] - acc["at"] + 1, x["start"] - state["at"])
            new = F.concat(state["out"], F.array(gap, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))
            ahead = x["start"] >= state["at"]
            return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(ahead, new).otherwise(state["out"]).alias("out"), state["part"].alias("part"))

        done = F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"), part.alias("part")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))[0]

    runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(runs, start, one, end))


def redact_documents(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """All rows and columns of ``docs``, spans in the text replaced; ``n_chars``, where there is one, follows the text."""
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__text"))
    a = find(a, "__text", min_score)
    changed = F.size("__spans") > 0
    a = a.withColumn("__new", F.when(changed, redact(F.col("__text"), F.col("__spans"))).otherwise(F.col("__text")))
    out = []
    for f in docs.schema.fields:
        c = F.col("__doc").getField(f.name)
        if f.name == text:
            c = F.col("__new")
        elif f.name == "n_chars":
            c = F.when(changed, F.length("__new").cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return a.select(*out)


def query(docs: DataFrame) -> DataFrame:
    """op9: counts and digests of the spans; scores beside them."""
    a = find(docs.select("doc_id", "text"))
    s = F.col("__spans")
    base = F.filter(s, lambda x: x["rank"] < len(BASE))
    counts = {k.name: count_of(s, k.name).alias(f"n_{k.name}") for k in KINDS}
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 1)), ",")
    own, more = ([counts[k.name] for k in kinds] for kinds in (BASE, ADDED))
    return a.select("doc_id", *own, F.sha2(digest(base), 256).alias("base_sha256"), digest(s).alias("spans"), *more, scores.alias("scores"))
