"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit
``i`` is set where rule ``i`` failed. A policy is a named, versioned mask over these bits; applying one,
or asking how many documents a rule alone rejects, never looks at a text again.

Defined results: a null or empty text has no words, so all counts are 0 and ``short`` fails; repeated
rows are judged each on their own; very long texts are measured whole; an empty table gives an empty ledger; other columns of the input are
carried by :func:`filter_documents` whatever their names are, and do not enter :func:`ledger`.
Everything is a built-in Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements, never null


#: Bits are never reused: a changed threshold gets a new bit, so that old ledgers keep their meaning.
RULES = (
    Rule(0, "short", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "capitals", "100 * n_upper > 40 * word_chars"),
    Rule(4, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "word_length_low", "2 * word_chars < 3 * n_words"),
    Rule(6, "word_length_high", "word_chars > 30 * n_words"),
    Rule(7, "stuttering", "100 * n_stutter > 50 * n_words"),
)
BASE_MASK = 0b0000011


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


POLICIES = {
    ("base", 1): Policy("base", 1, BASE_MASK),
    ("standard", 1): Policy("standard", 1, 0b11111111),
}
STANDARD = POLICIES["standard", 1]


def _minus(text: Column, drop: str) -> Column:
    return F.translate(text, drop, "")


def _window_hashes(words: Column, n: Column) -> Column:
    """Hashes of all windows, each from the hashes of its words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    shifted = F.transform(F.array(h), lambda h: F.arrays_zip(*[F.slice(h, i + 1, n - (WINDOW - 1)) for i in range(WINDOW)]))[0]
    return F.when(n >= WINDOW, F.transform(shifted, lambda x: F.xxhash64(x)))


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a struct ``__m`` of n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words,
    n_stutter (words equal to the one before).

    Repeats: hash all 8-word windows. Where all differ (nearly all documents) the answer is 0; else sort
    (hash, position), keep positions whose neighbour has the same hash and add up what their windows cover.
    """
    a = docs.withColumn("__t", text_of(text))
    a = a.withColumn("__w", words_of(F.col("__t")))
    w, t = F.col("__w"), F.col("__t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumns({"__n": F.size(w), "__l": lines})
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: x == y)
    a = a.withColumn("__r", F.size(F.filter(pairs, lambda x: x)))
    a = a.withColumn("__h", _window_hashes(w, F.col("__n")))
    h = F.col("__h")
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    a = a.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)))
    s = F.col("__s")
    again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    a = a.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("sum"), x.alias("last")),
        lambda acc: acc["sum"],
    )
    long = lambda c: c.cast("long")
    m = F.struct(
        long(F.col("__n")).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.length(t) - F.length(_minus(t, SYMBOLS))).alias("n_symbols"),
        long(F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("n_upper"),
        long(F.size(F.col("__l"))).alias("n_lines"),
        long(F.size(F.col("__l")) - F.size(F.array_distinct(F.col("__l")))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.coalesce(F.col("__r"), F.lit(0))).alias("n_stutter"),
    )
    return settled(a, m, "__m").drop("__t", "__w", "__n", "__l", "__r", "__h", "__s", "__p")


def failure_bits(of: str = "__m") -> Column:
    """One bit a rule."""
    fields = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")

    def sql(rule: Rule) -> str:
        out = rule.fails
        for f in fields:
            out = out.replace(f, f"{of}.{f}")
        return out

    bits = [F.when(F.expr(sql(r)), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the measurements and ``fail_bits``."""
    a = measurements(docs.select(*dict.fromkeys([*keep, text])), text)
    return a.select(*keep, "__m.*", failure_bits().alias("fail_bits"))


def verdict(policy: Policy = STANDARD, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    return entries.withColumns({"policy": F.lit(f"{policy.name}-v{policy.version}"), "kept": verdict(policy)})


def ablation(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: documents failing it, and those that only it rejects, from bits alone.

    One pass over distinct bit patterns; at most 2^rules rows reach the second step.
    """
    seen = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    one = [F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("only")) for r in rules]
    each = seen.select("bits", "n", F.explode(F.array(*one)).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("only")) != 0
    return each.groupBy("bit", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("only"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("only"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they came."""
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__text"))
    a = measurements(a, "__text").withColumn("__bits", failure_bits())
    return a.filter(verdict(policy, "__bits")).select("__doc.*")


def query(docs: DataFrame) -> DataFrame:
    """op8: digest of the ledger under the standard policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )
