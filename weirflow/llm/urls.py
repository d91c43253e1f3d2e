"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path prefix; one fits its host and all subdomains where the path starts with the
rule's. Of several that fit, the longest (host and path together) wins, ties going to ``block``. URLs that
a rule decides are the labelled examples; boosted trees learn from them what a blocked URL looks like and
judge the URLs that no rule fits.

The labels are the rules' own verdicts, for no others are given; the model generalises the rules.

Features are lexical and come from built-in string functions: lengths of host and path, depth, share of
digits, entropy of the characters, numbers of parameters and hyphens, host levels, scheme, and for the
last host label and the first path segment the smoothed share of blocked URLs among the labelled ones
(suffix statistics, gathered over all labelled URLs). A labelled URL has the shares of all others, without its own
label. The statistics are broadcast up to ``STATISTICS`` rows, else joined.

Training takes at most ``TRAIN_ROWS`` labelled URLs, those whose hash comes first; the statistics and the
verdicts cover all. Where the labelled URLs are of one class or there are none, that class (else
``allow``) is the verdict of the method.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule and is judged
by the model like any other; very long ones are read whole; repeated rows are judged each on their own; an empty table gives an empty
result; other columns do not enter. The main path is DataFrame operations and the DataFrame-based trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, LOWER, cut

TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 3, 7
#: Suffix statistics: labelled URLs that a value without any counts as having, half of them blocked.
PRIOR = 20.0
STATISTICS = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
FEATURES = ("host_len", "path_len", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_levels", "https", "has_fragment", "path_digits", "suffix_rate", "segment_rate")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(f"`{url}`")
    return pages.withColumns({"host": host_of(u), "path": path_of(u)})


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (name, verdict) of the longest fitting rule, null where none fits."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Bits a character: over the sorted characters, runs of equal ones are the counts."""
    chars = F.array_sort(F.split(s, ""))
    n = F.size(chars)
    runs = F.regexp_extract_all(F.array_join(chars, ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    bits = F.aggregate(runs, F.lit(0.0), lambda a, r: a - F.length(r) / n * F.log2(F.length(r) / n))
    return F.when(F.length(s) > 1, bits).otherwise(0.0)


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, last host label, first path segment and the features that need no statistics."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    a = split_url(pages, url)
    d = lambda c: c.cast("double")
    count = lambda c, drop: F.length(c) - F.length(F.translate(c, drop, ""))
    ratio = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    return a.withColumns(
        {
            "label": F.coalesce(F.element_at(F.split("host", r"\."), -1), F.lit("")),
            "segment": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")),
            "host_len": d(F.length("host")),
            "path_len": d(F.length("path")),
            "depth": d(count(F.col("path"), "/")),
            "digit_ratio": d(ratio(count(u, "0123456789"), F.length(u))),
            "entropy": d(_entropy(u)),
            "n_params": d(F.when(u.contains("?"), count(u, "&") + 1).otherwise(0)),
            "n_hyphens": d(count(u, "-_")),
            "n_levels": d(count(F.col("host"), ".")),
            "https": d(u.startswith("https://").cast("int")),
            "has_fragment": d(u.contains("#").cast("int")),
            "path_digits": d(count(F.col("path"), "0123456789")),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(what, value, blocked, n): labelled URLs and blocked ones by last host label and by first path segment."""
    pairs = F.explode(F.array(F.struct(F.lit("suffix").alias("what"), F.col("label").alias("value")), F.struct(F.lit("segment").alias("what"), F.col("segment").alias("value"))))
    return labelled.select(pairs.alias("p"), "blocked").groupBy("p.what", "p.value").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n"))


def with_statistics(urls: DataFrame, stats: DataFrame, own: str | None = None, most: int = STATISTICS) -> DataFrame:
    """``urls`` plus suffix_rate and segment_rate, the smoothed shares of blocked ones. ``own``: a column with the row's label, which is left out."""
    small = stats.count() <= most
    less, one = (F.col(own), F.lit(1)) if own else (F.lit(0), F.lit(0))
    for what, key in (("suffix", "label"), ("segment", "segment")):
        of = stats.filter(F.col("what") == what).select(F.col("value").alias(f"__{key}"), F.col("blocked").alias("__blocked"), F.col("n").alias("__n"))
        rate = (F.col("__blocked") - less + PRIOR / 2) / (F.col("__n") - one + PRIOR)
        met = urls.join(F.broadcast(of) if small else of, F.col(key) == F.col(f"__{key}"), "left")
        urls = met.withColumn(f"{what}_rate", F.coalesce(rate, F.lit(0.5))).drop(f"__{key}", "__blocked", "__n")
    return urls


def train(labelled: DataFrame, rows: int = TRAIN_ROWS):
    """Boosted trees on at most ``rows`` labelled URLs with statistics; null where one class is missing."""
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(rows)
    sample = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", F.col("blocked").cast("double").alias("y")).coalesce(2))
    if sample.select("y").distinct().count() < 2:
        return None
    return GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(sample)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url", rows: int = TRAIN_ROWS) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and the model's score (null where a rule decides)."""
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("__keep")
    a = lexical(pages.select(carried, F.col(f"`{url}`").alias("url")), "url")
    a = a.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    labelled = a.filter(F.col("__rule").isNotNull()).withColumn("blocked", (F.col("__rule.verdict") == "block").cast("int")).drop("__keep")
    stats = cut(suffix_statistics(labelled))
    model = train(with_statistics(labelled, stats, "blocked"), rows)
    if model is None:
        only = labelled.select("blocked").limit(1).collect()
        scored = a.withColumn("__p", F.lit(float(only[0][0]) if only else 0.0))
    else:
        full = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(with_statistics(a, stats))
        model.setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("__prob").setPredictionCol("__pred")
        scored = model.transform(full).withColumn("__p", F.get(vector_to_array("__prob"), F.lit(1)))
    ruled = F.col("__rule").isNotNull()
    return scored.select(
        *[F.col("__keep").getField(c).alias(c) for c in keep],
        "host",
        "path",
        F.col("__rule.name").alias("rule"),
        F.when(ruled, F.col("__rule.verdict")).otherwise(F.when(F.col("__p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(~ruled, F.col("__p")).alias("score"),
    )


def query(pages: DataFrame) -> DataFrame:
    """op10: the verdict of every page's url."""
    return judge(pages)
