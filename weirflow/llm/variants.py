r"""Spelling variants: words at one edit from a far more frequent one are grouped under it.

The vocabulary is a trie, partitioned by prefix. Two words at distance one either share their first ``depth`` characters,
and then lie in one partition, or they differ inside these, and then all that follows is equal: they meet under
their common rest, in the trie of their first characters. In each such group the sub-trie is walked from its root; every node has the set of
its active nodes, those at distance one, which follows from its parent's set alone: an active node's child by the
same character, the parent, the siblings and the children. Where a node and an active node both end words, a pair is found.

A pair belongs to the place of its edit, the length of the common prefix, so it is found in one group only. Groups of
more than ``GROUP_WORDS`` words (or too many characters) are found by counts of the hashes of their keys, before anything is
brought together, and cut again: a longer prefix for the one part, the range of places before it for the other, ranges in halves.
A range of one place leaves as many words as there are characters, so a group never grows with the vocabulary; every
pair that shares a key after that is one to report or differs by one more character.

Words are counted by an aggregation that combines before the shuffle. A word's form is its near word of most
occurrences (ties: the first in code-point order) if that has ``ratio`` times its own; roots follow forms to the last by pointer
doubling, as many rounds as the logarithm of the longest chain, which has at most one step for each factor of ``ratio``.

Defined results: null and empty texts have no words; a null id counts as an empty one in the draw of deletions; very long
texts are read whole, very long words are words; ties are settled by code points; repeated rows count each; an empty
table gives an empty result; other columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, text_of

#: Letters of words: a run of these.
LETTERS = r"A-Za-zÀ-ÿ"
#: Characters of the prefix that first divides the trie.
DEPTH = 4
#: Groups of more words, or of more characters in more than a few words, are cut again.
GROUP_WORDS, GROUP_CHARS, FEW = 20_000, 1_000_000, 16
#: Shares of all hashes of keys that are counted before single keys are.
SHARES = 1 << 14
#: The end of a range of places that has none.
OPEN = 1 << 30


def lowered(run: Column) -> Column:
    """A-Z in lower case, other capitals as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words_of(docs: DataFrame, min_chars: int = 7, noise: int = 31, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence of a word of ``min_chars`` characters or more; where ``noise`` divides the run's hash, without one of its characters."""
    run = F.explode(F.regexp_extract_all(text_of(F.col(f"`{text}`")), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__id"), run.alias("__run"))
    rows = rows.select("__id", lowered(F.col("__run")).alias("word"))
    h = F.crc32(F.concat(F.col("__id"), F.lit(":"), F.col("word")).cast("binary"))
    gone = (h % F.length("word")).cast("int")
    word = F.when(h % noise == 0, F.concat(F.substring("word", F.lit(1), gone), F.substring(F.col("word"), gone + 2, F.length("word")))).otherwise(F.col("word"))
    return rows.select(word.alias("word")).where(F.length("word") >= min_chars)


def vocabulary(words: DataFrame, min_count: int = 2) -> DataFrame:
    """Each word of at least ``min_count`` occurrences with their number, n."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _placed(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """(word, n, a, b, rest, key): the groups where pairs meet whose edit is at a place from ``start`` to before ``stop``.

    The key is what both words share: the characters before a, and those after b (after b + 1 for the longer word of two);
    ``rest`` is how many the latter are.
    """
    length, word = F.length("word"), F.col("word")
    longer = F.when(stop >= OPEN, F.array(F.lit(0))).when(length > stop, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("word", "n", start.cast("int").alias("a"), stop.cast("int").alias("b"), F.explode(longer).alias("__more"))
    a, b = F.col("a"), F.col("b")
    # with an open end both words reach as far as the prefix
    rows = rows.where((length >= a) | (b < OPEN))
    rest = F.when(b < OPEN, F.substring(word, b + F.col("__more") + 1, F.length(word))).otherwise("")
    return rows.select("word", "n", "a", "b", F.length(rest).alias("rest"), F.concat_ws("\x00", F.substring(word, F.lit(1), a), rest, a.cast("string"), b.cast("string")).alias("key"))


def near_words(middles: list[str], width: int) -> Iterator[tuple[int, int]]:
    """Places in ``middles`` (all different) of the pairs at distance one whose edit comes before ``width``.

    A middle is what a word has between what all of the group share; it has ``width`` characters, or one more in
    the longer word of two, or fewer where nothing follows.
    """
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, m in enumerate(middles):
        at = 0
        for c in m:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    stack = [(0, set(kids[0].values()))]
    while stack:
        node, active = stack.pop()
        end = ends[node]
        if end >= 0:
            for v in active:
                if v > node and ends[v] >= 0 and _inside(middles[end], middles[ends[v]], width):
                    yield end, ends[v]
        children = kids[node]
        for c, to in children.items():
            found = {x for v in active if (x := kids[v].get(c))}
            found.add(node)
            found.update(children.values())
            found.update(kids[to].values())
            found.discard(to)
            stack.append((to, found))


def _inside(x: str, y: str, width: int) -> bool:
    """Whether the edit between two middles at distance one comes before ``width``; pairs of two longer ones meet elsewhere."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    return len(short) <= width and not (len(short) == width < len(long) and long.startswith(short))


def _members(groups: DataFrame) -> DataFrame:
    members = groups.groupBy("key", "a", "b", "rest").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")).where(F.size("words") > 1)
    return members.select("a", "b", "rest", "words", "ns")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int], Iterator[tuple[int, int]]]]:
    """Words, their n and the places of pairs, of every group."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b, rest, words = (row[k] for k in ("a", "b", "rest", "words"))
            yield words, row["ns"], near_words([w[a : len(w) - rest] for w in words], b - a)


def _pairs(groups: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of every pair in the groups, the first of the two in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ns, places in _found(batches):
            places = [(i, j) if words[i] < words[j] else (j, i) for i, j in places]
            if places:
                columns = ((words, 0), (ns, 0), (words, 1), (ns, 1))
                arrays = [pa.array([of[p[k]] for p in places], pa.string() if of is words else pa.int64()) for of, k in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "near", "near_n"])

    return _members(groups).mapInArrow(run, "word string, n long, near string, near_n long")


def _summed(groups: DataFrame, ratio: int) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a pair in its group: folded there, so that no pair is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        for words, ns, places in _found(batches):
            count: dict[int, int] = {}
            best: dict[int, int] = {}
            for pair in places:
                for i, j in (pair, pair[::-1]):
                    count[i] = count.get(i, 0) + 1
                    if ns[j] >= ratio * ns[i] and ((k := best.get(i)) is None or (-ns[j], words[j]) < (-ns[k], words[k])):
                        best[i] = j
            for i, c in count.items():
                j = best.get(i)
                for column, value in zip(out, (words[i], c, None if j is None else words[j], None if j is None else ns[j])):
                    column.append(value)
            if len(out[0]) > 10_000:
                yield _rows(out)
                out = ([], [], [], [])
        yield _rows(out)

    return _members(groups).mapInArrow(run, "word string, n_near long, form string, form_n long")


def _rows(out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "form", "form_n"])


def _hot(groups: DataFrame) -> DataFrame:
    """Hashes of the keys with too many words. Counted by a few thousand shares of all hashes first: what a light one holds needs no count of its own."""
    hashed = groups.where(F.col("b") - F.col("a") > 1).select(F.xxhash64("key").alias("__h"), F.length("word").alias("__c"))
    many = (F.count("*") > GROUP_WORDS) | ((F.sum("__c") > GROUP_CHARS) & (F.count("*") > FEW))
    share = F.pmod("__h", F.lit(SHARES))
    heavy = [r[0] for r in hashed.groupBy(share.alias("s")).agg(many.alias("m")).where("m").select("s").collect()]  # SHARES rows at most
    rows = hashed.where(share.isin(heavy)) if heavy else hashed.limit(0)
    return cut(rows.groupBy("__h").agg(many.alias("m")).where("m").select("__h"))


def grouped(words: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, bool]:
    """Groups of bounded size where all pairs of ``words`` (different words and their n) meet; and whether a pair may meet twice."""
    pending = _placed(words, F.lit(0), F.lit(depth)).unionByName(_placed(words, F.lit(depth), F.lit(OPEN)))
    done, step = None, depth
    while True:
        hot = _hot(pending)
        if hot.isEmpty():
            return (pending, False) if done is None else (done.unionByName(pending), True)
        hashed = pending.withColumn("__h", F.xxhash64("key"))
        cold = hashed.join(hot, "__h", "left_anti").drop("__h")
        done = cold if done is None else done.unionByName(cold)
        # a word may be in two hot groups of one range, as the shorter and as the longer one
        again = cut(hashed.join(hot, "__h", "left_semi").select("word", "n", "a", "b").distinct())
        middle = F.when(F.col("b") >= OPEN, F.col("a") + step).otherwise(F.floor((F.col("a") + F.col("b")) / 2))
        pending = cut(_placed(again, F.col("a"), middle).unionByName(_placed(again.withColumn("__m", middle), F.col("__m"), F.col("b"))))
        step *= 2


def near_pairs(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, n, near, near_n): every two words at distance exactly one, once, the first of the two in front."""
    groups, twice = grouped(words, depth)
    return _pairs(groups).distinct() if twice else _pairs(groups)  # a cut range may meet a pair that a group left whole has met


def forms(words: DataFrame, ratio: int = 10, depth: int = DEPTH) -> DataFrame:
    """word, n, n_near, form and form_n of every word."""
    groups, twice = grouped(words, depth)
    if twice:
        sides = [("word", "n", "near", "near_n"), ("near", "near_n", "word", "n")]
        both = F.explode(F.array(*[F.struct(*[F.col(c).alias(k) for c, k in zip(side, "wnvm")]) for side in sides]))
        far = F.col("p.m") >= ratio * F.col("p.n")
        near = _pairs(groups).distinct().select(both.alias("p")).select(F.col("p.w").alias("word"), F.lit(1).cast("long").alias("n_near"), F.when(far, F.col("p.v")).alias("form"), F.when(far, F.col("p.m")).alias("form_n"))
    else:
        near = _summed(groups, ratio)
    none = F.lit(None)
    rows = near.withColumn("n", none.cast("long")).unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("string").alias("form"), none.cast("long").alias("form_n")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word"))))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return rows.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed`` plus root: the last word that forms lead to, the word itself where it has none."""
    links = cut(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        jumped = cut(links.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        links = jumped.drop("__moved")
        if jumped.where("__moved").isEmpty():
            return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, ratio: int = 10, depth: int = DEPTH) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n)."""
    words = cut(words.select("word", "n"))
    formed = cut(forms(words, ratio, depth))
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    """op11: the words of 7 characters or more that occur twice, with their forms and roots."""
    return variants(vocabulary(words_of(docs)))
