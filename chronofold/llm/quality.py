"""Quality rules learned from labels.

The statistics of a text are expressions. A decision list is learned from those of labelled rows by
sequential covering: a rule, a conjunction of thresholds, grows by the condition with the greatest
information gain, is pruned on rows held back, and is kept if it is right there often enough; the
rows that it covers leave the training set. The list becomes one ordered CASE expression.

The list is learned on at most `sample_rows` labelled rows, those with the least hash of their key.

Defined results: null and empty texts have no words and fail the base rule. Without labelled rows,
or where no rule is good enough, all that pass the base rules are kept. Rows don't affect one another;
extra columns pass through and columns named like the statistics are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import SPACE_CLASS, fresh, least_hashes, written

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _alike(sorted_: Column, same) -> Column:
    """Of a sorted array, the members that are the `same` as a neighbour."""
    like = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    return _let(sorted_, lambda s: F.filter(s, lambda x, i: like(x, F.get(s, i - 1)) | like(x, F.get(s, i + 1))))


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in windows of n words that are found twice or more in the text.

    First a window's hash and, in the lowest bits, its place make one number; sorted, windows that may be
    equal are neighbours. The words of these few, sorted with their places, tell which are.
    """
    none = F.lit(0).cast("long")

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n))))
        #: Bits that hold any place; shiftleft takes a column of them only in SQL.
        bits = F.ceil(F.log2(F.size(w) + F.lit(1.0))).cast("int")

        def places(k: Column) -> Column:
            coded = F.sort_array(_let(windows, lambda h: F.transform(h, lambda x, i: F.call_function("shiftleft", x, k).bitwiseOR(i.cast("long")))))
            group = lambda x: F.call_function("shiftrightunsigned", x, k)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
            return F.transform(_alike(coded, lambda x, y: group(x) == group(y)), lambda x: x.bitwiseAND(mask).cast("int"))

        def covered(at: Column) -> Column:
            named = F.sort_array(F.transform(at, lambda p: F.struct(*(F.get(w, p + k).alias(f"w{k}") for k in range(n)), p.alias("p"))))
            same = lambda x, y: reduce(and_, (x[f"w{k}"] == y[f"w{k}"] for k in range(n)))
            real = F.sort_array(F.transform(_alike(named, same), lambda x: x["p"].cast("long")))
            gaps = _let(real, lambda p: F.transform(p, lambda x, i: F.least(F.lit(n).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(n).cast("long")))))
            return F.aggregate(gaps, none, lambda a, g: a + g)

        return _let(_let(bits, places), lambda at: F.when(F.size(at) == 0, none).otherwise(covered(at)))

    return _let(words, of)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with the statistics of their texts."""
    docs = docs.drop(*STATISTICS)
    by = fresh(docs, "words")
    t = F.coalesce(F.col(text), F.lit(""))

    def count(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")

    words = F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda w: w != "")
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    twice = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select("*", by_word.alias(by), count(r"[#*$%&|<>]+").alias("n_symbols"), twice.alias("n_dup_lines"), count("[A-Z]+").alias("n_upper"), count("!+").alias("n_marks"))
    return out.select(*docs.columns, *(F.col(f"{by}.{c}" if c in ("n_words", "word_chars", "n_repeat_words") else c).alias(c) for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _feature(name: str) -> Column:
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return F.col(name).cast("double")


FEATURES = (*RATIOS, "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        f = _feature(self.feature)
        return f > self.threshold if self.above else f <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(bad: list[dict], good: list[dict], most: int = 4) -> Rule:
    """Conditions with the greatest gain of information, until no good row is covered."""
    rule: Rule = ()
    while bad and good and len(rule) < most:
        was = math.log2(len(bad) / (len(bad) + len(good)))
        best, gain = None, 1e-9
        for f in FEATURES:
            rows = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
            p_all, n_all = len(bad), len(good)
            p = n = 0
            for k, (v, is_bad) in enumerate(rows[:-1]):
                p, n = p + is_bad, n + 1 - is_bad
                if rows[k + 1][0] == v:
                    continue
                at = (v + rows[k + 1][0]) / 2
                for above, x, y in ((False, p, n), (True, p_all - p, n_all - n)):
                    if x and (g := x * (math.log2(x / (x + y)) - was)) > gain:
                        best, gain = Condition(f, above, at), g
        if best is None:
            break
        rule = (*rule, best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def learn(bad: list[dict], good: list[dict], least_precision: float = 0.95, least_cover: int = 5, most_rules: int = 12) -> list[Rule]:
    """Ordered rules that cover rows of low quality; every third row is held back for pruning."""
    rules: list[Rule] = []
    while len(rules) < most_rules and len(bad) >= least_cover:
        grow = [[r for i, r in enumerate(x) if i % 3] for x in (bad, good)]
        prune = [[r for i, r in enumerate(x) if i % 3 == 0] for x in (bad, good)]
        rule = _grow(*grow)

        def worth(rule: Rule, held: list[list[dict]] = prune) -> tuple[float, int]:
            p, n = (sum(_covers(rule, r) for r in x) for x in held)
            return (p - n) / (p + n) if p + n else -1.0, p

        shorter = [rule[:k] for k in range(len(rule), 0, -1)]
        if not shorter:
            break
        rule = max(shorter, key=worth)
        p, n = (sum(_covers(rule, r) for r in x) for x in (bad, good))
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(rule)
        bad, good = [r for r in bad if not _covers(rule, r)], [r for r in good if not _covers(rule, r)]
    return rules


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 6000) -> list[Rule]:
    """Rules from labelled (key, good) rows; good is a boolean."""
    sample = least_hashes(labelled.where(F.col("good").isNotNull()).select(F.col(key).alias("k"), "good"), sample_rows, "k", "good")
    seen = docs.select(F.col(key).alias("own"), F.col(text).alias("t")).join(F.broadcast(sample), F.col("own") == F.col("k")).select("k", "good", "t")
    # Written, or else the filter on the statistics would be moved before the join, to all texts.
    passed = statistics(written(seen, "labelled"), "t").where(~base_failed()).select("k", "good", *(F.round(_feature(f), 6).alias(f) for f in FEATURES))
    rows = passed.orderBy(F.xxhash64("k"), "good", *FEATURES).limit(sample_rows).collect()
    values = [({f: float(r[f]) for f in FEATURES}, r["good"]) for r in rows]
    return learn([v for v, good in values if not good], [v for v, good in values if good])


def verdict(rules: list[Rule]) -> Column:
    """False for the first rule that covers a row, true where none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        every = F.lit(True)
        for c in rule:
            every = every & c.column()
        out = F.when(every, F.lit(False)).otherwise(out)
    return out
