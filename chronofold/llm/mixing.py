"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over hashed words, trained on a labelled table, gives each document a
posterior over domains. Rates r >= 0 are then fitted so that the expected tokens of each domain,
the sum of rate * tokens * posterior, match their targets, by projected gradient steps on the
squared relative errors. A document is moved from rate 1 by the inner product of its posterior with one
number for each domain, the sum of the gradients so far, and projected onto the bounds; so a step
changes these few numbers only. It is scaled by the curvature of the documents that no bound holds (a Newton step), and shortened
where it would lead up. A step is one aggregation, of which a number for each domain and for each pair of domains
comes back. Of all rates that meet the targets those nearest to 1 are found: their distance from 1 counts beside the
errors, first by a tenth and then by less and less, to a millionth. Rates have no upper bound unless one is given, so that a rare domain is repeated as often as its target asks.

The classifier is fitted on at most `sample_rows` labelled rows, those with the least hash of
their key, and keeps at most 2^16 hashed words; that table alone is broadcast.

Defined results: null and empty texts have no tokens and the prior as posterior; without labelled
rows all domains are equally likely. Rows that share a key are one document for the classifier and
get one rate. Ties, repeated rows and extra columns change nothing; an empty table gives no rows;
columns named like the results are replaced.
"""

from __future__ import annotations

import copy
import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import least_hashes, written

BUCKET_BITS = 16
#: A hashed word speaks for a domain if its count there is so many standard deviations off.
LEAST_Z = 5.0


def features(text: Column) -> Column:
    """Words without case and closing signs, what follows a word's letters instead where that is
    something else, and one feature for the share of distinct words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    plain = lambda w: F.when(w.rlike(r"[\p{L}.,]$"), F.rtrim(w, F.lit(".,"))).otherwise(F.concat(F.lit("#"), F.right(w, F.lit(3))))
    share = lambda ws: F.concat(F.lit("#distinct"), F.floor(10 * F.size(F.array_distinct(ws)) / F.greatest(F.size(ws), F.lit(1))).cast("string"))
    return F.transform(F.array(words), lambda ws: F.concat(F.transform(ws, plain), F.array(share(ws))))[0]


def _bucket(feature: str) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(1 << BUCKET_BITS)).cast("int")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", sample_rows: int = 20_000) -> tuple[DataFrame, list[float]]:
    """(weights by bucket, prior) from labelled (key, domain) rows."""
    sample = labelled.where(F.col("domain").isin(domains)).select(F.col(key).alias("k"), "domain")
    sample = least_hashes(sample, sample_rows, "k", "domain")
    seen = docs.select(F.col(key).alias("own"), F.col(text).alias("t")).join(F.broadcast(sample), F.col("own") == F.col("k")).select("domain", F.explode(features(F.col("t"))).alias("f"))
    counts = seen.groupBy(_bucket("f").alias("bucket")).agg(*(F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"c{i}") for i, d in enumerate(domains)))
    counts = written(counts, "word-counts")
    n = counts.agg(*(F.sum(f"c{i}") for i in range(len(domains)))).first()
    n = [x or 0.0 for x in n]
    total = sum(n)
    share = [x / total if total else 1 / len(domains) for x in n]
    every = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0.0))
    expected = [every * s for s in share]
    z = F.greatest(*(F.abs(F.col(f"c{i}") - e) / F.sqrt(e + 1) for i, e in enumerate(expected)), F.lit(0.0))
    weights = [F.log((F.col(f"c{i}") + 2 * s + 1e-9) / (e + 2 * s + 1e-9)).alias(f"w{i}") for i, (s, e) in enumerate(zip(share, expected, strict=True))]
    per_domain = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    rows = sum(per_domain.values())
    prior = [(per_domain.get(d, 0) + 1) / (rows + len(domains)) for d in domains]
    return counts.where(z >= LEAST_Z).select("bucket", *weights), prior


def posteriors(docs: DataFrame, weights: DataFrame, prior: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, posterior) of each key that has a document."""
    words = docs.select(F.col(key), F.explode(features(F.col(text))).alias("f")).select(key, _bucket("f").alias("bucket"))
    scores = [F.sum(F.coalesce(f"w{i}", F.lit(0.0))) + F.lit(math.log(p)) for i, p in enumerate(prior)]
    # At most 2^16 rows of one number for each domain.
    per = words.join(F.broadcast(weights), "bucket", "left").groupBy(key).agg((F.count("*") - 1).alias("tokens"), *(s.alias(f"s{i}") for i, s in enumerate(scores)))
    top = F.greatest(*(F.col(f"s{i}") for i in range(len(prior)))) if len(prior) > 1 else F.col("s0")
    raised = F.array(*(F.exp(F.col(f"s{i}") - top) for i in range(len(prior))))
    return per.select(key, "tokens", F.transform(F.array(raised), lambda e: F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 9)))[0].alias("posterior"))


def _pull(by: list[float]) -> Column:
    """The inner product of a document's posterior with a number for each domain."""
    return sum((F.get("posterior", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(by)), F.lit(0.0))


def _rate(price: list[float], least: float, most: float) -> Column:
    """The rate within its bounds that is nearest to 1 less the price of the document's tokens."""
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), 1 - _pull(price)))


class _Step:
    """Where one price leads: the totals by domain, the objective with its gradient, and the curvature of the documents between the bounds."""

    def __init__(self, soft: DataFrame, price: np.ndarray, goal: np.ndarray, ridge: np.ndarray, least: float, most: float):
        d = len(goal)
        p = [F.get("posterior", F.lit(i)) for i in range(d)]
        pull, rate, t = _pull(price.tolist()), _rate(price.tolist(), least, most), F.col("tokens")
        free = ((1 - pull) >= least) & ((1 - pull) <= most)
        value = F.sum(t * ((rate - 1) * (rate - 1) / 2 + pull * rate))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        found = soft.agg(value, *(F.sum(t * x * rate) for x in p), *(F.sum(F.when(free, t * p[i] * p[j])) for i, j in pairs)).first()
        found = [x or 0.0 for x in found]
        self.price, self.totals, self._inner = price, np.array(found[1 : d + 1]), -found[0] + float(goal @ price)
        self._goal, self._free = goal, np.zeros((d, d))
        for (i, j), x in zip(pairs, found[d + 1 :], strict=True):
            self._free[i, j] = self._free[j, i] = x
        self._add(ridge)

    def _add(self, ridge: np.ndarray) -> None:
        self.value = self._inner + float(ridge @ (self.price * self.price)) / 2
        self.gradient = self._goal - self.totals + ridge * self.price
        self.curvature = self._free + np.diag(ridge)

    def with_ridge(self, ridge: np.ndarray) -> _Step:
        """The same place, seen with another ridge."""
        other = copy.copy(self)
        other._add(ridge)
        return other


def fit_rates(soft: DataFrame, targets: list[float] | None = None, weights: list[float] | None = None, least: float = 0.0, most: float = math.inf, steps: int = 60, tolerance: float = 1e-3, reached: list[tuple[float, float]] | None = None) -> DataFrame:
    """`soft` with the column rate. targets: tokens by domain, or weights: their shares of all tokens.

    Steps go on until all relative errors are within `tolerance`, or the projected gradient vanishes: then no rates come nearer to
    the targets, by the sum of the squared relative errors. Tokens (reached, target) of each domain are added to
    `reached`. A warning tells of targets not met, and whether it is proved that no rates within the bounds meet them.
    """
    d = len(targets or weights or [])
    at_one = np.array([x or 0.0 for x in soft.agg(*(F.sum(F.col("tokens") * F.get("posterior", F.lit(i))) for i in range(d))).first()])
    total = float(at_one.sum())
    goal = np.array(targets, dtype=float) if targets is not None else np.array(weights, dtype=float) * total / sum(weights)
    price, now = np.zeros(d), at_one
    if total:
        scale = np.maximum(at_one, 1e-6 * total)
        ridges = [10.0**-k * scale * scale / total for k in range(1, 7)]
        bound = _Step(soft, price, goal, ridges[0], -math.inf, math.inf).curvature
        here, done, error = _Step(soft, price, goal, ridges[0], least, most), 0, (at_one - goal) / scale
        for ridge in ridges:
            here = here.with_ridge(ridge)
            while True:
                now = here.totals
                error = (now - goal) / scale
                if np.abs(error).max() <= tolerance or np.abs(here.gradient / scale).max() <= 0.1 * tolerance or done >= steps:
                    break
                # Full, shortened, and at last by the curvature of all documents, which no step of its own leads up.
                ways = [-np.linalg.solve(here.curvature, here.gradient) * length for length in (1.0, 0.25)]
                for way in [*ways, -np.linalg.solve(bound, here.gradient)]:
                    there = _Step(soft, here.price + way, goal, ridge, least, most)
                    done += 1
                    if there.value <= here.value + 1e-4 * float(here.gradient @ way):
                        break
                if there.value >= here.value:
                    break
                here = there
            if np.abs(error).max() <= tolerance:
                break
        price = here.price
        if np.abs(error).max() > tolerance:
            # Weighted so, what any rates within the bounds add up to is more than what the targets do.
            against = error / scale
            if math.isinf(most):
                low = soft.where("tokens > 0").agg(F.min(_pull(against.tolist()))).first()[0] or 0.0
                against = against + max(0.0, -low)
            pull = _pull(against.tolist())
            bound = F.lit(float(least)) if math.isinf(most) else F.when(pull > 0, F.lit(float(least))).otherwise(F.lit(float(most)))
            proved = (soft.agg(F.sum(F.col("tokens") * pull * bound)).first()[0] or 0.0) > float(against @ goal)
            warnings.warn(f"tokens by domain are {[round(x) for x in now.tolist()]} after {done} steps, targets {[round(x) for x in goal.tolist()]}" + ("; no rates meet them" if proved else ""), stacklevel=2)
    if reached is not None:
        reached.extend(zip(now.tolist(), goal.tolist(), strict=True))
    return soft.withColumn("rate", F.round(_rate(price.tolist(), least, most), 6))


def mix(docs: DataFrame, labelled: DataFrame, domains: list[str], targets: Mapping[str, float | None] | None = None, weights: Mapping[str, float] | None = None, shares: Mapping[str, float] | None = None, key: str = "doc_id", text: str = "text", least: float = 0.0, most: float = math.inf, reached: list[tuple[float, float]] | None = None) -> DataFrame:
    """(key, tokens, posterior, rate) of each key.

    targets: tokens by domain, None for what it has; shares: of what each domain has; weights: of the tokens of all. `reached` as for `fit_rates`.
    """
    slim = docs.select(key, text)
    soft = written(posteriors(slim, *fit(slim, labelled, domains, key, text), key, text), "posteriors")
    if weights is None:
        has = soft.agg(*(F.sum(F.col("tokens") * F.get("posterior", F.lit(i))) for i in range(len(domains)))).first()
        wanted = [(shares[d] if shares else 1.0) * (h or 0.0) if not targets or targets[d] is None else targets[d] for d, h in zip(domains, has, strict=True)]
        return fit_rates(soft, targets=wanted, least=least, most=most, reached=reached)
    return fit_rates(soft, weights=[weights[d] for d in domains], least=least, most=most, reached=reached)


def copies(rate: Column, *key: str) -> Column:
    """How often to take a document: the rate, rounded up or down with the odds of its fraction, by hash."""
    odds = F.pmod(F.xxhash64(F.lit(7), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (odds < rate - F.floor(rate)).cast("long")).cast("long")
