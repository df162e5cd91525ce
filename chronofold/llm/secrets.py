"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least 12 key characters, of any length, with a digit or in capitals
throughout; access key ids of a vendor's format within longer runs; and every value assigned to a
telling name (`_TELLING`), whatever its length and alphabet. They may overlap. The forest looks at their length, the transitions
between kinds of characters, how much of them words of a dictionary cover, and at smoothed odds of
the words next to them and of the path or source they come from, all learned from labelled findings.

The forest is fitted on at most `sample_rows` labelled findings, those with the least hash. The
dictionary has every word that makes up at least `least_share` of all words of all texts, and that
occurs `least` times; so it has at most 1 / `least_share` words, whatever the size of the table.
Neighbouring words of more than 200 characters count as none.

Defined results: null and empty texts have no candidate. Without labelled findings of both kinds
all candidates stay, with score 0.5. Equal findings in equal places get equal scores; a null path is
a path of its own. Offsets are code points, ends exclusive. Extra columns don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import least_hashes, written

#: A run of key characters with a digit, or in capitals throughout; what precedes an equal sign is no part.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9]|[A-Z0-9]++(?![A-Za-z0-9+/_\-]))[A-Za-z0-9+/_\-]{12,}+")
_VENDOR = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
#: A name and the value assigned to it, in quotes (closed or not) or up to white space, a comma or a semicolon.
_ASSIGNED = re.compile(r"""(?<![\w.\-])([\w.\-]++)["'\]]?+[ \t]*+(?::=|=>|[:=])[ \t]*+(?:"([^"\n]++)|'([^'\n]++)|([^\s"',;]++))""")
_TELLING = re.compile(r"(?i)passw(?:or)?d|passphrase|pwd|secret|token|credential|(?:api|access|account|auth|encryption|private|signing)[_.\-]?key")
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = np.full(128, 3, dtype=np.int8)
_KINDS[ord("a") : ord("z") + 1] = 0
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
FINDING = "path string, start long, end long, value string, before string, after string"
FEATURES = ("length", "lower", "upper", "digit", "changes", "lower_digit", "upper_digit", "longest_run", "distinct", "entropy", "hex", "dictionary", "assigned", "before", "after", "path")


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The word before and the word after; one that doesn't end within 200 characters is none."""
    lo, hi = max(0, start - 200), min(len(text), end + 200)
    left, right = text[lo:start], text[end:hi]
    before = None
    for before in re.finditer(r"[^\s\"']+", left):
        pass
    after = _WORD.search(right)
    known = before and (before.start() or not lo)
    return (before[0].lower() if known else ""), (after[0].lower() if after and (after.end() < len(right) or hi == len(text)) else "")


def _spans(text: str) -> list[tuple[int, int]]:
    """Places of the candidates, each once."""
    found = {m.span() for m in _CANDIDATE.finditer(text)} | {m.span() for m in _VENDOR.finditer(text)}
    for m in _ASSIGNED.finditer(text):
        if _TELLING.search(m[1]):
            start, end = m.span(m.lastindex)
            #: Padding is no part of a run, so that a run and its padding are not two values.
            bare = start + len(text[start:end].rstrip("="))
            found.add((start, bare if (start, bare) in found else end))
    return sorted(found)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A finding for each token that may be a secret: its document's key as doc_id, and the columns of FINDING."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at, (p, t) in enumerate(zip(b.column("path").to_pylist(), b.column("text"), strict=True)):
                t = t.as_py() or ""
                for i, j in _spans(t):
                    rows.append((at, p, i, j, t[i:j], *_around(t, i, j)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["doc_id", "path", "start", "end", "value", "before", "after"])

    slim = docs.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    return slim.mapInArrow(scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {FINDING}")


def dictionary(docs: DataFrame, text: str = "text", least_share: float = 1e-5, least: int = 3) -> set[str]:
    """The words of at least 3 letters that make up a share of at least `least_share` of them in all texts."""
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 3)
    counts = written(words.groupBy("w").count(), "dictionary")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return {r["w"] for r in counts.where(F.col("count") >= max(least, least_share * total)).select("w").collect()}


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _covered(value: str, words: set[str], lengths: list[int]) -> float:
    """Share of the characters that dictionary words cover, longest first from the left; `lengths` are those of the words, falling."""
    low, i, hit = value.lower(), 0, 0
    while i < len(low):
        left = len(low) - i
        n = next((n for n in lengths if n <= left and low[i : i + n] in words), 0)
        hit += n
        i += n or 1
    return hit / len(value)


@dataclass
class Odds:
    """Smoothed log-odds of a label by a name; unknown names are even."""

    table: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, names: Iterable[str | None], labels: Iterable[int], weight: float = 4.0) -> Odds:
        bad, good = Counter(), Counter()
        for n, y in zip(names, labels, strict=True):
            (bad if y else good)[n] += 1
        share = (sum(bad.values()) + 1) / (sum(bad.values()) + sum(good.values()) + 2)
        return cls({n: math.log((bad[n] + weight * share) / (good[n] + weight * (1 - share))) - math.log(share / (1 - share)) for n in bad.keys() | good.keys()})

    def __call__(self, name: str | None) -> float:
        return self.table.get(name, 0.0)


Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _tree(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rng: np.random.Generator, depth: int, leaf: int) -> Tree:
    """One tree on binned features: (feature, bin, left child, share of secrets) by node."""
    feature, split, child, share = [], [], [], []
    todo = [(np.arange(len(y)), 0, -1, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        node = len(feature)
        if parent >= 0:
            child[parent][side] = node
        p = float(y[rows].mean())
        feature.append(-1)
        split.append(0)
        child.append([0, 0])
        share.append(p)
        if level == depth or len(rows) < 2 * leaf or p in (0.0, 1.0):
            continue
        best = (1e-12, -1, 0)
        for f in rng.choice(x.shape[1], size=max(1, int(x.shape[1] ** 0.5)), replace=False).tolist():
            n = np.bincount(x[rows, f], minlength=len(edges[f]) + 1)
            k = np.bincount(x[rows, f], weights=y[rows], minlength=len(edges[f]) + 1)
            nl, kl = np.cumsum(n)[:-1], np.cumsum(k)[:-1]
            nr, kr = len(rows) - nl, k.sum() - kl
            ok = (nl >= leaf) & (nr >= leaf)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gini = np.where(ok, kl * kl / nl + (nl - kl) ** 2 / nl + kr * kr / nr + (nr - kr) ** 2 / nr, 0)
            at = int(gini.argmax())
            gain = float(gini[at]) - len(rows) * (p * p + (1 - p) ** 2)
            if gain > best[0]:
                best = (gain, f, at)
        if best[1] < 0:
            continue
        feature[node], split[node] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        todo += [(rows[low], level + 1, node, 0), (rows[~low], level + 1, node, 1)]
    return np.array(feature), np.array(split), np.array(child), np.array(share)


@dataclass
class Model:
    words: set[str]
    before: Odds
    after: Odds
    path: Odds
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def features(self, rows: list[dict]) -> np.ndarray:
        out = np.zeros((len(rows), len(FEATURES)))
        lengths = sorted({len(w) for w in self.words}, reverse=True)
        for i, r in enumerate(rows):
            v = r["value"]
            kind = _KINDS[np.frombuffer(v.encode("ascii", "replace"), dtype=np.uint8) & 127]
            turn = kind[1:] != kind[:-1]
            pair = kind[1:] * 4 + kind[:-1]
            runs = np.diff(np.concatenate([[0], np.flatnonzero(turn) + 1, [len(v)]]))
            n = len(v)
            name = re.split(r"[=:]", r["before"])[0]
            out[i] = (
                n, (kind == 0).sum() / n, (kind == 1).sum() / n, (kind == 2).sum() / n, turn.sum() / n,
                np.isin(pair, (2, 8)).sum() / n, np.isin(pair, (6, 9)).sum() / n, runs.max() / n, len(set(v)) / n, _entropy(v),
                float(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) is not None), _covered(v, self.words, lengths), float(r["before"][-1:] in ("=", ":")), self.before(name), self.after(r["after"]), self.path(r["path"]),
            )
        return out

    def score(self, rows: list[dict]) -> np.ndarray:
        """The mean share of secrets over the trees."""
        if not self.trees or not rows:
            return np.full(len(rows), 0.5)
        x = self._binned(self.features(rows))
        total = np.zeros(len(rows))
        for feature, split, child, share in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            inner = feature[node] >= 0
            while inner.any():
                at = np.flatnonzero(inner)
                f = feature[node[at]]
                node[at] = child[node[at], (x[at, f] > split[node[at]]).astype(int)]
                inner = feature[node] >= 0
            total += share[node]
        return np.round(total / len(self.trees), 6)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)


def fit_rows(rows: list[dict], labels: list[int], words: set[str], trees: int = 40, depth: int = 8, leaf: int = 2, bins: int = 32, seed: int = 7) -> Model:
    """Forest from labelled findings."""
    of = lambda c: Odds.fit((c(r) for r in rows), labels)
    model = Model(words, of(lambda r: re.split(r"[=:]", r["before"])[0]), of(lambda r: r["after"]), of(lambda r: r["path"]))
    if len(set(labels)) < 2:
        return model
    x, y, rng = model.features(rows), np.array(labels, dtype=float), np.random.default_rng(seed)
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = model._binned(x)
    for _ in range(trees):
        some = rng.integers(0, len(y), len(y))
        model.trees.append(_tree(binned[some], y[some], model.edges, rng, depth, leaf))
    return model


def fit(labelled: DataFrame, words: set[str], sample_rows: int = 8000) -> Model:
    """Forest from findings with a boolean column `secret`; rows without it are left out."""
    rows = [r.asDict() for r in least_hashes(labelled.where(F.col("secret").isNotNull()), sample_rows, "doc_id", "start", "value").collect()]
    return fit_rows(rows, [int(r["secret"]) for r in rows], words)


def scored(findings: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The findings with score and is_secret."""
    names = ["doc_id", "path", "start", "end", "value", "before", "after"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.select(names).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_())], names=[*names, "score", "is_secret"])

    return findings.select(*names).mapInArrow(score, f"doc_id {findings.schema['doc_id'].dataType.simpleString()}, {FINDING}, score double, is_secret boolean")


def known_findings() -> Column:
    """Labels where none are given: vendor formats and assignments of values to telling names are secrets,
    if the values are long or have digits among others; numbers, and parts of addresses, are not. Others are NULL."""
    value, before = F.col("value"), F.col("before")
    telling = before.rlike(r"(?:password|passwd|secret|token|api_?key)\W*[=:]$") | (before == "=")
    #: A short value may be a word of a sentence; with a digit among other characters it is none.
    long = (F.length(value) >= 12) | (value.rlike("[0-9]") & value.rlike("[^0-9]"))
    return (
        F.when(value.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), True)
        .when(telling & long, True)
        .when(value.rlike("^[0-9]+$") | value.rlike("^[A-Za-z]+$"), False)
        .when(F.col("after").isin("com", "org", "net") | before.contains("@"), False)
    )
