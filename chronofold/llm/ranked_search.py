"""The highest-scoring documents for each query, by a tree of maxima for each term.

The index cuts the documents into shards of at most DOCS documents. Within a shard every term has a
tree over document ranges: the leaves hold what one occurrence of the term in a query adds to a
document's score, apart from the term's weight, and each node above, over FAN times as many
documents, holds the largest value below it. The weights of a query times the values at a node, summed
over its terms, are a bound on every document of that range. So a search opens the range with the
highest bound first, until it has met the wanted number of documents; ranges whose bound equals a
document's score are opened before the document counts, as they may hold one that comes first among equals.

Scores need the number of documents and terms, so one pass counts and a second one builds the
index, without a shuffle. A search reads the rows of its queries' terms, groups them by shard, and
merges the best documents of all shards. Queries are taken in blocks of about BLOCK_TERMS terms, so that
what the driver collects and sends to tasks is bounded; every block searches all shards.

Terms are the longest runs of digits, Latin letters of ASCII and all characters beyond ASCII; only A-Z are
lower-cased.

Defined results: a null or empty text has no terms and is no result; a query without known terms has no
results. Rows that share a key are documents of their own, as rows of queries are queries of their own.
Equal scores are in ascending order of the key, a null key first. Empty tables give no rows. Extra columns don't matter.
Very long texts are taken in pieces cut between terms; a document counts as one whatever its length.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import discard, fresh, written

#: Documents of a node's range, from the root of a shard's trees to their leaves.
SPANS = (4096, 256, 16, 1)
DOCS, FAN = SPANS[0], SPANS[0] // SPANS[1]
#: A shard is closed once it has so many occurrences of terms.
OCCURRENCES = 1 << 20
BLOCK_TERMS = 1 << 18
_PIECE = 1 << 22
#: Bytes of UTF-8: those of terms, A-Z lower-cased; a space for all others.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    raw = (text or "").encode().translate(_BYTES)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + _PIECE) if at + _PIECE < len(raw) else -1
        to = to if to >= 0 else len(raw)
        yield raw[at:to].split()
        at = to


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, terms(t.as_py()))) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, n))], "terms": [sum(n)]})

    found = docs.select(text).mapInArrow(counts, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


_TERM = {"term": pa.string(), "df": pa.int32(), "nodes": pa.list_(pa.int32()), "best": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32())}


class _Shard:
    """Documents of one task until there are enough for a shard."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: list[pa.Scalar] = []
        self.occurrences = 0

    def add(self, key: pa.Scalar, text: str | None) -> None:
        known = self.known
        ids = [np.array([known.setdefault(w, len(known)) for w in some], dtype=np.int64) for some in terms(text)]
        if n := sum(map(len, ids)):
            self.ids += ids
            self.lengths.append(n)
            self.keys.append(key)
            self.occurrences += n

    def rows(self, name: int, docs: int, words: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard's documents, then its terms' trees."""
        order = pc.sort_indices(pa.array(self.keys, kind), null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        keys = pa.array(self.keys, kind).take(pa.array(order))
        yield _index_rows(name, {"key": keys})
        pair, tf = np.unique(np.concatenate(self.ids) * DOCS + np.repeat(place, self.lengths), return_counts=True)
        term, doc = pair // DOCS, pair % DOCS
        m = np.array([75 + 25 * n * docs // words for n in self.lengths], dtype=np.int64)[order]
        adds = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        of, nodes, best, sizes = [], [], [], []
        for span in SPANS:
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] // span != doc[:-1] // span)])
            of.append(term[first])
            nodes.append(doc[first] // span)
            best.append(np.maximum.reduceat(adds, first))
            sizes.append(np.bincount(of[-1], minlength=len(self.known)))
        by_term = np.argsort(np.concatenate(of), kind="stable")
        cuts = pa.array(np.r_[0, np.cumsum(sum(sizes))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x)[by_term].astype(np.int32))) for x in (nodes, best)]
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(self.known) + 1, dtype=np.int32) * len(SPANS)), pa.array(np.stack(sizes, 1).ravel().astype(np.int32)))
        words_ = pa.array([w.decode() for w in self.known], pa.string())
        yield _index_rows(name, {"key": pa.nulls(len(words_), kind), "term": words_, "df": pa.array(sizes[-1].astype(np.int32)), "nodes": lists[0], "best": lists[1], "sizes": each})


def _index_rows(name: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["key"])
    rest = {c: columns.get(c, pa.nulls(n, kind)) for c, kind in _TERM.items()}
    return pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, name)), "key": columns["key"], "nth": pa.array(np.arange(n, dtype=np.int32)), **rest})


def _query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(q, item, term, repeats): q numbers the rows of `queries`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, word, n = [], [], []
            for i, t in enumerate(b.column("text")):
                found: dict[bytes, int] = {}
                for some in terms(t.as_py()):
                    for w in some:
                        found[w] = found.get(w, 0) + 1
                at += [i] * len(found)
                word += [w.decode() for w in found]
                n += found.values()
            rows = b.select(["q", "item"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["q", "item", "term", "repeats"])

    kind = queries.schema[item].dataType.simpleString()
    named = queries.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(split, f"q long, item {kind}, term string, repeats long")


def best_first(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(document, score) of the k best documents of one shard with a score above 0, best first.

    A level is (cuts, term, best): the entries cuts[i] to cuts[i + 1] belong to node i.
    """

    def opened(level: int, lo: int, hi: int) -> None:
        cuts, term, best = levels[level]
        hi = min(hi, len(cuts) - 1)
        used = np.flatnonzero(cuts[lo + 1 : hi + 1] > cuts[lo:hi]) + lo
        if len(used):
            a, b = cuts[lo], cuts[hi]
            bound = np.add.reduceat(weight[term[a:b]] * best[a:b], cuts[used] - a)
            for node, s in zip(used.tolist(), bound.tolist(), strict=True):
                if s > 0:
                    heapq.heappush(heap, (-s, level, node))

    heap: list[tuple[int, int, int]] = []
    out: list[tuple[int, int]] = []
    opened(0, 0, 1)
    while heap and len(out) < k:
        # Among equal bounds the higher levels come first, documents last and in their order.
        s, level, node = heapq.heappop(heap)
        if level == len(levels) - 1:
            out.append((node, -s))
        else:
            opened(level + 1, node * FAN, (node + 1) * FAN)
    return out


def _levels(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of a shard's terms, level by level and by node; terms are numbered as in `rows`."""
    sizes = rows.column("sizes").combine_chunks().flatten().to_numpy().reshape(-1, len(SPANS))
    nodes, best = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("nodes", "best"))
    level = np.repeat(np.tile(np.arange(len(SPANS)), len(sizes)), sizes.ravel())
    term = np.repeat(np.arange(len(sizes)), sizes.sum(axis=1))
    out = []
    for i in range(len(SPANS)):
        at = np.flatnonzero(level == i)
        at = at[np.argsort(nodes[at], kind="stable")]
        out.append((np.searchsorted(nodes[at], np.arange(int(nodes[at[-1]]) + 2)), term[at], best[at].astype(np.int64)))
    return out


class Index:
    """`table` holds the documents and trees of all shards."""

    def __init__(self, table: DataFrame, docs: int, words: int):
        self.table, self.docs, self.words = table, docs, words

    def discard(self) -> None:
        discard(self.table)

    def search(self, queries: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
        """(item, rank, key, score): the k best documents of each row of `queries`, from rank 1. Written, so the index may go."""
        asked = written(_query_terms(queries, item, text), "asked")
        blocks = asked.count() // BLOCK_TERMS + 1
        found = [self._search(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k) for b in range(blocks)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        items = asked.select("q", "item").distinct()
        best = written(out.join(items, "q").select(F.col("item").alias(item), "rank", "key", "score"), "ranked")
        discard(asked, *found)
        return best

    def _search(self, asked: DataFrame, k: int) -> DataFrame:
        vocabulary = F.broadcast(asked.select("term").distinct())
        trees = self.table.join(vocabulary, "term", "left_semi")
        df = trees.groupBy("term").agg(F.sum("df").alias("df"))
        weight = {r["term"]: math.floor(1000 * math.log((2 * self.docs + 2) / (2 * r["df"] + 1))) for r in df.collect()}
        by_query: dict[int, dict[str, int]] = {}
        for r in asked.select("q", "term", "repeats").collect():
            if w := weight.get(r["term"]):
                by_query.setdefault(r["q"], {})[r["term"]] = w * r["repeats"]
        key_type = self.table.schema["key"].dataType.simpleString()

        def searched(rows: pa.Table) -> pa.Table:
            of_docs = pc.is_null(rows.column("term"))
            docs = rows.filter(of_docs).sort_by("nth")
            trees = rows.filter(pc.invert(of_docs))
            q, place, score = [], [], []
            if trees.num_rows:
                levels, number = _levels(trees), {w: i for i, w in enumerate(trees.column("term").to_pylist())}
                for name, words in by_query.items():
                    weights = np.zeros(len(number), dtype=np.int64)
                    for w, x in words.items():
                        if (i := number.get(w)) is not None:
                            weights[i] = x
                    for doc, s in best_first(levels, weights, k):
                        q.append(name)
                        place.append(doc)
                        score.append(s)
            keys = docs.column("key").combine_chunks().take(pa.array(place, pa.int64()))
            return pa.table({"q": pa.array(q, pa.int64()), "key": keys, "score": pa.array(score, pa.int64())})

        rows = trees.unionByName(self.table.where(F.col("term").isNull()))
        best = rows.groupBy("shard").applyInArrow(searched, f"q long, key {key_type}, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first()))
        return written(best.withColumn("rank", rank).where(F.col("rank") <= k), "found")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index all documents."""
    n_docs, n_words = totals(docs, text)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = count(TaskContext.get().partitionId() << 32), _Shard()
        for b in batches:
            for k, t in zip(b.column("key"), b.column("text"), strict=True):
                held.add(k, t.as_py())
                if len(held.keys) == DOCS or held.occurrences >= OCCURRENCES:
                    yield from held.rows(next(names), n_docs, n_words, b.column("key").type)
                    held = _Shard()
        if held.keys:
            yield from held.rows(next(names), n_docs, n_words, b.column("key").type)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"shard long, key {kind}, nth int, term string, df int, nodes array<int>, best array<int>, sizes array<int>"
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return Index(written(named.mapInArrow(shards, schema), "trees"), n_docs, n_words)


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents for each row of `queries`."""
    index = build(docs, key, text)
    found = index.search(queries, k, item, query)
    index.discard()
    return found.withColumnRenamed("key", fresh(found.drop("key"), key))


#: The same in DuckDB, all documents by all terms.
ORACLE = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n
    FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)
    WHERE len(t) > 0
),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM doc),
occurrence AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM doc) GROUP BY ALL),
weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM occurrence GROUP BY term), total
),
item AS (
    SELECT row_number() OVER () AS q, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM benchmark
),
asked AS (SELECT q, item_id, term, count(*) AS repeats FROM (SELECT q, item_id, unnest(t) AS term FROM item) GROUP BY ALL),
scored AS (
    SELECT q, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN weight USING (term) JOIN occurrence USING (term) JOIN doc USING (r), total
    GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
