"""Ranked search against scores of all documents, and its SQL."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from chronofold.llm import ranked_search

from .conftest import AWKWARD


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, k=20):
    held = [(d, t) for d, t in ((d, split(t)) for d, t in rows) if t]
    total, words = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, t in held:
            m = 75 + 25 * len(t) * total // words
            of = lambda w: 1_000_000_000 * t.count(w) // (1000 * t.count(w) + 12 * m)  # noqa: E731, B023
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * of(w) for w in split(text) if w in df)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if there else None, -s) for i, (s, there, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "The quick brown fox, quick!"), (2, None), (3, "..."), (4, "unheard words only zzqq"), (5, "passage 16 of words and words alpha"), (6, "日本語 İstanbul W7 w7"), (6, "fox"), (7, "w1 " * 30 + "ab")]


def test_awkward(shared, docs):
    rows = [*AWKWARD[:5], (6, "x w1 w2 w7 " * 900), *AWKWARD[6:], AWKWARD[13], AWKWARD[13]]
    items = shared.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = ranked_search.rank(docs(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "shard"), items)
    assert rows_of(got) == brute(rows, ITEMS)


@pytest.mark.parametrize("size", [1 << 21, 400])
def test_ties_and_shards(shared, docs, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "OCCURRENCES", size)
    rnd = random.Random(3)
    words = [f"t{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (1 + i) for i in range(30)], k=rnd.randint(1, 12))) for _ in range(120)]
    rows = [(i, rnd.choice(texts)) for i in range(1500)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(25)]
    found = ranked_search.rank(docs(rows), shared.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == brute(rows, items)


def test_blocks_of_queries(shared, docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 4)
    items = shared.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_search.rank(docs(AWKWARD), items, k=3)
    assert rows_of(got) == brute(AWKWARD, ITEMS, 3)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked_search, "_PIECE", 7)
    text = "Ab cd-efghijklmnop qré st " * 9
    assert [w.decode() for some in ranked_search.terms(text) for w in some] == split(text)


def test_nothing(shared, docs):
    items = shared.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.rank(docs([]), items).count() == 0
    assert ranked_search.rank(docs(AWKWARD), items.limit(0)).count() == 0


def test_bounds_are_opened_best_first(monkeypatch):
    """Far fewer nodes are opened than there are, where one range has all high scores."""
    opened = []
    plain = ranked_search.heapq.heappop
    monkeypatch.setattr(ranked_search.heapq, "heappop", lambda h: opened.append(1) or plain(h))
    import numpy as np

    doc = np.arange(ranked_search.DOCS)
    best = np.where(doc < 16, 1000, 10)
    levels = []
    for span in ranked_search.SPANS:
        top = np.maximum.reduceat(best, np.arange(0, len(doc), span))
        levels.append((np.arange(len(top) + 1), np.zeros(len(top), dtype=int), top))
    assert ranked_search.best_first(levels, np.array([3]), 16) == [(i, 3000) for i in range(16)]
    assert len(opened) == 3 + 16


def test_equals_sql(shared):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = ranked_search.rank(shared.read.parquet(f"{sf}/documents.parquet"), shared.read.parquet(f"{sf}/benchmark.parquet"))
    want = con.sql(ranked_search.ORACLE)
    assert rows_of(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)
