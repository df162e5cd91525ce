"""Spelling variants against all pairs of words, their trie join, and their SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import spelling

from .conftest import AWKWARD


def vocabulary(rows, least_length=6, least_n=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, **least):
    n = vocabulary(rows, **least)
    form, others = {}, {}
    for w in n:
        others[w] = [o for o in n if near(w, o)]
        best = min(others[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, documents=60):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abéÿ", k=rnd.randint(5, 9))) for _ in range(25)]
    words = list(stems)
    for w in stems * 3:
        at = rnd.randrange(len(w))
        words.append(rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abé") + w[at:], w[:at] + rnd.choice("abÿ") + w[at + 1 :]]))
    weights = [rnd.choice([1, 3, 20, 120]) for _ in words]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(5, 80))).replace("b", rnd.choice("bB"))) for i in range(documents)]


@pytest.mark.parametrize("most_words", [4096, 12, 1])
def test_variants(docs, most_words):
    rows = [*corpus(1), *AWKWARD[:6], (3, "Étranger straße " * 9), (3, "Étranger straße " * 9), *AWKWARD[-1:] * 5]
    df = docs(rows).withColumnRenamed("lang", "n").withColumnRenamed("source", "word")
    assert rows_of(spelling.variants(df, most_words=most_words)) == brute(rows)


def test_chains_and_ties(docs):
    """a is a form of b, b of c, c of d: the root of all is the first. Of equal ones the first in code-point order is the form."""
    chain = {"abcdef": 700, "abcdeg": 130, "abcdhg": 25, "abcihg": 5, "mmmmmma": 30, "mmmmmmb": 30, "mmmmmm": 6}
    rows = [(i, w) for i, w in enumerate(w for w, k in chain.items() for _ in range(k))]
    got = rows_of(spelling.variants(docs(rows), one_in=10**12))
    assert [r[:3] for r in got] == [("abcdef", None, "abcdef"), ("abcdeg", "abcdef", "abcdef"), ("abcdhg", "abcdeg", "abcdef"), ("abcihg", "abcdhg", "abcdef"), ("mmmmmm", "mmmmmma", "mmmmmma"), ("mmmmmma", None, "mmmmmma"), ("mmmmmmb", None, "mmmmmmb")]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=40))
def test_trie_join(words):
    want = sorted((a, b) for a in words for b in words if near(a, b))
    assert sorted(spelling.trie_join(sorted(words))) == want


def test_crowded_prefixes(shared):
    rnd = random.Random(2)
    words = {"pre" + "".join(rnd.choices("abc", k=rnd.randint(0, 5))) for _ in range(150)} | {"".join(rnd.choices("abcp", k=rnd.randint(1, 5))) for _ in range(100)}
    df = shared.createDataFrame([(w,) for w in words], "word string").withColumn("at", F.lit(1))
    found = spelling.crowded_prefixes(df, 10)
    assert "" in found and "pre" in found
    assert found == {w[:i] for w in words for i in range(len(w) + 1) if sum(o.startswith(w[:i]) for o in words) > 10}
    want = sorted((a, b) for a in words for b in words if near(a, b))
    assert sorted(map(tuple, spelling.near_pairs(df, 10).collect())) == want


def test_long_words_and_texts_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 11)
    assert [w for some in spelling.runs("Abcdef, ghIjkl…ÀÉß×x " * 5) for w in some] == [w.encode("latin-1") for w in ["abcdef", "ghijkl", "ÀÉß×x"] * 5]
    rows = [(i, "z" * 5000 + " " + "z" * 4999 + "y") for i in range(6)]
    assert rows_of(spelling.variants(docs(rows), one_in=10**12)) == [("z" * 4999 + "y", None, "z" * 4999 + "y", 6, 1, None), ("z" * 5000, None, "z" * 5000, 6, 1, None)]


def test_nothing(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, "few words")])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_equals_sql(shared):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert rows_of(spelling.variants(shared.read.parquet(path))) == sorted(con.sql(spelling.ORACLE).fetchall())
