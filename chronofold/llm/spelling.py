"""Words of a corpus grouped with the spelling they most likely stand for.

Two words are near if one code point, inserted, deleted or replaced, makes one of them the other. A word's
form is the most frequent of its near words, if that is at least `times` as frequent; its root is
where the forms lead. Frequencies are counted over all texts, and summed by task before the shuffle.

Near words are found by a self-join of the trie of all words. Going down from the root, each node
keeps its active nodes: those whose spelling is at distance one. The active nodes of a child are its parent, its
siblings and its own children, and whatever an active node of the parent reaches by the child's character.
Where a word's node has another word's node among its active ones, the two are near.

The trie is cut by prefixes. A prefix is crowded if more than M words begin with it, M being `most_words` or a
20000th of the words, if that is more; so there are at most 20000 crowded prefixes of each length, which every
task may hold. Words that share a prefix that is not crowded form a subtrie of at most M words, joined in one task.
Two near words that lie in no such subtrie together part at a crowded prefix: there the nodes of
different children become active at distance one, so that the rest of the words must be the same. They
meet by the prefix's length and the word without its next character, or the whole word. At such
a place there are no more words than characters.

Defined results: a null or empty text has no words; a null key counts as an empty one in the checksum. Rows that share a
key are counted each on its own. Equally frequent near words: the first in code-point order is the form. Very long texts
are taken in pieces cut between words; a word may be of any length. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import discard, written

#: Characters of Latin-1: those of words, A-Z lower-cased; a space for all others.
_LATIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_PIECE = 1 << 22
_MOST_HELD = 1 << 20
#: Crowded prefixes of one length, at most.
CROWDED = 20_000


def runs(text: str | None) -> Iterator[list[bytes]]:
    """Runs of Latin letters in Latin-1, some at a time; other characters are a byte that is in no run."""
    raw = (text or "").encode("latin-1", "replace").translate(_LATIN)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + _PIECE) if at + _PIECE < len(raw) else -1
        to = to if to >= 0 else len(raw)
        yield raw[at:to].split()
        at = to


def varied(run: bytes, seed: int, one_in: int) -> bytes:
    """The run, or where `one_in` divides its checksum, the run without one code point. `seed` is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                seed = zlib.crc32(f"{'' if k is None else k}:".encode())
                for some in runs(t.as_py()):
                    for run, n in Counter(some).items():
                        word = varied(run, seed, one_in)
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) > _MOST_HELD:
                        yield out()
                        held.clear()
        yield out()

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def crowded_prefixes(words: DataFrame, most_words: int) -> set[str]:
    """The prefixes of more than M words, see above; the empty one included."""
    total = words.count()
    most = max(most_words, total // CROWDED)
    found, last = set(), [""] if total > most else []
    while last:
        found.update(last)
        n = len(last[0])
        above = F.broadcast(words.sparkSession.createDataFrame([(p,) for p in last], "above string"))
        longer = words.where(F.length("word") > n).join(above, F.substring("word", 1, n) == F.col("above"), "left_semi")
        counts = longer.groupBy(F.substring("word", 1, n + 1).alias("prefix")).count().where(F.col("count") > most)
        last = [r["prefix"] for r in counts.collect()]
    return found


def trie_join(words: list[str]) -> Iterator[tuple[str, str]]:
    """All ordered pairs of words at distance one, by active nodes down a trie of the words."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, str] = {}
    for w in words:
        at = 0
        for c in w:
            below = children[at].get(c)
            if below is None:
                below = children[at][c] = len(children)
                children.append({})
            at = below
        ends[at] = w
    stack: list[tuple[int, list[int]]] = [(0, list(children[0].values()))]
    while stack:
        node, active = stack.pop()
        own = children[node]
        for c, child in own.items():
            reached = [children[a][c] for a in active if c in children[a]]
            near = {node, *own.values(), *children[child].values(), *reached}
            near.discard(child)
            if child in ends:
                yield from ((ends[child], ends[a]) for a in near if a in ends)
            if children[child]:
                stack.append((child, list(near)))


def near_pairs(words: DataFrame, most_words: int = 4096) -> DataFrame:
    """(word, other) for each ordered pair of near words of the column `word`, which has each once."""
    crowded = crowded_prefixes(words, most_words)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrie of each word, where it is in one, and the places under crowded prefixes where it can meet others."""
        for b in batches:
            at, name, whole, word = [], [], [], []
            for w in b.column("word").to_pylist():
                n = 0
                while n <= len(w) and w[:n] in crowded:
                    at += [n, n][: 1 + (n < len(w))]
                    name += [w, w[:n] + w[n + 1 :]][: 1 + (n < len(w))]
                    whole += [True, False][: 1 + (n < len(w))]
                    word += [w, w][: 1 + (n < len(w))]
                    n += 1
                if n <= len(w):
                    at.append(-1)
                    name.append(w[:n])
                    whole.append(True)
                    word.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(name, pa.string()), pa.array(whole, pa.bool_()), pa.array(word, pa.string())], names=["at", "name", "whole", "word"])

    def joined(rows: pa.Table) -> pa.Table:
        pairs = list(trie_join(rows.column("word").to_pylist()))
        return pa.table({"word": pa.array([a for a, _ in pairs], pa.string()), "other": pa.array([b for _, b in pairs], pa.string())})

    placed = words.select("word").mapInArrow(places, "at int, name string, whole boolean, word string")
    pairs = placed.where("at < 0").groupBy("name").applyInArrow(joined, "word string, other string")
    if crowded:
        met = placed.where("at >= 0").groupBy("at", "name").agg(F.collect_list(F.struct("word", "whole")).alias("here")).where(F.size("here") > 1)
        first = met.select("here", F.explode("here").alias("a"))
        across = first.select("a", F.explode("here").alias("b")).where("a.word != b.word and not (a.whole and b.whole)")
        pairs = pairs.unionByName(across.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"))).distinct()
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): a form is more frequent than its word, so the chains end. Each step doubles what is followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5, times: int = 5, one_in: int = 199, most_words: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    words = written(vocabulary(docs, key, text, least_length, least_n, one_in), "words")
    pairs = near_pairs(words, most_words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    with_near = written(words.join(near, "word", "left"), "near")
    forms = with_near.where(-F.col("best.less") >= times * F.col("n")).select("word", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    ends = roots(forms)
    found = with_near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).join(forms, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB: checksums by a table made from their polynomial, near words by their spellings without one code point.
ORACLE = r"""
WITH polynomial AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
run AS (
    SELECT doc_id, run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY ALL
),
summed AS (
    SELECT run, k, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(length(hex) // 2), lambda i: ('0x' || hex[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM run, polynomial
),
word AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
),
less AS (SELECT DISTINCT word, n, i, word[1 : i - 1] || word[i + 1 :] AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.short = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.short = b.word
),
near AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS best FROM pair GROUP BY word),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.other END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
    FROM word LEFT JOIN near USING (word)
),
chain AS (
    WITH RECURSIVE step AS (
        SELECT word, word AS here, 0 AS depth FROM word
        UNION ALL SELECT step.word, formed.form, depth + 1 FROM step JOIN formed ON formed.word = step.here WHERE formed.form IS NOT NULL
    )
    SELECT word, arg_max(here, depth) AS root FROM step GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
