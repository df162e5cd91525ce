"""Removal of byte strings that occur more than once, by depth-limited radix sort of suffixes.

Suffixes are ordered through their first `length` bytes only, most significant digit first; suffixes
that are alone in a group after a digit leave, and what is equal after the last digit is exactly the
repeated windows. The first digits are sampled, so that few suffixes enter:

1. Each window of `length` bytes has a 64-byte gram of least hash. Windows are equal only if such
   grams are. Grams that occur once take all their windows out.
2. The second digit is the whole context of a gram, all that its windows can see. Where two contexts
   are equal, all their windows are repeated and settled.
3. Of the rest one of each context goes on, with its bytes. All windows of all contexts of a gram are
   sorted by digits of 8 bytes, compared as numbers, groups of one being dropped after each.

Equal contexts are merged before they are shuffled, and a gram with many contexts in one task goes
on from there at once. Of a gram with more than ROWS contexts in all, the windows are dealt out by all
digits at once; so no gram is gathered in one task, and no pairs of contexts are formed.

Offsets are bytes of the UTF-8 form. Equal grams only propose; contexts that are settled are told apart by 64 bits of sums
over words with numbers drawn for the job, windows of very common grams by polynomials at drawn places modulo four primes (124 bits),
all others byte by byte. So two that differ are taken for one with a probability of 2^-64, or (200 / 2^31)^4, whatever their bytes.

Defined results: a null text is empty. Rows that share a key are one document: their repeats within
one another don't count, and what is removed from one is from all. A null key counts as a key of its
own. Texts below `length` bytes stay whole. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import join_on_hot, written

GRAM = 64
#: Contexts of a gram within one chunk beyond which it goes on without being met by others first.
MANY = 8
#: Contexts of a gram that are sorted in one task; the windows of grams with more are dealt out one by one.
ROWS = 2000
#: Windows of very common grams that meet in one task, about.
PART = 1 << 18
#: Rows of one gram that a task holds before it lets all of them go on.
HELD = 200_000
#: Bytes of text that a task looks at together.
CHUNK = 16_000_000
#: Bytes of a digit: as many as make one number.
_DIGIT = 8
_NULL = -(1 << 63)
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _B, dtype=np.uint64), np.full(size, pow(_B, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _pow, _inv = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _pow, _inv


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any stretches of some bytes."""

    def __init__(self, raw: np.ndarray):
        self._up, self._down = _powers(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=self._sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of each stretch of n bytes."""
        m = len(self._sums) - n
        return _mix((self._sums[n:] - self._sums[:m]) * self._down[:m])


#: Primes below 2^31: sums of products of two remainders fit into 64 bits.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


class _Names:
    """Names of 124 bits for stretches of bytes: polynomials by four primes, at places that are drawn for the job.

    Two different stretches of n bytes share a name with a probability of (n / 2^31)^4 at most, whatever their bytes.
    """

    def __init__(self, raw: np.ndarray, seed: int):
        bases = np.random.default_rng(seed).integers(1 << 20, min(_PRIMES), len(_PRIMES)).tolist()
        self._sums, self._shift = [], []
        for p, base in zip(_PRIMES, bases, strict=True):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers(base, p, len(raw)) % np.uint64(p), out=sums[1:])
            self._sums.append(sums)
            self._shift.append(self._powers(pow(base, -1, p), p, len(raw) + 1))

    @staticmethod
    def _powers(base: int, p: int, n: int) -> np.ndarray:
        power = np.ones(1, dtype=np.uint64)
        while len(power) < n:
            power = np.concatenate([power, power * np.uint64(int(power[-1]) * base % p) % np.uint64(p)])
        return power[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each stretch, all of which are of one length."""
        h = [(s[end] - s[start]) % np.uint64(p) * shift[start] % np.uint64(p) for p, s, shift in zip(_PRIMES, self._sums, self._shift, strict=True)]
        return h[0] << np.uint64(32) | h[1], h[2] << np.uint64(32) | h[3]


def context_names(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A name of 64 bits for what each gram sees and where in it the gram lies.

    Two sums of 32-bit words, each word by a number drawn for its place: two that differ share a name with a probability of 2^-64, whatever
    their bytes.
    """
    width = -(-(2 * length - GRAM + 8) // 4)
    keys = np.random.default_rng(seed).integers(0, _MASK, (2, width + 1), dtype=np.uint64, endpoint=True)
    padded = np.concatenate([raw, np.zeros(4 * width, dtype=np.uint8)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, 4 * (width - 2))
    out = np.empty(len(lo), dtype=np.uint64)
    column = np.arange(4 * (width - 2))
    for s in range(0, len(lo), 1 << 12):
        a, b = lo[s : s + (1 << 12)], hi[s : s + (1 << 12)]
        body = np.where(column < (b - a)[:, None], seen[a], np.uint8(0))
        words = np.concatenate([np.ascontiguousarray(body).view("<u4"), (b - a).astype("<u4")[:, None], (at[s : s + (1 << 12)] - a).astype("<u4")[:, None]], axis=1).astype(np.uint64)
        high = [((words * k[1:]).sum(axis=1, dtype=np.uint64) + k[0]) >> np.uint64(32) for k in keys]
        out[s : s + (1 << 12)] = high[0] << np.uint64(32) | high[1]
    return out


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours; f is minimum or maximum."""
    width = 1
    while 2 * width <= n:
        x = f(x[: len(x) - width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of grams such that each window holds one of those with the least hash in it."""
    span = length - GRAM + 1
    h = _Hashes(raw).all(GRAM)
    least = _slide(h, span, np.minimum)
    # A gram is chosen if it is the least of some window that holds it; windows end at the text's edges.
    edge = np.zeros(span - 1, dtype=np.uint64)
    top = _slide(np.concatenate([edge, least, edge]), span, np.maximum)
    at = np.flatnonzero(top == h)
    g = h[at]
    # Where one gram repeats at short distances, the first of each stretch of half a span is enough, and the last.
    half = span // 2
    joined = np.concatenate([[False], (g[1:] == g[:-1]) & (np.diff(at) <= half)])
    if joined.any():
        begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
        cell = (at - at[begin]) // half
        first = ~joined | np.concatenate([[True], cell[1:] != cell[:-1]])
        last = np.concatenate([~joined[1:], [True]])
        at, g = at[first | last], g[first | last]
    return at, g.view(np.int64)


def _contexts(at: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What the windows that hold the gram at each place can see."""
    return np.maximum(at - (length - GRAM), 0), np.minimum(at + length, n)


#: Kinds of rows: to be met by others, settled, going on, and the mark of a gram that goes on elsewhere.
_MEET, _FULL, _NEED, _MARK = 0, 1, 2, 3


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _local(doc: np.ndarray, pos: np.ndarray, gram: np.ndarray, ctx: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(rows, kind) after the merging that one chunk allows."""
    order = np.lexsort((pos, doc, ctx, gram))
    d, p, g, c = doc[order], pos[order], gram[order], ctx[order]
    # The same place counts once.
    fresh = _runs(g, c, d, p)
    order, g, c = order[fresh], g[fresh], c[fresh]
    of_ctx = _runs(g, c)
    size = np.diff(np.append(of_ctx, len(g)))
    full = np.repeat(size > 1, size)
    heads = order[of_ctx]
    of_gram = _runs(g[of_ctx])
    contexts = np.diff(np.append(of_gram, len(of_ctx)))
    many = np.repeat(contexts > MANY, contexts)
    return [(order[full], _FULL), (heads[many], _NEED), (heads[~many], _MEET), (order[of_ctx][of_gram[contexts > MANY]], _MARK)]


def _meet(gram: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, kind) of what is settled or goes on, from whole grams."""
    sure = np.flatnonzero((kind == _FULL) | (kind == _NEED))
    open_ = np.flatnonzero((kind == _MEET) | (kind == _MARK))
    order = open_[np.lexsort((pos[open_], doc[open_], ctx[open_], kind[open_], gram[open_]))]
    g, c, d, p, k = gram[order], ctx[order], doc[order], pos[order], kind[order]
    rows, kinds = [sure], [kind[sure]]
    if len(order):
        marked = np.isin(g, g[k == _MARK])
        meet = np.flatnonzero(k == _MEET)
        g, c, d, p, marked, order = g[meet], c[meet], d[meet], p[meet], marked[meet], order[meet]
        if len(g):
            fresh = _runs(g, c, d, p)
            g, c, marked, order = g[fresh], c[fresh], marked[fresh], order[fresh]
            of_ctx = _runs(g, c)
            size = np.diff(np.append(of_ctx, len(g)))
            full = np.repeat(size > 1, size)
            of_gram = _runs(g[of_ctx])
            contexts = np.diff(np.append(of_gram, len(of_ctx)))
            on = np.repeat(contexts > 1, contexts) | marked[of_ctx]
            for r, what in ((order[full], _FULL), (order[of_ctx[on]], _NEED)):
                rows.append(r)
                kinds.append(np.full(len(r), what, dtype=kind.dtype))
    return np.concatenate(rows), np.concatenate(kinds)


def repeated(bodies: list[bytes], group: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, first, last) runs of window starts, as offsets in the rows' documents, that occur elsewhere in their group."""
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    windows = np.maximum(size - length + 1, 0)
    if not windows.sum():
        return []
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    digits = np.zeros(len(raw) - _DIGIT + 1, dtype=np.uint64)
    for i in range(_DIGIT):
        digits = (digits << np.uint64(8)) | raw[i : i + len(digits)]
    row = np.repeat(np.arange(len(size)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[row] + inside
    place = start[row] + inside
    live, of = np.arange(len(row)), group[row]
    for digit in range(0, length, _DIGIT):
        # The last digit may begin within the one before: that orders and tells apart just as well.
        key = digits[at[live] + min(digit, length - _DIGIT)]
        mixed = (of[1:] == of[:-1]) & (key[1:] != key[:-1])
        if digit and not mixed.any():
            continue
        #: Only groups that the digit splits have to be sorted by it.
        split = np.zeros(int(of[-1]) + 1, dtype=bool)
        split[of[1:][mixed]] = True
        rows = np.flatnonzero(split[of])
        order = rows[np.lexsort((key[rows], of[rows]))]
        live[rows], key[rows] = live[order], key[order]
        new = _runs(of, key)
        count = np.diff(np.append(new, len(live)))
        keep = np.repeat(count > 1, count)
        #: A group's name is its rank among the groups so far: groups stay in the order of their bytes.
        live, of = live[keep], np.repeat(np.arange(len(new)), count)[keep]
        if not len(live):
            return []
    # One place may be seen from several rows; it is no repeat of itself.
    order = np.lexsort((place[live], doc[row[live]], of))
    live, of = live[order], of[order]
    fresh = np.zeros(len(live), dtype=bool)
    fresh[_runs(of, doc[row[live]], place[live])] = True
    new = _runs(of)
    many = np.repeat(np.add.reduceat(fresh.astype(np.int64), new) > 1, np.diff(np.append(new, len(of))))
    hit = np.sort(live[many])
    if not len(hit):
        return []
    r, s = row[hit], place[hit]
    cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(s) != 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(hit) - 1]])
    return list(zip(r[lo].tolist(), s[lo].tolist(), s[hi].tolist(), strict=True))


def _flagged(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc, pos, gram, kind): settled grams and those that go on."""
    names = ["gram", "ctx", "doc", "pos", "kind"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            doc, pos, gram, ctx = cols
            parts = _local(doc, pos, gram, ctx)
            rows = np.concatenate([r for r, _ in parts])
            kind = np.repeat(np.array([k for _, k in parts], dtype=np.int8), [len(r) for r, _ in parts])
            return pa.RecordBatch.from_arrays([pa.array(gram[rows]), pa.array(ctx[rows]), pa.array(doc[rows]), pa.array(pos[rows].astype(np.int64)), pa.array(kind)], names=names)

        for b in batches:
            for key, text in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                body = text.as_py() or b""
                if len(body) < length:
                    continue
                at, gram = anchors(np.frombuffer(body, dtype=np.uint8), length)
                lo, hi = _contexts(at, len(body), length)
                ctx = context_names(np.frombuffer(body, dtype=np.uint8), lo, hi, at, length, seed).view(np.int64)
                held.append((np.full(len(at), key, dtype=np.int64), at, gram, ctx))
                size += len(body)
                if size >= CHUNK:
                    yield merged()
                    size = 0
        if held:
            yield merged()

    found = docs.mapInArrow(find, "gram long, ctx long, doc long, pos long, kind byte")
    dealt = found.withColumn("to", F.when(F.col("kind").isin(_FULL, _NEED), F.xxhash64("doc", "pos")).otherwise(F.col("gram")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over: int | None = None  # a gram with too many rows to hold, all of whose contexts go on

        def named(doc: np.ndarray, pos: np.ndarray, gram: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(gram), pa.array(kind)], names=["doc", "pos", "gram", "kind"])

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            rows, kind = _meet(*cols)
            return named(cols[2][rows], cols[3][rows], cols[0][rows], kind)

        def all_of(cols: list[np.ndarray]) -> pa.RecordBatch:
            rows = cols[4] != _MARK
            return named(cols[2][rows], cols[3][rows], cols[0][rows], np.where(cols[4][rows] == _MEET, np.int8(_NEED), cols[4][rows]))

        for b in batches:
            cols = [b.column(c).to_numpy() for c in names]
            if over is not None and len(cols[0]):
                n = int(np.searchsorted(cols[0], over, side="right"))
                yield all_of([c[:n] for c in cols])
                cols, over = [c[n:] for c in cols], over if n == len(cols[0]) else None
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) >= HELD:
                last = int(np.searchsorted(held[0], held[0][-1]))
                if last:
                    yield out([c[:last] for c in held])
                    held = [c[last:] for c in held]
                if len(held[0]) >= HELD:
                    over = int(held[0][0])
                    yield all_of(held)
                    held = None
        if held is not None and len(held[0]):
            yield out(held)

    met = dealt.repartition("to").sortWithinPartitions("gram").select(*names)
    return written(met.mapInArrow(meet, "doc long, pos long, gram long, kind byte"), "grams")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: half as much to shuffle."""
    for b in batches:
        raw = [zlib.compress(x.as_py() or b"", 1) if x.as_py() else b"" for x in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(raw, pa.binary())], names=["doc", "body"])


def _unpacked(body: bytes | None) -> bytes:
    return zlib.decompress(body) if body else b""


def _compared(packed: DataFrame, need: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc, lo, hi): stretches covered by repeated windows of the contexts that went on."""
    sizes = need.groupBy("gram").agg(F.count("*").alias("n"))
    told = join_on_hot(need, sizes, ["gram"], "n", need.count())
    wanted = told.groupBy("doc").agg(F.collect_list(F.struct("pos", "gram", (F.col("n") > ROWS).alias("many"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, gram, bytes_, many = [], [], [], [], []
            for d, body, w in zip(b.column("doc").to_pylist(), b.column("body"), b.column("wanted").to_pylist(), strict=True):
                raw = _unpacked(body.as_py())
                for x in w:
                    lo = max(0, x["pos"] - (length - GRAM))
                    doc.append(d)
                    start.append(lo)
                    gram.append(x["gram"])
                    bytes_.append(raw[lo : x["pos"] + length])
                    many.append(x["many"])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(gram, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(many, pa.bool_())], names=["doc", "start", "gram", "body", "many"])

    contexts = written(packed.join(wanted, "doc").select("doc", "body", "wanted").mapInArrow(cut, "doc long, start long, gram long, body binary, many boolean"), "contexts")
    few = contexts.where(~F.col("many")).select("gram", "doc", "start", "body")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            gram, doc, start = (t.column(c).to_numpy() for c in ("gram", "doc", "start"))
            bodies = t.column("body").to_pylist()
            edges = np.append(_runs(gram), len(gram))
            lo, hi, of = [], [], []
            s = 0
            while s < len(edges) - 1:
                # Whole groups, as many as make some hundred thousand windows.
                e = max(s + 1, int(np.searchsorted(edges, edges[s] + ROWS, side="right")) - 1)
                a, b = int(edges[s]), int(edges[e])
                group = np.repeat(np.arange(e - s), np.diff(edges[s : e + 1]))
                for row, first, last in repeated(bodies[a:b], group, doc[a:b], start[a:b], length):
                    of.append(doc[a + row])
                    lo.append(first)
                    hi.append(last + length)
                s = e
            return _stretches(of, lo, hi)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            gram = held.column("gram").to_numpy()
            last = int(_runs(gram)[-1]) if len(gram) else 0
            if last >= 2 * ROWS:
                yield out(held.slice(0, last).combine_chunks())
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield out(held)

    sorted_ = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "doc long, lo long, hi long")
    return sorted_.unionByName(_dealt(contexts.where("many").select("doc", "start", "body"), length, seed))


def _stretches(doc: Sequence[int], lo: Sequence[int], hi: Sequence[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["doc", "lo", "hi"])


def _dealt(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc, lo, hi): the repeated windows of contexts of very common grams.

    All digits of a window make one name of 128 bits, and names meet by ranges of their hash: the work is in proportion
    to the windows and not to the pairs of contexts. Windows that repeat among the contexts that a task has at hand
    send their name once; names of one range travel together.
    """
    parts = max(1, -(-contexts.count() * (length - GRAM + 1) // PART))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                chunk = whole.slice(s, ROWS)
                bodies = chunk.column("body").to_pylist()
                size = np.array([len(x) for x in bodies], dtype=np.int64)
                n = np.maximum(size - length + 1, 0)
                row = np.repeat(np.arange(len(size)), n)
                if not len(row):
                    continue
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = (np.cumsum(size) - size)[row] + inside
                a, b = _Names(np.frombuffer(b"".join(bodies), dtype=np.uint8), seed).of(at, at + length)
                doc, place = chunk.column("doc").to_numpy()[row], chunk.column("start").to_numpy()[row] + inside
                order = np.lexsort((place, doc, b, a))
                order = order[_runs(a[order], b[order], doc[order], place[order])]
                a, b, doc, place = a[order], b[order], doc[order], place[order]
                new = _runs(a, b)
                count = np.diff(np.append(new, len(a)))
                twice = np.repeat(count > 1, count)
                # A window found here already says so by a row without a place.
                sent = np.concatenate([np.flatnonzero(~twice), new[count > 1]])
                cols = np.stack([a[sent].view(np.int64), b[sent].view(np.int64), doc[sent], np.where(twice[sent], -1, place[sent])], axis=1)
                part = (_mix(a[sent]) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cols, part = cols[order], part[order]
                edge = np.append(_runs(part), len(part))
                packed = [cols[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(packed, pa.binary()), *[pa.nulls(len(packed), pa.int64())] * 3], names=["part", "names", "doc", "lo", "hi"])
                order = np.lexsort((place[twice], doc[twice]))
                doc, place = doc[twice][order], place[twice][order]
                if len(doc):
                    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(place) > 1)) + 1
                    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(doc) - 1]])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary()), pa.array(doc[first]), pa.array(place[first]), pa.array(place[last] + length)], names=["part", "names", "doc", "lo", "hi"])

    found = written(contexts.mapInArrow(windows, "part long, names binary, doc long, lo long, hi long"), "windows")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of: int | None = None

        def out() -> pa.RecordBatch:
            a, b, doc, at = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 4).T
            held.clear()
            order = np.lexsort((at, doc, b, a))
            a, b, doc, at = a[order], b[order], doc[order], at[order]
            fresh = at < 0
            fresh[_runs(a, b, doc, at)] = True
            new = _runs(a, b)
            # A row without a place stands for two places at least.
            weight = np.add.reduceat(np.where(at < 0, 2, fresh.astype(np.int64)), new)
            many = np.repeat(weight > 1, np.diff(np.append(new, len(a)))) & (at >= 0) & fresh
            return _stretches(doc[many], at[many], at[many] + length)

        for x in batches:
            for part, names in zip(x.column("part").to_pylist(), x.column("names"), strict=True):
                if part != of and held:
                    yield out()
                of = part
                held.append(names.as_py())
        if held:
            yield out()

    met = found.where("part IS NOT NULL").select("part", "names").repartition("part").sortWithinPartitions("part").mapInArrow(meet, "doc long, lo long, hi long")
    return met.unionByName(found.where("part IS NULL").select("doc", "lo", "hi"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc, body, spans): each document's bytes, compressed, and the repeated stretches (lo, hi), unordered.

    The key is an integer.
    """
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("doc"), F.col(text).alias("text"))
    seed = secrets.randbits(62)  # drawn for the job, so that no text is made to collide
    flagged = _flagged(slim, length, seed)
    packed = slim.mapInArrow(_packed, "doc long, body binary")
    compared = _compared(packed, flagged.where(F.col("kind") == _NEED).select("doc", "pos", "gram"), length, seed)
    settled = flagged.where(F.col("kind") == _FULL).select("doc", F.greatest(F.col("pos") - (length - GRAM), F.lit(0)).alias("lo"), (F.col("pos") + length).alias("hi"))
    spans = settled.unionByName(compared).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return packed.join(spans, "doc", "left")


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal stretches that the spans cover, within n bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], n)) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(key, n_bytes, spans, kept): the stretches that were removed, and the bytes that stay."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            for body, s in zip(b.column("body"), b.column("spans").to_pylist(), strict=True):
                raw = _unpacked(body.as_py())
                gone = merged(s, len(raw))
                sizes.append(len(raw))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                ends = [0, *(x for g in gone for x in g), len(raw)]
                kept.append(b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
            keys = [None if k == _NULL else k for k in b.column("doc").to_pylist()]
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    found = repeated_spans(docs, key, text, length)
    return found.mapInArrow(strip, "doc long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary").withColumnRenamed("doc", key)


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * 1199) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 1000)) AS j FROM b)),
w AS (SELECT doc_id, j + i AS i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, j, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM c)),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY doc_id, run),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
f AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM q JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN f USING (doc_id)
"""
