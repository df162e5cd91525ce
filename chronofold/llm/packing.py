"""Packing of documents into sequences of one window.

A document becomes the ids of its whole text and an end id. Full windows are cut off its front
and fill sequences of their own; what remains is a piece shorter than the window. The pieces are
counted by length, in bins of `unit` ids. Combinations of few lengths that fill a window are
enumerated, and non-negative least squares finds how often to repeat each of them so that together
they use up the histogram. The counts are rounded down; a piece's rank among those of its bin says
which place of which combination it takes. Pieces that are left over are packed greedily, best fit
first, in tasks of bounded size.

Only lengths and the histogram are looked at by the driver, never documents. Ranks come from
counters that each task keeps while it cuts pieces, so no bin is gathered anywhere.

Defined results: a null text is empty and gives the end id alone. Rows that share a doc_id are
packed each on its own. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import written

_MEMO_MOST = 600_000
#: Words of Latin letters, with one sign behind them at most: a token run each, and a second one for the sign.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,64}[.,]?")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a tokenizer file, with the ids of words remembered.

    The tokenizer never joins characters across white space, so words are encoded singly. For words
    of Latin letters the same merges are applied by a faster library; all others go to the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._memo: dict[str, bytes] = {}
        self._fast = self._merges(spec)

    @staticmethod
    def _merges(spec: dict):
        """A byte-pair encoder with the word end as a byte of its own, where the file is of that kind; else None."""
        import tiktoken

        model = spec["model"]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = count(256)
        byte_of = {chr(b): b for b in printable} | {chr(next(extra)): b for b in range(256) if b not in printable}
        ranks = {}
        for token, i in model["vocab"].items():
            body = token.removesuffix("</w>")
            if all(c in byte_of for c in body) and not token.startswith("<|"):
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * token.endswith("</w>")] = i
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _word(self, w: str) -> bytes:
        if self._fast is not None and _PLAIN.fullmatch(w):
            body = w.rstrip(".,")
            ids = self._fast.encode_single_piece(body.lower().encode() + b"\xff")
            if body != w:
                ids = ids + self._fast.encode_single_piece(w[-1].encode() + b"\xff")
        else:
            ids = self._whole.encode(w, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text, four bytes each."""
        if len(self._memo) > _MEMO_MOST:
            self._memo.clear()
        memo, out = self._memo, []
        for w in re.split("[ \n\r\t]+", text):
            ids = memo.get(w)
            if ids is None:
                ids = self._word(w) if w else b""
                if len(w) < 64:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(docs: DataFrame, tokenizer: str, key: str, text: str, window: int, end_id: int, unit: int) -> DataFrame:
    """The pieces of all documents, with their bin and rank among the task's pieces of that bin."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        task = TaskContext.get().partitionId()
        seen = np.zeros(window // unit + 1, dtype=np.int64)
        for b in batches:
            names, rows = [], []
            for at, t in enumerate(b.column(text)):
                ids = encode(t.as_py() or "") + tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    kind = -(-length // unit)
                    names.append(at)
                    rows.append((start, length, zlib.crc32(part), total, kind, task, int(seen[kind])))
                    seen[kind] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(names, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["doc", *_PIECE])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(pieces, f"doc {kind}, " + ", ".join(f"{c} long" for c in _PIECE))


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "bin", "task", "nth")


def combinations(bins: int, present: list[int], most: int = 4, slack: int = 0) -> list[tuple[int, ...]]:
    """Ascending tuples of at most `most` of the present bins that add up to `bins`, or `slack` less.

    Those of one to three bins are enumerated in full; the fourth place, and more, only repeat one bin,
    so that short lengths find combinations as well.
    """
    have = sorted(present)
    there = set(have)
    found = set()
    for want in range(bins - slack, bins + 1):
        for i, a in enumerate(have):
            if a == want:
                found.add((a,))
            for b in have[i:]:
                if a + b == want:
                    found.add((a, b))
                if a + 2 * b > want:
                    break
                if (c := want - a - b) in there:
                    found.add((a, b, c))
            for k in range(most - 1, 2 * most):
                if (c := want - k * a) in there:
                    found.add(tuple(sorted([a] * k + [c])))
    return sorted(found)


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - y|, by accelerated projected gradient steps."""
    x = np.zeros(a.shape[1])
    if not a.size:
        return x
    v = np.ones(a.shape[0])
    for _ in range(30):
        v = a @ (a.T @ v)
        v /= np.linalg.norm(v)
    step = 1 / (float(v @ (a @ (a.T @ v))) * 1.01)
    z, m = x, 1.0
    for _ in range(rounds):
        new = np.maximum(z - step * (a.T @ (a @ z - y)), 0)
        m2 = (1 + (1 + 4 * m * m) ** 0.5) / 2
        z, x, m = new + (m - 1) / m2 * (new - x), new, m2
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats), never using more pieces of a bin than there are."""
    present = [b for b in histogram if b < bins]
    combos = combinations(bins, present)
    if not combos:
        return []
    row = {b: i for i, b in enumerate(sorted(present))}
    a = np.zeros((len(row), len(combos)))
    for j, c in enumerate(combos):
        for b in c:
            a[row[b], j] += 1
    y = np.array([histogram[b] for b in sorted(present)], dtype=float)
    x = nnls(a, y / y.max()) * y.max()
    left = dict(histogram)
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        need: dict[int, int] = {}
        for b in combos[j]:
            need[b] = need.get(b, 0) + 1
        n = min(int(x[j]), *(left[b] // k for b, k in need.items()))
        if n > 0:
            out.append((combos[j], n))
            for b, k in need.items():
                left[b] -= n * k
    return out


def _best_fit(length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: longest first, into the fullest sequence that takes it."""
    sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    rooms = np.zeros(window + 2, dtype=bool)
    made = 0
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        room = n + int(rooms[n:].argmax())
        if not rooms[room]:
            room, s = window, made
            made += 1
        else:
            s = open_[room].pop()
            rooms[room] = bool(open_[room])
        sequence[i], offset[i] = s, window - room
        if room > n:
            open_[room - n].append(s)
            rooms[room - n] = True
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2, unit: int = 16, residual_rows: int = 50_000) -> DataFrame:
    """Pieces of all documents with the sequence and the offset there.

    Columns: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    pieces = written(cut(docs, tokenizer, key, text, window, end_id, unit), "pieces")
    counts = pieces.groupBy("bin", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("bin", "task", F.coalesce("before", F.lit(0)).alias("before")), ["bin", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    bins = window // unit
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # a row for each bin at most
    #: For each bin, the ranks from which a combination's place takes pieces: (first rank, first sequence).
    taken = {b: 0 for b in histogram}
    starts: dict[int, list[tuple[int, int]]] = {b: [] for b in histogram}
    made = 0
    for combo, n in plan(histogram, bins):
        for b in combo:
            starts[b].append((taken[b], made))
            taken[b] += n
        made += n
    if bins in histogram:
        starts[bins], taken[bins] = [(0, made)], histogram[bins]
        made += histogram[bins]
    limits = [np.array(starts.get(b, []), dtype=np.int64).reshape(-1, 2) for b in range(bins + 1)]
    used = np.array([taken.get(b, 0) for b in range(bins + 1)], dtype=np.int64)
    left_over = sum(histogram.values()) - int(used.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b.column("bin").to_numpy(), b.column("rank").to_numpy()
            sequence = np.full(len(kind), -1, dtype=np.int64)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero((kind == k) & (rank < used[k]))
                if len(at):
                    t = limits[k][np.searchsorted(limits[k][:, 0], rank[at], side="right") - 1]
                    sequence[at] = t[:, 1] + rank[at] - t[:, 0]
            keep = [b.column(c) for c in ("doc", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence)], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    kind = docs.schema[key].dataType.simpleString()
    columns = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = written(ranked.select("doc", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank").mapInArrow(place, columns), "placed")
    run = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc", "start", "ids_crc32")
    filled = placed.where("sequence_id >= 0").withColumn("offset", F.sum("length").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    filled = filled.withColumn("offset", F.coalesce("offset", F.lit(0)))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, base = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal base
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            sequence, offset = _best_fit(t.column("length").to_numpy(), window)
            ids = (np.int64(task + 1) << np.int64(40)) + base + sequence
            base += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(ids), pa.array(offset)], names=[*t.schema.names[:5], "sequence_id", "offset"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= 4 * residual_rows:
                yield packed()
        if held:
            yield packed()

    tasks = max(1, -(-left_over // residual_rows))
    rest = placed.where("sequence_id < 0").repartition(tasks, F.xxhash64("doc", "start", "ids_crc32")).sortWithinPartitions("doc", "start", "ids_crc32")
    rest = rest.mapInArrow(greedy, columns + ", offset long")
    out = filled.select("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").unionByName(rest)
    return out.withColumnRenamed("doc", key)
