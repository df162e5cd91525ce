"""Token ids in binary files with one shared dictionary and an index by document.

Each document becomes the ids of its whole text and an end id, serialised as little-endian integers
of 16 bits (of 32, where the vocabulary needs them) and compressed on its own by zstandard, so that
a short document is read without its neighbours. One dictionary, trained on the serialised ids of a
bounded sample, gives short documents the context they lack.

A file holds documents in ascending order of their key, and files follow one another in that order:

    header   magic "CFIDS1", bytes an id takes (u16), SHA-256 of the dictionary (32 bytes)
    frames   one zstandard frame for each document
    index    Arrow stream of (key, offset, n_bytes, n_ids, before): place of the frame, ids in it and before it in the file
    footer   offset of the index (u64), its length (u64), magic

Compressed documents, not texts, are sorted: Spark partitions them by ranges of the key, and each
task writes the files of its range to the shared folder as it reads. A file counts only once the
manifest, a table of one row for each file, names it; what a lost or repeated task left is never read.
The folder is any that both Spark and pyarrow's file systems
reach by one URI. The driver adds up the ids by file: at most MOST_FILES rows, and one for each task.

Defined results: a null text is empty and gives the end id alone. Rows that share a key stand side by
side, by the checksum of their ids; a null key comes first. Special tokens' strings in a text are
ordinary text. An empty table gives no files and no rows. Extra columns don't matter. One document's
ids must fit into memory: about 20 bytes for each character of the text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import discard, least_hashes, shared_dir, written

MAGIC = b"CFIDS1"
_HEAD = struct.Struct("<6sH32s")
_FOOT = struct.Struct("<QQ6s")
#: Files are made larger, rather than more of them, beyond this.
MOST_FILES = 100_000
#: Chunks of one generation; those of the last one are kept besides.
_MEMO_MOST = 300_000
#: A space where the tokenizer always begins a new piece: all but one within a run of white space.
_BREAK = re.compile(r"(?<=\S) | (?=\S)")
#: Letters that every version of Unicode has, signs behind them, a line break, letters and signs again: a piece each.
_PLAIN = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)""")
_encoders: dict[str, Encoder] = {}


class _White(KeyError):
    """A chunk is empty or begins with white space: what stands before it decides whether it is a chunk."""


class Chunks(dict):
    """Serialised ids by chunk: what stands before, between or after the spaces of a text, `space` being the one in front of it.

    Chunks of plain words are cut into the tokenizer's pieces here, and its merges are applied to each; all others go to the tokenizer whole.
    """

    def __init__(self, tokenizer, width: int, space: str, inner: Chunks | None):
        self._encode, self._merge, self._kind, self._space = tokenizer.encode, tokenizer.model.tokenize, {2: "H", 4: "I"}[width], space
        #: Pieces without a space in front.
        self._inner = self if inner is None else inner
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in printable)
        #: The merges' letter for each byte.
        self._letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        self._before: dict[str, bytes] = {}
        self._front = space.translate(self._letters)

    def _merged(self, spelled: str) -> bytes:
        return array(self._kind, [t.id for t in self._merge(self._front + spelled)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self._before.get(chunk)
        if found is None:
            if not chunk or chunk[0].isspace():
                raise _White
            found = self.ids(chunk)
        if len(chunk) < 64:
            if len(self) > _MEMO_MOST:
                self._before = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def ids(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._merged(chunk)
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return array(self._kind, self._encode(self._space + chunk, add_special_tokens=False).ids).tobytes()
        word, *rest = plain.groups()
        if word == chunk:
            return self._merged(word.encode().decode("latin-1").translate(self._letters))
        found = self[word]
        for piece in rest:
            if piece:
                found += self._inner.ids(piece) if piece == "\n" else self._inner[piece]
        return found


class Encoder:
    """Ids of a tokenizer file of byte-level merges, with those of chunks between spaces remembered."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._first = Chunks(tokenizer, self.width, "", None)
        self._later = Chunks(tokenizer, self.width, " ", self._first)

    def encode(self, text: str) -> bytes:
        """Serialised ids of a text."""
        first, *later = text.split(" ")
        try:
            return (self._first[first] if first else b"") + b"".join(map(self._later.__getitem__, later))
        except _White:
            first, *later = _BREAK.split(text)
            return (self._first.ids(first) if first else b"") + b"".join([self._later.ids(c) if not c or c[0].isspace() else self._later[c] for c in later])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(texts: pa.Array, tokenizer: str, end_id: int) -> Iterator[bytes]:
    """Serialised ids and end id of each text."""
    enc = encoder(tokenizer)
    tail = np.array([end_id], dtype=f"<u{enc.width}").tobytes()
    for t in texts:
        yield enc.encode(t.as_py() or "") + tail


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, size: int, sample_rows: int) -> bytes:
    """A dictionary of `size` bytes at most from the `sample_rows` documents with the least hashes.

    One task trains it, on 128 * size bytes of ids at most. Where there is too little to train on, the ids
    themselves are the dictionary.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for ids in _encoded(b.column("text"), tokenizer, end_id):
                for at in range(0, len(ids), 1 << 13):
                    if held < 128 * size:
                        parts.append(ids[at : at + (1 << 13)])
                        held += len(parts[-1])
        try:
            found = zstandard.train_dictionary(size, parts).as_bytes()
        except (zstandard.ZstdError, ValueError):
            found = b"".join(parts)[-size:]
        yield pa.RecordBatch.from_pydict({"dictionary": [found]})

    sample = least_hashes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), sample_rows, "key").select("text")
    found = sample.coalesce(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(found[0]["dictionary"]) if found else b""


def compressed(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes, key: str, text: str, level: int) -> DataFrame:
    """(key, n_ids, crc, frame) of each document."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            n, crc, frame = [], [], []
            for ids in _encoded(b.column("text"), tokenizer, end_id):
                n.append(len(ids) // encoder(tokenizer).width)
                crc.append(zlib.crc32(ids))
                frame.append(pack.compress(ids))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frame, pa.binary())], names=["key", "n_ids", "crc", "frame"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(frames, f"key {kind}, n_ids long, crc long, frame binary")


class Writer:
    """One file. Frames are written as they come; the index is kept until the end."""

    def __init__(self, uri: str, width: int, dictionary: bytes):
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.uri, self._out = uri, files.open_output_stream(path, buffer_size=1 << 20)
        self._out.write(_HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.at, self.ids, self.docs = _HEAD.size, 0, 0
        self._index: list[pa.RecordBatch] = []

    def add(self, b: pa.RecordBatch) -> None:
        size = np.array([len(f.as_buffer()) for f in b.column("frame")], dtype=np.int64)
        n = b.column("n_ids").to_numpy()
        offset, before = self.at + np.cumsum(size) - size, self.ids + np.cumsum(n) - n
        for f in b.column("frame"):
            self._out.write(f.as_buffer())
        self._index.append(pa.RecordBatch.from_arrays([b.column("key"), *map(pa.array, (offset, size, n, before))], names=["key", "offset", "n_bytes", "n_ids", "before"]))
        self.at, self.ids, self.docs = self.at + int(size.sum()), self.ids + int(n.sum()), self.docs + b.num_rows

    def close(self) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self._index[0].schema) as w:
            for b in self._index:
                w.write_batch(b)
        index = sink.getvalue()
        self._out.write(index)
        self._out.write(_FOOT.pack(self.at, len(index), MAGIC))
        self._out.close()


class Reader:
    """One file: its documents in order, or single ones by their place or key."""

    def __init__(self, uri: str, dictionary: bytes):
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        self._in = files.open_input_file(path)
        magic, self.width, of = _HEAD.unpack(self._in.read_at(_HEAD.size, 0))
        at, length, end = _FOOT.unpack(self._in.read_at(_FOOT.size, self._in.size() - _FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is no file of token ids, or not whole")
        if of != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = pa.ipc.open_stream(self._in.read_at(length, at)).read_all().combine_chunks()
        self._unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def close(self) -> None:
        self._in.close()

    def at(self, place: int) -> np.ndarray:
        """Ids of one document, by its place in the file; nothing else of the frames is read."""
        row = self.index.slice(place, 1).to_pylist()[0]
        return np.frombuffer(self._unpack.decompress(self._in.read_at(row["n_bytes"], row["offset"])), dtype=f"<u{self.width}")

    def of(self, key) -> list[np.ndarray]:
        """Ids of the documents with this key."""
        keys = self.index.column("key").drop_null().to_pylist()
        nulls = len(self.index) - len(keys)
        first = bisect_left(keys, key)
        out = []
        while first < len(keys) and keys[first] == key:
            out.append(self.at(nulls + first))
            first += 1
        return out

    def batches(self, most_bytes: int = 1 << 22) -> Iterator[tuple[pa.Table, list[bytes]]]:
        """(rows of the index, serialised ids of each), about `most_bytes` of frames at a time."""
        offset, size = self.index.column("offset").to_numpy(), self.index.column("n_bytes").to_numpy()
        at = 0
        while at < len(offset):
            to = max(at + 1, int(np.searchsorted(offset + size, offset[at] + most_bytes, side="right")))
            raw = memoryview(self._in.read_at(int(offset[to - 1] + size[to - 1] - offset[at]), int(offset[at])))
            places = zip((offset[at:to] - offset[at]).tolist(), size[at:to].tolist(), strict=True)
            yield self.index.slice(at, to - at), [self._unpack.decompress(raw[o : o + n]) for o, n in places]
            at = to


class TokenFiles:
    """Files of one table: `manifest` is (file, docs, n_ids, start), in order; start counts the ids of all files before."""

    def __init__(self, spark: SparkSession, manifest: list[tuple[str, int, int, int]], dictionary: bytes, key_type: str):
        self.spark, self.manifest, self.dictionary, self.key_type = spark, manifest, dictionary, key_type

    def rows(self, ids: bool = False) -> DataFrame:
        """(key, start, n_ids, ids_crc32) of each document as read from the files, with `ids` on demand.

        The checksum is that of the ids as unsigned little-endian integers of 32 bits.
        """
        dictionary = self.dictionary

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for uri, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                    file = Reader(uri, dictionary)
                    for index, frames in file.batches():
                        arrays = [np.frombuffer(f, dtype=f"<u{file.width}") for f in frames]
                        crc = [zlib.crc32(a.astype("<u4")) for a in arrays]
                        n = np.array([len(a) for a in arrays], dtype=np.int64)
                        if not np.array_equal(n, index.column("n_ids").to_numpy()):
                            raise ValueError(f"{uri}: index and frames differ")
                        cols = [index.column("key").combine_chunks(), pa.array(index.column("before").to_numpy() + base), pa.array(n), pa.array(crc, pa.int64())]
                        if ids:
                            cols.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "n_ids", "ids_crc32", "ids"][: len(cols)])
                    file.close()

        schema = f"key {self.key_type}, start long, n_ids long, ids_crc32 long" + (", ids array<int>" if ids else "")
        files = self.spark.createDataFrame([(f, s) for f, _, _, s in self.manifest], "file string, start long")
        return files.repartition(max(1, len(self.manifest))).mapInArrow(read, schema)


def write(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = 8 << 20, dictionary_bytes: int = 112 << 10, sample_rows: int = 2000, level: int = 3
) -> TokenFiles:
    """Write the ids of all documents to files of about `file_bytes` in `folder`, a new one in the shared folder by default."""
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}").rstrip("/")
    dictionary = train_dictionary(docs, tokenizer, end_id, key, text, dictionary_bytes, sample_rows)
    width = encoder(tokenizer).width
    frames = written(compressed(docs, tokenizer, end_id, dictionary, key, text, level), "frames")
    total = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    each = max(file_bytes, total // MOST_FILES)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        done: list[Writer] = []
        out = None
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                if out is None:
                    files, path = pyarrow.fs.FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    out = Writer(f"{folder}/{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids", width, dictionary)
                out.add(b.slice(at, 1024))
                if out.at >= 2 * each:
                    out.close()
                    done, out = [*done, out], None
        if out is not None:
            out.close()
            done.append(out)
        yield pa.RecordBatch.from_pydict({"task": pa.array([task] * len(done), pa.int64()), "nth": pa.array(range(len(done)), pa.int64()), "file": pa.array([w.uri for w in done], pa.string()), "docs": pa.array([w.docs for w in done], pa.int64()), "n_ids": pa.array([w.ids for w in done], pa.int64())})

    order = ["key", "crc", "n_ids"]
    dealt = frames.repartitionByRange(total // each + 1, *order).sortWithinPartitions(*order)
    stored = written(dealt.mapInArrow(store, "task long, nth long, file string, docs long, n_ids long"), "manifest")
    files = stored.orderBy("task", "nth").collect()
    discard(frames)
    starts = np.cumsum([0, *(f["n_ids"] for f in files)]).tolist()
    manifest = [(f["file"], f["docs"], f["n_ids"], s) for f, s in zip(files, starts, strict=False)]
    _delete_on_exit(spark, folder)
    return TokenFiles(spark, manifest, dictionary, docs.schema[key].dataType.simpleString())


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    """Folders in the shared folder go with the application; others stay."""
    if folder.startswith(shared_dir(spark) + "/"):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
