"""Binary logs: the records of `records` in little-endian bytes, one after another, behind four bytes that name the form.

No record tells its length or its time: a log is read from the front, each record by the layout of the log's version, and the
time is that of the last frame. So a log is read, and written, by one task, in pieces; logs are dealt to tasks by size. What
follows in a layout in fixed widths is packed and unpacked at once; where that fails, field by field.

`spark.read.format("binary_log").load(folder)` gives the records of all binary logs below a folder, as text would have them;
with option `lines` those that are text come along, see `BinaryLogReader`. `records.write.format("binary_log")` writes logs, see
`oplog.write_logs`.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache
from itertools import chain
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from chronofold.sources.records import ACTION_KINDS, CLASSES, LATEST, OLDEST_BINARY, TAGS, Field, layout

#: What a log begins with. There is no codec for compressed ones.
RAW, COMPRESSED = b"BLOG", b"BLCB"
#: .NET ticks, of which a microsecond has ten, at the beginning of 1970.
EPOCH_TICKS = 621_355_968_000_000_000
SCHEMA = "replay_id string, op_seq long, ts_us long, version int, tag string, fields array<string>, error string"
_ARROW = pa.schema([("replay_id", pa.string()), ("op_seq", pa.int64()), ("ts_us", pa.int64()), ("version", pa.int32()), ("tag", pa.string()), ("fields", pa.list_(pa.string())), ("error", pa.string()), ("line", pa.string())])

_NUMBERS = {"i8": "b", "i16": "h", "i32": "i", "i64": "q", "u8": "B", "u16": "H", "u32": "I", "u64": "Q", "f32": "f", "f64": "d"}
_PACK = {k: struct.Struct("<" + c) for k, c in _NUMBERS.items()} | {f"x{n}": struct.Struct("<" + _NUMBERS[f"u{n}"]) for n in (8, 16, 32, 64)}
_KIND_OF = {v: k for k, v in ACTION_KINDS.items()}
#: What is taken for zero where a log ends within a record; any other value that is cut off makes the record, and its log, a broken one.
_ZERO_IF_CUT = {"f32", "f64", "i32", "u32", "x32", "u64", "x64"}


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path there; names may hold any character, as Hadoop's may."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe="/:@"))


class Broken(ValueError):
    """The log can't be read on."""


class _Bytes:
    """A stream read in pieces."""

    def __init__(self, stream, piece: int = 1 << 20, held: bytes = b""):
        self._stream, self._piece, self._held, self._at = stream, piece, held, 0

    def take(self, n: int) -> bytes:
        """The next n bytes, or what there is."""
        if len(self._held) - self._at < n:
            parts, have = [self._held[self._at :]], len(self._held) - self._at
            while have < n and (more := self._stream.read(max(self._piece, n - have))):
                parts.append(more)
                have += len(more)
            self._held, self._at = b"".join(parts), 0
        out = self._held[self._at : self._at + n]
        self._at += len(out)
        return out

    def back(self, n: int) -> None:
        """Go back over the last n bytes, of one `take`."""
        self._at -= n


def _shown(v: float, digits: str) -> str:
    return f"{v:.{digits}f}" if digits else f"{v:.9g}"


_RADIANS = 57.29577951308232
_STATUS = struct.Struct("<IHqQ")
#: Kinds of fixed width: what they are packed as, how they are shown, and what is done with the number before.
_SHOWN: dict[str, tuple[str, str, Callable | None]] = {
    "actor": ("Q", "%08X", None),
    "vector": ("fff", "%.3f/%.3f/%.3f", None),
    "pair": ("ff", "%.3f/%.3f", None),
    "angle": ("f", "%.3f", lambda v: v * _RADIANS),
    "bool": ("B", "%s", lambda v: "True" if v else "False"),
    "void": ("", "", None),
    "action": ("I", "%s", lambda v: f"{_KIND_OF.get(v >> 24, v >> 24)} {v & 0xFFFFFF}"),
    "class": ("B", "%s", lambda v: CLASSES[v] if v < len(CLASSES) else str(v)),
}


def _shown_as(kind: str) -> tuple[str, str, Callable | None] | None:
    kind, _, digits = kind.partition("/")
    if kind in _PACK:
        return _PACK[kind].format[1:], {"x": f"%0{digits}X", "f": f"%.{digits}f" if digits else "%.9g"}.get(kind[0], "%d"), None
    return _SHOWN.get(kind)


@cache
def _reads(tag: str, version: int) -> tuple:
    """How a record is read: (None, field), or for fields of fixed width that follow each other (struct, form, numbers to change, fields)."""
    out: list[tuple] = []
    run: list[Field] = []

    def close() -> None:
        if run:
            how = [_shown_as(f.kind) for f in run]
            at, changed = 0, []
            for code, _, f in how:
                if f:
                    changed.append((at, f))
                at += len(code)
            out.append((struct.Struct("<" + "".join(h[0] for h in how)), "|".join(h[1] for h in how), tuple(changed), tuple(run)))
            run.clear()

    for f in layout(tag, version):
        if _shown_as(f.kind):
            run.append(f)
        else:
            close()
            out.append((None, f))
    close()
    return tuple(out)


_TAG_OF = {t.encode("latin-1"): t for t in TAGS}


class Decoder:
    """(ts_us, version, tag, fields) of each record of one log, with fields as text has them; `begun` is what was read of it before."""

    def __init__(self, stream, begun: bytes = b""):
        self._in = _Bytes(stream, held=begun)
        self.version, self.ticks = 0, 0
        self._start, self._frequency, self._first_counter = 0, 10_000_000, None

    def _number(self, kind: str):
        p = _PACK[kind]
        raw = self._in.take(p.size)
        if len(raw) < p.size:
            if kind in _ZERO_IF_CUT:
                return 0
            raise Broken("the log ends within a record")
        return p.unpack(raw)[0]

    def _hard(self, kind: str):
        p = _PACK[kind]
        raw = self._in.take(p.size)
        if len(raw) < p.size:
            raise Broken("the log ends within a record")
        return p.unpack(raw)[0]

    def _text(self) -> str:
        n, shift = 0, 0
        while True:
            b = self._hard("u8")
            n |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
        raw = self._in.take(n)
        if len(raw) < n:
            raise Broken("the log ends within a record")
        return raw.decode("utf-8", "replace")

    def _list(self, f: Field) -> list[str]:
        n = int(f.count) if f.count.isdigit() else self._number(f.count)
        out = [] if f.count.isdigit() else [str(n)]
        for _ in range(n):
            for p in f.item:
                out += self._field(p)
        return out

    def _field(self, f: Field) -> list[str]:
        kind, _, digits = f.kind.partition("/")
        if kind == "list":
            return self._list(f)
        if kind in _PACK:
            v = self._number(kind)
            return [f"{v:0{digits}X}" if kind[0] == "x" else _shown(v, digits) if kind[0] == "f" else str(v)]
        if kind == "actor":
            return [f"{self._hard('u64'):08X}"]
        if kind == "vector":
            return ["/".join(f"{self._number('f32'):.3f}" for _ in range(3))]
        if kind == "angle":
            return [f"{self._number('f32') * _RADIANS:.3f}"]
        if kind == "bool":
            return ["True" if self._hard("u8") else "False"]
        if kind == "text":
            return [self._text()]
        if kind == "void":
            return [""]
        if kind == "action":
            raw = self._hard("u32")
            return [f"{_KIND_OF.get(raw >> 24, raw >> 24)} {raw & 0xFFFFFF}"]
        if kind == "class":
            v = self._hard("u8")
            return [CLASSES[v] if v < len(CLASSES) else str(v)]
        if kind == "pair":
            return ["/".join(f"{self._hard('f32'):.3f}" for _ in range(2))]
        if kind == "until":
            end, total = self._hard("i64"), self._hard("f32")
            return [f"{(end - self.ticks) / 1e7:.3f}/{total:.3f}"]
        if kind == "status":
            raw = self._in.take(_STATUS.size)
            if len(raw) == _STATUS.size:
                status, extra, end, source = _STATUS.unpack(raw)
                return [str(status), f"{extra:04X}", f"{max(0, end - self.ticks) / 1e7:.3f}", f"{source:08X}"]
            self._in.back(len(raw))
            try:
                status, extra, end, source = (self._hard(k) for k in ("u32", "u16", "i64", "u64"))
            except Broken:
                return ["0", "0000", "0.000", "00000000"]
            return [str(status), f"{extra:04X}", f"{max(0, end - self.ticks) / 1e7:.3f}", f"{source:08X}"]
        if kind == "targets":
            out = []
            for _ in range(self._hard("i32")):
                one = f"{self._hard('u64'):08X}"
                effects = [self._number("u64") for _ in range(8)]
                out.append(one + "".join(f"!{e:016X}" for e in effects if e))
            return out
        if kind == "bytes":
            n = self._number("i32")
            return [self._in.take(n).hex().upper()]
        raise ValueError(kind)

    def __iter__(self) -> Iterator[tuple[int, int, str, list[str]]]:
        head = self._in.take(4)
        if head == COMPRESSED:
            raise Broken("there is no codec for compressed logs")
        if head != RAW:
            raise Broken("no binary log")
        while len(raw := self._in.take(4)) == 4:
            tag = _TAG_OF.get(raw)
            if tag is None:
                raise Broken(f"unknown tag {raw.decode('latin-1')}")
            if tag != "VER " and not self.version:
                raise Broken("no version")
            if tag == "VER ":
                # A version's own record tells its layout.
                self.version = self._number("i32")
                if self.version < OLDEST_BINARY:
                    raise Broken(f"version {self.version} is too old")
                fields = [str(self.version), *(x for f in layout(tag, self.version)[1:] for x in self._field(f))]
                self._frequency = int(fields[1])
                self._start = self.ticks = self._hard("i64")
                self._first_counter = None
            else:
                fields = self._fields(_reads(tag, self.version))
                if tag == "FRAM":
                    self._advance(int(fields[4 if self.version >= 18 else 3]))
            yield (self.ticks - EPOCH_TICKS) // 10, self.version, tag, fields

    def _fields(self, reads: tuple) -> list[str]:
        out: list[str] = []
        for packed, *how in reads:
            if packed is None:
                out += self._field(how[0])
                continue
            form, changed, fields = how
            raw = self._in.take(packed.size)
            if len(raw) < packed.size:
                # The log ends here: each field has its own rule for that.
                self._in.back(len(raw))
                for f in fields:
                    out += self._field(f)
                continue
            values = packed.unpack(raw)
            if changed:
                values = list(values)
                for i, f in changed:
                    values[i] = f(values[i])
            out += (form % tuple(values)).split("|")
        return out

    def _advance(self, counter: int) -> None:
        if not self._first_counter:
            self._first_counter = counter
        gone = counter - self._first_counter
        self.ticks = self._start + (gone * 10_000_000 // self._frequency if gone > 0 else 0)


def _packed_as(kind: str) -> tuple[str, Callable] | None:
    """What a kind of fixed width is packed as, and its numbers from text."""
    kind = kind.partition("/")[0]
    if kind in _PACK:
        number: Callable = {"f": float, "x": lambda t: int(t, 16)}.get(kind[0], int)
        return _PACK[kind].format[1:], number
    return {"actor": ("Q", lambda t: int(t.split("/")[0], 16)), "vector": ("fff", None), "pair": ("ff", None), "angle": ("f", lambda t: float(t) / _RADIANS), "bool": ("B", lambda t: t.lower() == "true"), "action": ("I", _action_number), "class": ("B", lambda t: _CLASS_NUMBER[t] if t in _CLASS_NUMBER else int(t))}.get(kind)


_CLASS_NUMBER = {c: i for i, c in enumerate(CLASSES)}


def _action_number(text: str) -> int:
    name, number, *_ = [*text.split(" "), "0"]
    return (ACTION_KINDS[name] if name in ACTION_KINDS else int(name)) << 24 | int(number)


def _text_bytes(text: str) -> bytes:
    raw = text.encode()
    n, out = len(raw), []
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n]) + raw


@cache
def _writes(tag: str) -> tuple[int, tuple, tuple[Field, ...]]:
    """How a record of the latest version is written: so many fields at once, in steps, and those that are left.

    A step is None for a text, or (struct, numbers from text) for fields of fixed width that follow each other.
    """
    steps: list = []
    run: list[tuple[str, Callable]] = []
    fields = layout(tag)
    n = 0

    def close() -> None:
        if run:
            steps.append((struct.Struct("<" + "".join(c for c, _ in run)), tuple(f for _, f in run)))
            run.clear()

    for f in fields:
        if f.kind == "text":
            close()
            steps.append(None)
        elif how := (("", _nothing) if f.kind == "void" else _packed_as(f.kind)):
            run.append(how)
        else:
            break
        n += 1
    close()
    return n, tuple(steps), fields[n:]


def _nothing(text: str) -> None:
    """Of a field that has no bytes."""


class Encoder:
    """The bytes of one log of the latest version, record by record."""

    _layouts = {t: layout(t) for t in TAGS}

    def header(self) -> bytes:
        return RAW

    def record(self, ts_us: int, tag: str, fields: list[str]) -> bytes:
        ticks = ts_us * 10 + EPOCH_TICKS
        out = [tag.encode("latin-1")]
        at, rest = 0, self._layouts[tag]
        n, steps, left = _writes(tag)
        # Fields that are missing or null have defaults, and are written one by one as all that is left.
        if tag != "VER " and len(fields) >= n and None not in fields and self._at_once(out, steps, fields):
            at, rest = n, left
        for f in rest:
            at = self._field(out, f, fields, at, ticks)
        if tag == "VER ":
            out[1] = _PACK["i32"].pack(LATEST)
            out.append(_PACK["i64"].pack(ticks))
        return b"".join(out)

    def _at_once(self, out: list[bytes], steps: tuple, fields: list[str]) -> bool:
        """Append what `steps` write, where they can."""
        at, done = 0, []
        for step in steps:
            if step is None:
                done.append(_text_bytes(fields[at]))
                at += 1
                continue
            packed, numbers = step
            values: list = []
            for number in numbers:
                text = fields[at]
                at += 1
                if number is None:
                    values += map(float, text.split("/"))
                elif number is not _nothing:
                    values.append(number(text))
            try:
                done.append(packed.pack(*values))
            except struct.error:
                return False
        out += done
        return True

    def _field(self, out: list[bytes], f: Field, fields: list[str], at: int, ticks: int) -> int:
        kind = f.kind.partition("/")[0]
        put = lambda k, v: out.append(_PACK[k].pack(v))
        if kind == "list":
            n = int(f.count) if f.count.isdigit() else int(fields[at])
            if not f.count.isdigit():
                put(f.count, n)
                at += 1
            for _ in range(n):
                for p in f.item:
                    at = self._field(out, p, fields, at, ticks)
            return at
        if kind == "targets":
            put("i32", len(fields) - at)
            for one in fields[at:]:
                who, *effects = one.split("!")
                put("u64", int(who.split("/")[0], 16))
                for e in [*effects, *["0"] * 8][:8]:
                    put("u64", int(e, 16))
            return len(fields)
        if kind == "status":
            put("u32", int(fields[at].split(" ")[0]))
            put("u16", int(fields[at + 1], 16))
            put("i64", ticks + round(float(fields[at + 2]) * 1e7))
            put("u64", int(fields[at + 3].split("/")[0], 16))
            return at + 4
        text = fields[at] if at < len(fields) and (fields[at] is not None) else f.default
        if text is None and kind != "void":
            raise Broken(f"field {f.name} is missing")
        if kind in _PACK:
            put(kind, float(text) if kind[0] == "f" else int(text, 16 if kind[0] == "x" else 10))
        elif kind == "actor":
            put("u64", int(text.split("/")[0], 16))
        elif kind in ("vector", "pair"):
            for v in text.split("/"):
                put("f32", float(v))
        elif kind == "angle":
            put("f32", float(text) / _RADIANS)
        elif kind == "bool":
            out.append(b"\1" if text.lower() == "true" else b"\0")
        elif kind == "text":
            out.append(_text_bytes(text))
        elif kind == "action":
            put("u32", _action_number(text))
        elif kind == "class":
            put("u8", CLASSES.index(text) if text in CLASSES else int(text))
        elif kind == "bytes":
            raw = bytes.fromhex(text)
            put("i32", len(raw))
            out.append(raw)
        elif kind != "void":
            raise ValueError(kind)
        return at + 1


_VERSION = re.compile(r"\s*[+-]?[0-9]+\s*", re.ASCII)


def _text_version(lines: list[str]) -> int | None:
    """What the first `VER ` record of a text log tells, as `oplog.parse` and `records.with_version` have it."""
    for text in lines:
        f = text.split("|", 3)
        if len(f) > 1 and f[1] == "VER " and not text.lstrip(" ").startswith("#"):
            own = f[2] if len(f) > 2 else ""
            return int(own) if _VERSION.fullmatch(own) and -(1 << 31) <= int(own) < 1 << 31 else None
    return None


def _text_lines(raw: bytes) -> list[str]:
    """Lines as Spark's reader has them."""
    text = raw.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    return text.removesuffix("\n").split("\n") if text else []


def _rows_of(uri: str, name: str, lines: bool) -> Iterator[tuple]:
    """The rows of one log. Where a binary one can't be read on, the last has an `error` and no tag; of a text one there are lines, if asked for."""
    files, path = _store(uri)
    with files.open_input_stream(path, buffer_size=0) as stream:
        head = stream.read(4)
        if head not in (RAW, COMPRESSED):
            if lines:
                told = _text_lines(head + stream.read())
                version = _text_version(told)
                for i, text in enumerate(told):
                    yield name, i, None, version, None, None, None, text
            return
        decoder, seq = Decoder(stream, head), 0
        try:
            for ts, version, tag, fields in decoder:
                yield name, seq, ts, version, tag, fields, None, None
                seq += 1
        except Broken as e:
            yield name, seq, (decoder.ticks - EPOCH_TICKS) // 10 if decoder.ticks else None, decoder.version or None, None, None, str(e), None


def _lists(rows: tuple[list[str] | None, ...]) -> pa.ListArray:
    """Lists of strings as a column, put together from all strings at once, which takes less than list by list."""
    ends = np.cumsum([0, *(len(r) if r else 0 for r in rows)], dtype=np.int32)
    flat = pa.array(list(chain.from_iterable(r for r in rows if r)), pa.string())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([r is None for r in rows], pa.bool_()))


def records_of(logs: list[tuple[str, str]], lines: bool = False, rows: int = 4096, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of logs, (URI, name), one after another."""
    schema = _ARROW if lines else pa.schema(list(_ARROW)[:-1])
    held: list[tuple] = []
    have = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True)) if held else [()] * len(_ARROW)
        held.clear()
        return pa.RecordBatch.from_arrays([_lists(c) if f.name == "fields" else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for uri, name in logs:
        for row in _rows_of(uri, name, lines):
            held.append(row)
            have += len(row[7]) if row[7] else sum(map(len, row[5])) if row[5] else 0
            if len(held) == rows or have >= size:
                yield batch()
                have = 0
    yield batch()


def log_files(path: str) -> list[tuple[str, str, int]]:
    """(URI, name below the folder, bytes) of all logs below a folder, or of one file."""
    files, root = _store(path)
    scheme = path[: path.index("://") + 3] if "://" in path else "file://" if path.startswith("/") else path.partition(":")[0] + "://"
    info = files.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [(scheme + root, posixpath.basename(root), info.size)]
    found = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    below = [(f, posixpath.relpath(f.path, root)) for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".log")]
    return sorted((scheme + f.path, name, f.size) for f, name in below if not any(p.startswith(("_", ".")) for p in name.split("/")))


def is_binary(uri: str) -> bool:
    files, path = _store(uri)
    with files.open_input_stream(path, buffer_size=0) as stream:
        return stream.read(4) in (RAW, COMPRESSED)


@dataclass
class _Part(InputPartition):
    #: Logs below a folder, by name.
    folder: str
    logs: list[str]


class BinaryLogReader(DataSourceReader):
    """Binary logs as records. With `lines`, text logs up to TEXT_BYTES as well: a row for each line, with the version of its log."""

    #: Logs are put together until a part has so many bytes, where each costs some more than its own.
    PART_BYTES, LOG_BYTES = 8 << 20, 4 << 10
    #: Longer text logs are left to Spark's reader, which splits them.
    TEXT_BYTES = 32 << 20

    def __init__(self, path: str, lines: bool = False):
        self._path, self._lines = path, lines

    def partitions(self) -> list[_Part]:
        out: list[_Part] = []
        size = self.PART_BYTES
        for uri, name, n in log_files(self._path):
            if n > self.TEXT_BYTES and not is_binary(uri):
                continue
            if size >= self.PART_BYTES:
                out.append(_Part(uri.removesuffix(name), []))
                size = 0
            out[-1].logs.append(name)
            size += n + self.LOG_BYTES
        return out or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return records_of([(partition.folder + name, name) for name in partition.logs], self._lines)


@dataclass
class _Written(WriterCommitMessage):
    #: The folder that a task has written its logs to, each by its path below.
    folder: str | None


class LogWriter(DataSourceArrowWriter):
    """Each log goes to a file of its own beside the folder's others, which take their names when all tasks are done.

    Their names stay in the store: of a task, the driver knows the folder alone.
    """

    #: Bytes held for a log; each has a buffer of its own, and one of a megabyte takes longer to make than a short log to write.
    BUFFER = 1 << 16
    #: Tasks whose files are renamed at once.
    RENAMED_AT_ONCE = 16

    def __init__(self, path: str, binary: bool):
        self._path, self._binary, self._job = path.rstrip("/"), binary, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _store(self._path)
        own = f"{root}/_staged-{self._job}/{uuid.uuid4().hex}"
        made: set[str] = set()
        name, out, encoder = None, None, Encoder()
        for b in batches:
            names = b.column("replay_id").to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            pieces = self._pieces(b, encoder)
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[start] != name or out is None:
                    if out is not None:
                        out.close()
                    name = names[start]
                    place = f"{own}/{name}"
                    if (folder := posixpath.dirname(place)) not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = files.open_output_stream(place, buffer_size=self.BUFFER)
                    if self._binary:
                        out.write(encoder.header())
                out.write(b"".join(pieces[start:end]))
        if out is not None:
            out.close()
        return _Written(own if made else None)

    def _pieces(self, b: pa.RecordBatch, encoder: Encoder) -> list[bytes]:
        """The bytes of each record of a batch."""
        if not self._binary:
            return [(text + "\n").encode() for text in b.column("line").to_numpy(zero_copy_only=False)]
        of = b.column("fields")
        ends = np.cumsum(of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        values = of.flatten().to_numpy(zero_copy_only=False).tolist()
        tags = b.column("tag").to_numpy(zero_copy_only=False)
        return [encoder.record(ts, tag, values[start:end]) for ts, tag, start, end in zip(b.column("ts_us").to_pylist(), tags, [0, *ends], ends)]

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _store(self._path)
        made: set[str] = set()

        def rename(own: str) -> None:
            for f in files.get_file_info(pyarrow.fs.FileSelector(own, recursive=True)):
                if f.type == pyarrow.fs.FileType.File:
                    final = f"{root}/{posixpath.relpath(f.path, own)}"
                    if (folder := posixpath.dirname(final)) not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    files.move(f.path, final)

        with ThreadPoolExecutor(self.RENAMED_AT_ONCE) as several:
            list(several.map(rename, [m.folder for m in messages if m and m.folder]))
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self._path))

    def _clear(self, files, root: str) -> None:
        staged = f"{root}/_staged-{self._job}"
        if files.get_file_info(staged).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(staged)


class BinaryLogs(DataSource):
    """Logs below a folder; option `lines` for reading, see `BinaryLogReader`, and `form` for writing, binary or text."""

    @classmethod
    def name(cls) -> str:
        return "binary_log"

    def _lines(self) -> bool:
        return self.options.get("lines", "false").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + (", line string" if self._lines() else "")

    def reader(self, schema) -> BinaryLogReader:
        return BinaryLogReader(self.options["path"], self._lines())

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], self.options.get("form", "binary") == "binary")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinaryLogs)
