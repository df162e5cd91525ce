"""Media columns in the FLAC format (RFC 9639): one channel of 8-bit samples.

The decoder reads constant, verbatim, fixed and linear-predictor subframes with Rice-coded
residuals, checks the CRC-8 of each frame's header, the CRC-16 of each frame and the MD5 of the
samples, and gives blocks of PCM with the offset of their first sample. The encoder writes the
shortest of fixed predictors of order 0 and 1 and a linear one of order 1, each with its best Rice
parameter, verbatim and constant subframes, and a seek point for each frame.

Frames don't depend on one another, so all frames of a batch of files are coded at once: a step
handles the next sample of each. Batches are bounded by samples, so memory is as well.

Defined results: a null or empty text is an empty payload and pads to one unit of 576 bytes.
Equal payloads give equal files. A file with a failing check sum raises FlacError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
BLOCK = 4608
#: Samples that are coded at once.
BATCH = 4_000_000
#: Frames that are written at once; their samples' places take the most memory.
WRITE = 16
#: Frames that are read at once.
READ = 2048
#: Codes of block sizes that the header names itself.
_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
_SIZES = {v: k for k, v in _SIZE_CODES.items()}


class FlacError(ValueError):
    """The bytes are no whole FLAC stream of the kind read here."""


def _table(poly: int, width: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (width - 1) else 0)
            c &= (1 << width) - 1
        out.append(c)
    return np.array(out, dtype=np.uint16)


_CRC8 = _table(0x07, 8).tolist()
_CRC16 = _table(0x8005, 16)
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = _CRC8[c ^ x]
    return c


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of `data`, a byte of each at a time."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    c = np.zeros(len(s), dtype=np.uint16)
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right") if len(n) else []
    for i, k in enumerate(live):
        x = c[:k]
        c[:k] = (x << np.uint16(8)) ^ _CRC16[(x >> np.uint16(8)) ^ data[s[:k] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended form of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([((~lead << 1) & 0xFF) | n, *reversed(tail)])


def _header(number: int, size: int) -> bytes:
    code = _SIZE_CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([crc8(head)])


def _rice_lengths(u: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of the cheapest Rice code of each frame."""
    best, k_best = None, None
    for k in range(9):
        bits = np.add.reduceat(u >> k, first) + size * (k + 1)
        if best is None:
            best, k_best = bits, np.zeros(len(bits), dtype=np.int64)
        else:
            k_best[bits < best] = k
            best = np.minimum(best, bits)
    return best, k_best


def _bodies(samples: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of all frames, each padded to whole bytes: (bytes, length of each)."""
    x = samples.astype(np.int32)
    frame = np.repeat(np.arange(len(first)), size)
    zig = lambda r: np.where(r < 0, -2 * r - 1, 2 * r)
    diff = np.diff(x, prepend=x[:1])
    diff[first] = 0
    #: One factor for each frame, the least-squares one, as a signed number of seven bits in units of 1/32.
    before = np.concatenate([x[:1], x[:-1]])
    before[first] = 0
    power = np.maximum(np.add.reduceat(before.astype(np.int64) ** 2, first), 1)
    factor = np.clip(np.rint(32 * np.add.reduceat(x.astype(np.int64) * before, first) / power), -63, 63).astype(np.int32)
    linear = x - ((factor[frame] * before) >> 5)
    linear[first] = 0
    u = np.stack([zig(x), zig(diff), zig(linear)])
    coded_bits = [_rice_lengths(r, first, size) for r in u]
    #: Beyond the residuals: the first sample as it is, and the factor with its precision and shift.
    extra = np.array([0, 8, 24])[:, None]
    kinds = np.stack([b for b, _ in coded_bits]) + extra
    kinds[1:] -= np.stack([k + 1 for _, k in coded_bits[1:]])
    mode = kinds.argmin(axis=0)
    own = np.arange(len(first))
    k = np.stack([k for _, k in coded_bits])[mode, own]
    cost = kinds[mode, own] + 10
    one = mode > 0
    constant = np.add.reduceat((diff != 0).astype(np.int64), first) == 0
    verbatim = ~constant & (cost >= 8 * size)
    total = 8 + np.where(constant, 8, np.where(verbatim, 8 * size, cost))
    length = (total + 7) // 8
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(begin[-1]) + 8, dtype=np.float64)
    head = np.where(constant, 0, np.where(verbatim, 1, np.array([8, 9, 32])[mode])) << 1
    out[begin[:-1]] = head
    out[begin[:-1][constant] + 1] = samples[first[constant]].view(np.uint8)
    raw = verbatim[frame]
    at = np.arange(len(x)) - first[frame]
    out[(begin[:-1][frame] + 1 + at)[raw]] = samples.view(np.uint8)[raw]
    rice = ~constant & ~verbatim
    #: Residual method 0, partition order 0, then the parameter: ten bits after the warm-up sample.
    warm = rice & one
    out[begin[:-1][warm] + 1] = samples[first[warm]].view(np.uint8)
    by = rice & (mode == 2)
    described = (6 << 12) | (5 << 7) | (factor & 0x7F)
    out[begin[:-1][by] + 2] = described[by] >> 8
    out[begin[:-1][by] + 3] = described[by] & 0xFF
    spot = begin[:-1] + 1 + warm + 2 * by
    out[spot[rice]] += k[rice] >> 2
    out[spot[rice] + 1] += (k[rice] & 3) << 6
    coded = rice[frame] & ~(warm[frame] & (at == 0))
    f = frame[coded]
    v = u[mode[f], np.flatnonzero(coded)].astype(np.int64)
    kk = k[f]
    q = v >> kk
    bits = q + 1 + kk
    so_far = np.cumsum(bits) - bits
    starts = np.flatnonzero(np.diff(f, prepend=-1))
    base = np.zeros(len(first), dtype=np.int64)
    base[f[starts]] = so_far[starts]
    place = 8 * spot[f] + 10 + so_far - base[f] + q
    #: The stop bit and the low bits, up to nine in all, fall into two bytes at most.
    word = ((np.int64(1) << kk) | (v & ((np.int64(1) << kk) - 1))) << (16 - (place & 7) - (kk + 1))
    byte = place >> 3
    size_ = len(out)
    out += np.bincount(byte, weights=word >> 8, minlength=size_)[:size_]
    out += np.bincount(byte + 1, weights=word & 0xFF, minlength=size_)[:size_]
    return out[: int(begin[-1])].astype(np.uint8), length


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload of at least one byte."""
    out: list[bytes] = []
    s = 0
    while s < len(payloads):
        e, total = s, 0
        while e < len(payloads) and (e == s or total + len(payloads[e]) <= BATCH):
            total += len(payloads[e])
            e += 1
        out.extend(_encode(payloads[s:e]))
        s = e
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    samples = (np.frombuffer(b"".join(payloads), dtype=np.uint8) ^ np.uint8(0x80)).view(np.int8)
    sizes, owner, heads = [], [], []
    for i, p in enumerate(payloads):
        for number, a in enumerate(range(0, len(p), BLOCK)):
            n = min(BLOCK, len(p) - a)
            sizes.append(n)
            owner.append(i)
            heads.append(_header(number, n))
    size = np.array(sizes, dtype=np.int64)
    first = np.cumsum(size) - size
    parts = [[] for _ in range(3)]
    for lo in range(0, len(size), WRITE):
        hi = min(lo + WRITE, len(size))
        a, b = int(first[lo]), int(first[hi - 1] + size[hi - 1])
        body, length = _bodies(samples[a:b], first[lo:hi] - a, size[lo:hi])
        parts[0].append(body)
        parts[1].append(length)
    body, length = np.concatenate(parts[0]).tobytes(), np.concatenate(parts[1])
    end = np.cumsum(length)
    frames = [h + body[e - n : e] for h, e, n in zip(heads, end.tolist(), length.tolist(), strict=True)]
    whole = np.frombuffer(b"".join(frames), dtype=np.uint8)
    flen = np.array([len(f) for f in frames], dtype=np.int64)
    sums = crc16(whole, np.cumsum(flen) - flen, flen).tolist()
    by: list[list[bytes]] = [[] for _ in payloads]
    for o, f, c in zip(owner, frames, sums, strict=True):
        by[o].append(f + c.to_bytes(2, "big"))
    raw = samples.tobytes()
    out, at = [], 0
    for p, fs in zip(payloads, by, strict=True):
        out.append(_stream(raw[at : at + len(p)], fs))
        at += len(p)
    return out


def _stream(samples: bytes, frames: list[bytes]) -> bytes:
    lengths = [len(f) for f in frames]
    size = min(len(samples), BLOCK)
    packed = (44100 << 44) | (0 << 41) | (7 << 36) | len(samples)
    info = size.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
    points, offset = [], 0
    for i, n in enumerate(lengths):
        points.append((i * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(samples) - i * BLOCK).to_bytes(2, "big"))
        offset += n
    blocks = [b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info]
    #: A metadata block has 24 bits for its length; longer tables go into several.
    per = (1 << 24) // 18 - 1
    tables = [points[i : i + per] for i in range(0, len(points), per)]
    for i, t in enumerate(tables):
        blocks += [bytes([3 | 0x80 * (i == len(tables) - 1)]), (18 * len(t)).to_bytes(3, "big"), *t]
    return b"".join(blocks + frames)


@dataclass
class _Frame:
    owner: int
    sample: int
    start: int
    body: int
    end: int
    size: int


def _read_header(data: bytes, at: int, where: int) -> tuple[int, int, int]:
    """(place after the header, block size, frame number) of the frame at `at`."""
    if data[at : at + 2] != b"\xff\xf8" or len(data) < at + 6:
        raise FlacError(f"no frame at {where}")
    code, rate, channel, bits = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, (data[at + 3] >> 1) & 7
    if channel or bits not in (0, 1) or rate > 11:
        raise FlacError("only one channel of 8-bit samples is read")
    p = at + 5
    number = data[at + 4]
    if number >= 0x80:
        more = 0
        while number & (0x40 >> more):
            more += 1
        number &= 0x3F >> more
        for _ in range(more):
            number = (number << 6) | (data[p] & 0x3F)
            p += 1
    if code == 6:
        size, p = data[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif code in _SIZES:
        size = _SIZES[code]
    else:
        raise FlacError("reserved block size")
    if crc8(data[at:p]) != data[p]:
        raise FlacError(f"the header at {where} fails its CRC-8")
    return p + 1, size, number


def _metadata(data: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """(place of the first frame, samples, MD5, seek points)."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + n]
        if kind == 0:
            info = block
        elif kind == 3:
            for i in range(0, n, 18):
                sample = int.from_bytes(block[i : i + 8], "big")
                if sample != (1 << 64) - 1:
                    points.append((sample, int.from_bytes(block[i + 8 : i + 16], "big")))
        at += 4 + n
    if info is None:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    return at, packed & ((1 << 36) - 1), info[18:34], points


class _Bits:
    """Reads of up to 48 bits at any places of `data`."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        self._words = np.zeros(len(data) + 8, dtype=np.uint64)
        for i in range(8):
            self._words = (self._words << np.uint64(8)) | padded[i : i + len(self._words)]

    def window(self, place: np.ndarray) -> np.ndarray:
        """64 bits from each place, of which at least 57 are there."""
        return self._words[np.minimum(place >> 3, len(self._words) - 1)] << (place & 7).astype(np.uint64)

    def read(self, place: np.ndarray, n: int) -> np.ndarray:
        return (self.window(place) >> np.uint64(64 - n)).astype(np.int64)


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def _subframes(data: np.ndarray, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, a row for each frame; place of the first byte after each subframe)."""
    bits = _Bits(data)
    lanes = len(size)
    out = np.zeros((int(size.max()), lanes), dtype=np.int32)  # a column for each frame: a step writes one row
    at = 8 * body.astype(np.int64)
    head = bits.read(at, 8)
    if (head & 0x81).any():
        raise FlacError("bad subframe header")
    kind = head >> 1
    at = at + 8
    for lane in np.flatnonzero(kind == 0):
        out[: size[lane], lane] = _signed(bits.read(at[lane : lane + 1], 8), 8)[0]
        at[lane] += 8
    for lane in np.flatnonzero(kind == 1):
        a = int(at[lane]) >> 3
        out[: size[lane], lane] = data[a : a + size[lane]].view(np.int8)
        at[lane] += 8 * size[lane]
    predicted = np.flatnonzero(kind >= 8)
    if len(predicted):
        order = np.where(kind[predicted] >= 32, kind[predicted] - 31, kind[predicted] - 8)
        if ((kind[predicted] < 32) & (order > 4)).any():
            raise FlacError("reserved subframe type")
        # Longest first: the frames that still have samples are a leading slice.
        by = np.argsort(-size[predicted], kind="stable")
        at[predicted[by]] = _predicted(bits, at[predicted[by]], size[predicted[by]], kind[predicted[by]] >= 32, order[by], out, predicted[by])
    return out.T, (at + 7) // 8


def _predicted(bits: _Bits, at: np.ndarray, size: np.ndarray, linear: np.ndarray, order: np.ndarray, out: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Fills the columns `lanes` of `out`; gives the places after the residuals."""
    res = np.zeros((out.shape[0], len(lanes)), dtype=np.int32)
    for i in range(int(order.max())):
        has = np.flatnonzero(order > i)
        res[i, has] = _signed(bits.read(at[has], 8), 8)
        at[has] += 8
    shift = np.zeros(len(lanes), dtype=np.int64)
    factors = np.zeros((32, len(lanes)), dtype=np.int64)
    for lane in np.flatnonzero(linear).tolist():
        spot = at[lane : lane + 1]
        precision = int(bits.read(spot, 4)[0]) + 1
        shift[lane] = int(bits.read(spot + 4, 5)[0])
        if precision == 16 or shift[lane] > 15:
            raise FlacError("bad predictor")
        for i in range(int(order[lane])):
            factors[i, lane] = _signed(bits.read(spot + 9 + i * precision, precision), precision)[0]
        at[lane] += 9 + int(order[lane]) * precision
    method = bits.read(at, 2)
    if (method > 1).any():
        raise FlacError("reserved residual method")
    width = (4 + method).astype(np.uint64)
    split = bits.read(at + 2, 4)
    at += 6
    part = size >> split
    left = np.zeros(len(lanes), dtype=np.int64)  # samples until the next partition
    opened = np.zeros(len(lanes), dtype=bool)
    k = np.zeros(len(lanes), dtype=np.int64)
    plain = np.zeros(len(lanes), dtype=np.int64) - 1  # bits of an escaped partition, else -1
    most = int(size.max())
    live_at = np.searchsorted(-size, -np.arange(1, most + 1), side="right").tolist()
    warm = int(order.max())
    simple = not split.any() and warm <= 1
    for i in range(most):
        n = live_at[i]
        live = slice(0, n)
        if not simple or i <= warm:
            turn = np.flatnonzero((left[live] == 0) & (i >= order[live]))
            if len(turn):
                w = width[turn]
                k[turn] = (bits.window(at[turn]) >> (np.uint64(64) - w)).astype(np.int64)
                at[turn] += w.astype(np.int64)
                left[turn] = np.where(opened[turn], part[turn], part[turn] - order[turn])
                opened[turn] = True
                escape = turn[k[turn] == (1 << w.astype(np.int64)) - 1]
                plain[turn] = -1
                if len(escape):
                    plain[escape] = bits.read(at[escape], 5)
                    at[escape] += 5
        on = np.flatnonzero((i >= order[live]) & (plain[live] < 0)) if i < warm or (plain[live] >= 0).any() else None
        if i >= warm or not simple:
            raw = np.flatnonzero((plain[live] >= 0) & (i >= order[live]))
            for b in np.unique(plain[raw]).tolist() if len(raw) else []:
                these = raw[plain[raw] == b]
                if b:
                    res[i, these] = _signed(bits.read(at[these], b), b)
                    at[these] += b
                left[these] -= 1
        p = at[live] if on is None else at[on]
        kk = k[live] if on is None else k[on]
        if not len(p):
            continue
        win = bits.window(p)
        zeros = _ZEROS[(win >> np.uint64(48)).astype(np.int64)]
        if (zeros == 16).any():
            zeros = zeros.copy()
            far = np.flatnonzero(zeros == 16)
            while len(far):
                z = _ZEROS[(bits.window(p[far] + zeros[far]) >> np.uint64(48)).astype(np.int64)]
                zeros[far] += z
                far = far[z == 16]
                if len(far) and int(zeros[far].max()) > 1 << 24:
                    raise FlacError("residual without end")
            win = bits.window(p + zeros)
            low = (win << np.uint64(1)) >> np.uint64(1)
            rest = (low >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
        else:
            rest = ((win << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
        v = (zeros << kk) | rest
        value = (v >> 1) ^ -(v & 1)
        p = p + zeros + 1 + kk
        if on is None:
            res[i, live] = value
            at[live] = p
            left[live] -= 1
        else:
            res[i, on] = value
            at[on] = p
            left[on] -= 1
    _restore(res, size, linear, order, shift, factors)
    out[: res.shape[0], lanes] = res
    return at


def _restore(res: np.ndarray, size: np.ndarray, linear: np.ndarray, order: np.ndarray, shift: np.ndarray, factors: np.ndarray) -> None:
    """Turns residuals into samples, in place."""
    for o in range(1, 5):
        lanes = np.flatnonzero(~linear & (order == o))
        if not len(lanes):
            continue
        x = res[:, lanes].astype(np.int64)
        lead = [x[:o].copy()]  # the warm-up samples and their differences, order by order
        for _ in range(o - 1):
            lead.append(np.diff(lead[-1], axis=0))
        # The residual is the difference of order o; each running sum, started there, gives the next lower order.
        for d in range(o - 1, -1, -1):
            x[o - 1] = lead[d][-1]
            x[o - 1 :] = np.cumsum(x[o - 1 :], axis=0)
        x[:o] = lead[0]
        res[:, lanes] = x
    lanes = np.flatnonzero(linear)
    if len(lanes):
        # Samples of 8 bits by at most 32 factors of 15 bits stay within 32 bits.
        x, own, least, by = res[:, lanes], factors[:, lanes].astype(np.int32), order[lanes], shift[lanes].astype(np.int32)
        top, alike = int(least.max()), int(least.min())
        for i in range(alike, int(size[lanes].max())):
            guess = own[0] * x[i - 1]
            for j in range(1, min(top, i)):
                guess += own[j] * x[i - 1 - j]
            guess >>= by
            x[i] += guess if i >= top else np.where(i >= least, guess, 0)
        res[:, lanes] = x


def decode_many(files: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Of each file, its blocks: (offset of the first sample, samples as unsigned bytes)."""
    out: list[list[tuple[int, bytes]]] = []
    s = 0
    while s < len(files):
        e, total = s, 0
        while e < len(files) and (e == s or total + len(files[e]) <= BATCH):
            total += len(files[e])
            e += 1
        out.extend(_decode(files[s:e]))
        s = e
    return out


def _decode(files: list[bytes]) -> list[list[tuple[int, bytes]]]:
    frames: list[_Frame] = []
    slow: list[int] = []
    infos, at = [], 0
    for o, f in enumerate(files):
        begin, samples, md5, points = _metadata(f)
        infos.append((samples, md5))
        ends = [*(begin + p for _, p in points[1:]), len(f)][: len(points)]
        own = []
        for (sample, offset), end in zip(points, ends, strict=True):
            body, size, _ = _read_header(f, begin + offset, begin + offset)
            own.append(_Frame(o, sample, at + begin + offset, at + body, at + end, size))
        if points and points[0] == (0, 0) and all(a.sample + a.size == b.sample for a, b in zip(own, own[1:], strict=False)) and own[-1].sample + own[-1].size == samples:
            frames += own
        elif samples:
            slow.append(o)
        at += len(f)
    data = np.frombuffer(b"".join(files), dtype=np.uint8)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in files]
    for lo in range(0, len(frames), READ):
        part = frames[lo : lo + READ]
        base, b = part[0].start, part[-1].end
        body = np.array([f.body for f in part], dtype=np.int64) - base
        size = np.array([f.size for f in part], dtype=np.int64)
        samples, end = _subframes(data[base:b], body, size)
        start = np.array([f.start for f in part], dtype=np.int64)
        if (end + 2 != np.array([f.end for f in part]) - base).any():
            raise FlacError("a frame doesn't end at the next seek point")
        _check(data, start, base + end)
        pcm = (samples.astype(np.int8).view(np.uint8)) ^ np.uint8(0x80)
        for i, f in enumerate(part):
            blocks[f.owner].append((f.sample, pcm[i, : f.size].tobytes()))
    for o in slow:
        blocks[o] = _one_by_one(files[o], infos[o][0])
    for found, (n, md5) in zip(blocks, infos, strict=True):
        pcm = b"".join(b for _, b in found)
        signed = (np.frombuffer(pcm, dtype=np.uint8) ^ np.uint8(0x80)).tobytes()
        if len(pcm) != n or (any(md5) and hashlib.md5(signed).digest() != md5):
            raise FlacError("the samples fail their MD5")
    return blocks


def _check(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    sums = crc16(data, start, end - start)
    if (sums != (data[end].astype(np.uint16) << np.uint16(8)) + data[end + 1]).any():
        raise FlacError("a frame fails its CRC-16")


def _one_by_one(f: bytes, samples: int) -> list[tuple[int, bytes]]:
    """The blocks of a file whose seek points don't name all frames."""
    at, seen, out = _metadata(f)[0], 0, []
    data = np.frombuffer(f, dtype=np.uint8)
    while seen < samples:
        body, size, _ = _read_header(f, at, at)
        got, end = _subframes(data[body:], np.array([0]), np.array([size]))
        end = body + end
        _check(data, np.array([at]), end)
        out.append((seen, ((got[0, :size].astype(np.int8).view(np.uint8)) ^ np.uint8(0x80)).tobytes()))
        seen, at = seen + size, int(end[0]) + 2
    return out


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up with 255 to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the FLAC file of each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, s = b.column(text).cast(pa.binary()), 0
            while s < b.num_rows:
                raw: list[bytes] = []
                total = 0
                while s + len(raw) < b.num_rows and total < BATCH:
                    raw.append(texts[s + len(raw)].as_py() or b"")
                    total += len(raw[-1])
                files = encode_many([payload(r) for r in raw])
                yield pa.RecordBatch.from_arrays([b.column(key).slice(s, len(raw)), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])
                s += len(raw)

    return docs.select(key, text).mapInArrow(encode, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., sample_offset, samples, pcm): the blocks of each file in a row; offsets of a file begin at 0."""
    kept = [key, *carry]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, s = b.column(column), 0
            while s < b.num_rows:
                e, total = s, 0
                while e < b.num_rows and (e == s or total + len(files[e].as_buffer()) <= BATCH):
                    total += len(files[e].as_buffer())
                    e += 1
                rows = [(i, at, len(pcm), pcm) for i, blocks in enumerate(decode_many(files[s:e].to_pylist()), s) for at, pcm in blocks]
                own, at, n, pcm = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
                taken = [b.column(c).take(pa.array(own, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(pcm, pa.binary())], names=[*kept, "sample_offset", "samples", "pcm"])
                s = e

    kinds = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in kept)
    return media.select(*kept, column).mapInArrow(decode, f"{kinds}, sample_offset long, samples long, pcm binary")


class _Digest:
    """What is told of a payload, block by block."""

    def __init__(self) -> None:
        self.size, self.sum, self.energy, self.crossings = 0, 0, 0, 0
        self.sha, self.tail, self.negative = hashlib.sha256(), b"", None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
        below = x < 0
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.negative is not None and bool(below[0]) != self.negative)
        self.negative = bool(below[-1])
        self.size, self.sum, self.energy = self.size + len(x), self.sum + int(x.sum()), self.energy + int((x * x).sum())
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-32:])[-32:]

    def row(self) -> tuple[int, str, int, str]:
        """Bytes, SHA-256, CRC-32 of the last 32, and samples:sum:energy:crossings about the middle of the samples."""
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), f"{self.size}:{self.sum}:{self.energy}:{self.crossings}"


def digests(blocks: DataFrame, kept: Sequence[str]) -> DataFrame:
    """(kept..., payload_bytes, payload_sha256, tail_crc32, feature) of each file, from its blocks in a row as `pcm_blocks` gives them."""
    names = [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.Array] | None = None
        digest = _Digest()
        for b in batches:
            done, rows = [], []
            for i, (at, pcm) in enumerate(zip(b.column("sample_offset").to_pylist(), b.column("pcm"), strict=True)):
                if at == 0:
                    if own is not None:
                        done.append(own)
                        rows.append(digest.row())
                    own, digest = [b.column(c).slice(i, 1) for c in kept], _Digest()
                digest.add(pcm.as_py())
            yield record(done, rows, b)
        if own is not None:
            yield record([own], [digest.row()], b)

    def record(own: list[list[pa.Array]], rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        taken = [pa.concat_arrays([o[j] for o in own]) if own else like.column(c).slice(0, 0) for j, c in enumerate(kept)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))], names=names)

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in kept)
    return blocks.mapInArrow(fold, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is told of each file of `stored`, and of the blocks read from it."""
    kept = [key, "n_bytes", "media_bytes", "media_sha256"]
    told = media.select(key, "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return digests(pcm_blocks(told, key, carry=kept[1:]), kept)
