"""Folds of ordered logs whose next step depends on the last one's result.

Windows can't express these, so each log is folded by one Python function over Arrow batches. A fold
reads its rows in order, a batch at a time, and keeps only its own state; Spark sorts the rows before it.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Row = tuple
Fold = Callable[[Iterator], Iterator[Row]]
HOUR = 3_600_000_000
#: Rows of a batch that a fold sends.
BATCH = 10_000


def fold(rows: DataFrame, by: Sequence[str], order: Sequence[str], step: Fold, schema: str) -> DataFrame:
    """`step` over the rows of each key, in order; it yields rows of `schema` without the key.

    Rows are sorted by Spark, which spills, and read batch by batch: a task holds a batch and the state of one fold.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Row]:
            for b in batches:
                record = namedtuple("Record", b.schema.names)
                yield from map(record, *(c.to_pylist() for c in b.columns))

        out: list[Row] = []
        for key, group in groupby(records(), key=lambda r: r[:keys]):
            for r in step(group):
                out.append((*key, *r))
                if len(out) >= BATCH:
                    yield batch(out)
                    out = []
            for _ in group:  # a step may stop early
                pass
        yield batch(out)

    def batch(out: list[Row]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, kinds, strict=True)], names=names)

    rest = [c for c in rows.columns if c not in by]
    sorted_ = rows.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *order)
    return sorted_.mapInArrow(run, schema)


def split_arcs(arcs: DataFrame, lo: str, hi: str) -> DataFrame:
    """Arcs within [-pi, pi]; what reaches beyond one end goes on at the other."""
    l, h, pi, turn = F.col(lo), F.col(hi), F.lit(math.pi), F.lit(2 * math.pi)
    part = lambda a, b: F.struct(a.alias(lo), b.alias(hi))
    parts = F.array(part(F.greatest(l, -pi), F.least(h, pi)), F.when(l < -pi, part(l + turn, pi)), F.when(h > pi, part(-pi, h - turn)))
    rest = [c for c in arcs.columns if c not in (lo, hi)]
    return arcs.select(*rest, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select(*rest, f"p.{lo}", f"p.{hi}")


def _gaps(forbidden: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """Disjoint arcs with the end of the one before (_before), the start of the one after (_after), around the circle."""
    w, whole, turn = Window.partitionBy(by).orderBy(lo), Window.partitionBy(by), F.lit(2 * math.pi)
    seen = forbidden.withColumn("_place", F.row_number().over(w)).withColumn("_of", F.count("*").over(whole))
    before = F.coalesce(F.lag(hi).over(w), F.max(hi).over(whole) - turn)
    return seen.withColumn("_before", before).withColumn("_after", F.coalesce(F.lead(lo).over(w), F.min(lo).over(whole) + turn))


def allowed_arcs(forbidden: DataFrame, by: str, lo: str, hi: str, cushion: str) -> DataFrame:
    """Arcs between disjoint forbidden ones, less `cushion` at both ends; what is left of none goes.

    An arc across the end of the circle is listed at both ends, beyond -pi and beyond pi.
    """
    l, h, pi = F.col(lo), F.col(hi), math.pi
    part = lambda a, b: F.struct((a + F.col(cushion)).alias(lo), (b - F.col(cushion)).alias(hi))
    first = F.when((F.col("_place") > 1) | (l > -pi), part(F.col("_before"), l))
    last = F.when((F.col("_place") == F.col("_of")) & (h < pi), part(h, F.col("_after")))
    parts = _gaps(forbidden, by, lo, hi).select(by, F.explode(F.array_compact(F.array(first, last))).alias("p"))
    return parts.select(by, f"p.{lo}", f"p.{hi}").where(F.col(lo) < F.col(hi))


def next_allowed(directions: DataFrame, forbidden: DataFrame, by: str, angle: str, lo: str, hi: str) -> DataFrame:
    """`directions`, from -pi to pi, with the bounds of the allowed arc that holds each, or else of the next one with growing angles
    (ccw) and with falling ones (cw).

    The circle is unrolled three times, so that arcs across its end are whole and every direction has neighbours on both
    sides; an arc that is found a turn away is named where it meets the circle. Where nothing is forbidden the whole circle is allowed, where
    all is, none.
    """
    from chronofold.operators.temporal import as_of, interval_union

    pi, turn = F.lit(math.pi), F.lit(2 * math.pi)
    turns = F.explode(F.array(*(F.lit(float(i)) for i in (-1, 0, 1)))).alias("_turn")
    unrolled = forbidden.select(by, lo, hi, turns).select(by, (F.col(lo) + F.col("_turn") * turn).alias(lo), (F.col(hi) + F.col("_turn") * turn).alias(hi))
    line = Window.partitionBy(by).orderBy(lo)
    arcs = interval_union(unrolled, [by], lo, hi).select(by, F.col(lo).alias(angle), F.struct(F.col(hi).alias("end"), F.lag(hi).over(line).alias("before"), F.col(lo).alias("start"), F.lead(lo).over(line).alias("after")).alias("_arc"))
    found = as_of(directions, arcs, [by], angle, ["_arc"])
    arc = F.col("_arc")
    inside = F.col(angle) <= arc["end"]

    def gap(a: Column, b: Column) -> Column:
        shift = F.when(a >= pi, -turn).when(b <= -pi, turn).otherwise(F.lit(0.0))
        free = F.when(a.isNotNull() & b.isNotNull(), F.struct((a + shift).alias(lo), (b + shift).alias(hi)))
        return F.when(arc.isNull(), F.struct((-pi).alias(lo), pi.alias(hi))).otherwise(free)

    ahead = gap(arc["end"], arc["after"])
    behind = F.when(inside, gap(arc["before"], arc["start"])).otherwise(ahead)
    return found.select(*directions.columns, ahead.alias("ccw"), behind.alias("cw"))


def moving_average(rows: Iterator) -> Iterator[Row]:
    """A mean that moves towards each value by the share of a day that has passed, a whole one at most."""
    mean = last = None
    for r in rows:
        if mean is None:
            mean = r.value
        else:
            mean += (r.value - mean) * min(1.0, (r.us - last) / (24 * HOUR))
        last = r.us
        yield r.event_id, round(mean, 6)


def changes_beyond(rows: Iterator, tolerance: float = 20.0) -> Iterator[Row]:
    """Values that differ by more than a tolerance from the last one that was passed on."""
    sent = None
    for r in rows:
        if sent is None or abs(r.value - sent) > tolerance:
            sent = r.value
            yield r.event_id, r.value


def distinct_names(rows: Iterator) -> Iterator[Row]:
    """Names made unique: the second `a` becomes `a1` unless that is taken, and so on."""
    used: set[str] = set()
    following: dict[str, int] = {}
    for r in rows:
        name = r.name
        if name in used:
            n = following.get(name, 1)
            while f"{name}{n}" in used:
                n += 1
            following[name] = n + 1
            name = f"{name}{n}"
        used.add(name)
        yield r.p_partkey, name


def match_requests(rows: Iterator) -> Iterator[Row]:
    """Clicks ask, purchases answer by sequence k % 8; errors reject by sequence, or for sequence 0 the newest of the same k."""
    open_: list = []
    for r in rows:
        if r.event_type == "click":
            open_.append(r)
        elif r.event_type in ("purchase", "error"):
            seq = r.k % 8
            hit = next((q for q in reversed(open_) if q.k % 8 == seq), None) if seq or r.event_type == "purchase" else next((q for q in reversed(open_) if q.k == r.k), None)
            if hit is not None:
                open_.remove(hit)
                yield hit.event_id, r.event_id, "confirmed" if r.event_type == "purchase" else "rejected"
    for q in open_:
        yield q.event_id, None, "open"


def check_protocol(rows: Iterator) -> Iterator[Row]:
    """Warnings about requests that are answered twice, out of order or not at all."""
    queue: list = []
    answered: set[int] = set()
    for r in rows:
        if r.event_type == "click":
            if any(q.k == r.k for q in queue):
                yield r.event_id, "repeated request"
            queue.append(r)
        elif r.event_type == "purchase":
            at = next((i for i, q in enumerate(queue) if q.k % 16 == r.k % 16), None)
            if at is None:
                yield r.event_id, "answered twice" if r.k % 16 in answered else "unexpected answer"
                continue
            if at:
                yield r.event_id, f"overtakes {at}"
            answered.add(queue.pop(at).k % 16)
    for q in queue:
        yield q.event_id, "never answered"


def audit_requests(rows: Iterator, late_us: int = 48 * HOUR) -> Iterator[Row]:
    """What is odd about requests, their answers and rejections, and the casts between them.

    Rows have kind (ask, answer, reject, start, stop or reset), seq and action; a rejection without seq is found by
    its action, the end of a cast by what was cast. Whatever settles a request settles those before it as well, and
    all of them where it fits none. A request also settles the first one where that one's cast goes on.
    """
    queue: list = []
    casting = None
    for r in rows:
        odd: list[str] = []
        if r.kind in ("answer", "reject") or r.kind == "stop" and casting is not None:
            if r.kind == "stop":
                fits = [q.action == casting for q in queue]
            else:
                fits = [q.seq == r.seq if r.seq else q.action == r.action for q in queue]
            n = fits.index(True) if True in fits else None
            if n is None:
                odd.append(f"{r.kind} of none")
            elif n:
                odd.append(f"{r.kind} out of order")
            elif r.kind == "reject":
                odd.append("reject" if (queue[0].seq, queue[0].action) == (r.seq, r.action) else "reject of another")
            elif r.kind == "answer" and queue[0].action != r.action:
                odd.append("answer to another")
            elif r.kind == "answer" and r.us - queue[0].us >= late_us:
                odd.append("answer too late")
            del queue[: len(queue) if n is None else n + 1]
            casting = None
        elif r.kind == "ask":
            if queue and queue[0].action == casting:
                del queue[0]
                casting = None
            if queue:
                odd.append(f"ask while {len(queue)} wait")
            queue.append(r)
        elif r.kind == "start":
            if not queue:
                odd.append("start of none")
            elif queue[0].action != r.action:
                odd.append("start of another")
            if casting is not None:
                odd.append("start during a cast")
            casting = r.action
        elif r.kind == "reset":
            queue, casting = [], None
        if odd:
            yield r.event_id, ", ".join(odd)


def simulate_charges(rows: Iterator, charges: int = 3, recharge_us: int = 8 * HOUR) -> Iterator[Row]:
    """Charges left after each use; a use without one counts as a deficit of the time that was missing."""
    left, last = float(charges), None
    for r in rows:
        if last is not None:
            left = min(float(charges), left + (r.us - last) / recharge_us)
        last = r.us
        deficit = max(0.0, 1 - left) * recharge_us / 1e6
        left = max(0.0, left - 1)
        yield r.event_id, round(left, 6), round(deficit, 3)


#: (state, event) -> next state, and the hours after which a state ends by itself.
MACHINE = {("idle", "signup"): "ready", ("ready", "click"): "busy", ("busy", "purchase"): "done", ("busy", "error"): "failed", ("ready", "error"): "failed"}
TIMEOUTS = {"busy": (48, "ready"), "done": (24, "idle"), "failed": (12, "idle")}


def run_machine(rows: Iterator) -> Iterator[Row]:
    """Transitions by event or by timeout; several may fall between two events."""
    state, since = "idle", None
    for r in rows:
        while since is not None and state in TIMEOUTS and r.us >= since + TIMEOUTS[state][0] * HOUR:
            hours, following = TIMEOUTS[state]
            since += hours * HOUR
            yield since, state, following, "timeout"
            state = following
        following = MACHINE.get((state, r.event_type))
        if following is not None:
            yield r.us, state, following, r.event_type
            state, since = following, r.us


def nested(rows: Iterator) -> Iterator[Row]:
    """(entry, place, wait, ready) of the rows that are over by the bound, which each of them that waits brings forward to its own start."""
    bound = math.inf
    for place, r in enumerate(rows):
        if r.delay + r.duration <= bound:
            yield r.entry, place, r.delay, r.usable
            bound = min(bound, r.delay if r.waits else math.inf)


def pick_in_time(entries: DataFrame, queue: str, order: list[str], at_once: float = 0.05) -> DataFrame:
    """(queue, entry, start_s): what each queue starts next, and in how many seconds.

    entries: `entry`, `priority`, `delay` until it can start, `duration`, `cast` and the `longest` allowed, and whether it is `usable`, in the given
    order of preference. Negative priorities and casts that are too long don't count. Whatever waits sets a bound to what is
    less preferred. Of the rest the first usable one that can start at once is taken; if there is none, the last one that waits, if it is usable.
    """
    counted = entries.where("priority >= 0 and cast <= longest").withColumn("waits", F.col("delay") > at_once)
    types = {c: entries.schema[c].dataType.simpleString() for c in (queue, "entry")}
    fit = fold(counted, [queue], order, nested, f"{queue} {types[queue]}, entry {types['entry']}, place long, wait double, ready boolean")
    now, row = F.col("wait") <= at_once, F.struct("entry", "wait", "ready")
    best = fit.groupBy(queue).agg(F.min_by(F.when(now & F.col("ready"), row), F.when(now & F.col("ready"), F.col("place"))).alias("first"), F.max_by(F.when(~now, row), F.when(~now, F.col("place"))).alias("last"))
    chosen = best.select(queue, F.coalesce("first", "last").alias("best")).where("best.ready")
    return chosen.select(queue, "best.entry", F.greatest(F.lit(0.0), F.col("best.wait")).alias("start_s"))


def sessions(rows: Iterator) -> Iterator[Row]:
    """Sessions from a signup to the next error or the end; clicks are phases, members are the k seen meanwhile."""
    number, start, last, phases, members = 0, None, None, 0, set()
    for r in rows:
        if start is None and r.event_type == "signup":
            number, start, phases, members = number + 1, r.us, 0, set()
        if start is not None:
            last = r.us
            members.add(r.k)
            phases += r.event_type == "click"
            if r.event_type == "error":
                yield number, start, r.us, phases, len(members)
                start = None
    if start is not None:
        yield number, start, last, phases, len(members)


def thinned_hull(rows: Iterator, apart: float = 0.1) -> Iterator[Row]:
    """Convex hull of the points that are no nearer than `apart` to one kept before, anticlockwise."""
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    kept: list[tuple[float, float]] = []
    for r in rows:
        cx, cz = math.floor(r.x / apart), math.floor(r.z / apart)
        near = (q for i in (-1, 0, 1) for j in (-1, 0, 1) for q in cells.get((cx + i, cz + j), ()))
        if all(math.dist(q, (r.x, r.z)) >= apart for q in near):
            cells.setdefault((cx, cz), []).append((r.x, r.z))
            kept.append((r.x, r.z))
    kept = sorted(set(kept))

    def half(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = kept if len(kept) < 3 else half(kept)[:-1] + half(kept[::-1])[:-1]
    for i, (x, z) in enumerate(ring):
        yield i, round(x, 6), round(z, 6)
