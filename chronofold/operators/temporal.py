"""Temporal joins and interval operators over ordered logs.

Times are any orderable columns. Intervals are closed at both ends unless said otherwise. As-of joins
are a union and one window over the key, never an inequality join; interval joins match buckets of
time by equality and check the bounds afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seq: str | None = None, direction: str = "backward", strict: bool = False) -> DataFrame:
    """All rows of `left` with `values` of the nearest row of `right`, NULL where there is none.

    backward: the last with key <= t, or < t if strict; forward: the first with key >= t, or > t.
    Ties in `right` go to the last (forward: the first) by `seq`. `values` must not name columns of `left`.
    """
    backward = direction == "backward"
    left_last = backward != strict  # at equal times a left row sees right rows that sort before it
    right_side = F.lit(0 if left_last else 1)
    own = [c for c in left.columns if c not in by and c != ts]
    keys = [*by, ts]
    r = right.select(*keys, right_side.alias("_side"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("_seq"), F.struct(*values).alias("_r"))
    l = left.select(*keys, F.lit(1 if left_last else 0).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*(own or [ts])).alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_side", "_seq")
    if backward:
        hit = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        hit = F.first("_r", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn("_hit", hit).where(F.col("_l").isNotNull()).select(*keys, *(F.col("_l")[c].alias(c) for c in own), *(F.col("_hit")[c].alias(c) for c in values))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points and the intervals that hold them. Times are longs; `bucket` is about an interval's length.

    how: inner, left_semi or left_anti. A bucket holds what starts near it, so a long interval is in
    many; choose the bucket so that these are few.
    """
    cut = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(cut(F.col(start)), cut(F.col(end))))).select(*(F.col(c).alias(f"_i_{c}") for c in by), "_bucket", *(c for c in intervals.columns if c not in by))
    p = points.withColumn("_bucket", cut(F.col(ts)))
    on = p["_bucket"] == i["_bucket"]
    for c in by:
        on = on & (p[c] == i[f"_i_{c}"])
    on = on & p[ts].between(i[start], i[end])
    out = p.join(i, on, how).drop(p["_bucket"])
    return out if how != "inner" else out.drop(i["_bucket"], *(f"_i_{c}" for c in by))


def first_containing(points: DataFrame, intervals: DataFrame, by: Sequence[str], key: str, ts: str, start: str, end: str, order: Sequence[str], bucket: int) -> DataFrame:
    """Each point with the first interval, by `order`, that holds it; points in none are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return interval_join(points, intervals, by, ts, start, end, bucket).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest_interval(points: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str, start: str, end: str, values: Sequence[str], seq: str | None = None) -> DataFrame:
    """Each point with the nearest of disjoint intervals; distance 0 inside, ties to the earlier one."""
    i = intervals.select(*by, F.col(start).alias(ts), *([seq] if seq and seq not in values else []), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *values).alias("_v"))
    before = as_of(points, i.withColumnRenamed("_v", "_before"), by, ts, ["_before"], seq)
    both = as_of(before, i.withColumnRenamed("_v", "_after"), by, ts, ["_after"], seq, direction="forward", strict=True)
    # greatest() passes over NULL, so a missing side has no distance of its own.
    gap = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0).cast("long"), v["s"] - F.col(ts), F.col(ts) - v["e"]))
    a, b = gap(F.col("_before")), gap(F.col("_after"))
    pick = F.when(F.col("_before").isNull() | (b < a), F.col("_after")).otherwise(F.col("_before"))
    return both.withColumn("_v", pick).withColumn("distance", gap(F.col("_v"))).select(*points.columns, *(F.col("_v")[v].alias(v) for v in values), "distance")


def band_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, key: str, other_ts: str, order: Sequence[str], width: int) -> DataFrame:
    """Each left row with the first right row, by `order`, less than `width` away. Right columns must be named apart."""
    cut = lambda c, d=0: F.floor((c + d) / F.lit(width)).cast("long")
    r = right.withColumn("_b", F.explode(F.array(*(F.floor(F.col(other_ts) / F.lit(width)).cast("long") + d for d in (-1, 0, 1)))))
    hits = left.withColumn("_b", cut(F.col(ts))).join(r, [*by, "_b"]).where(F.abs(F.col(ts) - F.col(other_ts)) < width)
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "_b")


def slot_intervals(writes: DataFrame, slot: Sequence[str], ts: str, seq: str, log_end: Column, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """An interval for each write to a slot, closed by the next write there or by the end of the log.

    A refresh with the same value closes and opens as well, so it splits the interval.
    """
    w = Window.partitionBy(*slot).orderBy(ts, seq)
    return writes.withColumn(start, F.col(ts)).withColumn(end, F.coalesce(F.lead(ts).over(w), log_end))


def closed_by(intervals: DataFrame, destroys: DataFrame, by: Sequence[str], start: str, end: str, destroyed: str) -> DataFrame:
    """Intervals cut at the first destruction of their entity at or after their start."""
    d = destroys.select(*by, F.col(destroyed).alias(start), F.col(destroyed).alias("_gone"))
    return as_of(intervals, d, by, start, ["_gone"], direction="forward").withColumn(end, F.least(F.col(end), F.col("_gone"))).drop("_gone")


def interval_union(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals that cover the same times; touching ones are merged."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(*by, start, end).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def run_length(rows: DataFrame, by: Sequence[str], value: str, ts: str, seq: str) -> DataFrame:
    """Runs of equal values: (by, value, start, end, n); a run ends where the next begins, the last at its last row."""
    w = Window.partitionBy(*by).orderBy(ts, seq)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(seq).over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("_new", changed).withColumn("_next", F.lead(ts).over(w))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_run", value).agg(F.min(ts).alias("start_us"), F.max(F.coalesce("_next", ts)).alias("end_us"), F.count("*").alias("n")).drop("_run")


def state_at(rows: DataFrame, by: Sequence[str], ts: str, seq: str, at: Column, values: Sequence[str]) -> DataFrame:
    """The last values written up to `at`, by key; one aggregation, with partial results before the shuffle."""
    return rows.where(F.col(ts) <= at).groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(ts, seq)).alias("_v")).select(*by, *(F.col("_v")[v].alias(v) for v in values))


def change_epochs(rows: DataFrame, by: Sequence[str], value: Column, ts: str, seq: str, name: str = "epoch") -> DataFrame:
    """Rows with the number of changes of `value` so far in their key; the first epoch is 1."""
    w = Window.partitionBy(*by).orderBy(ts, seq)
    marked = rows.withColumn("_value", value)
    marked = marked.withColumn("_new", F.when(F.col("_value").eqNullSafe(F.lag("_value").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new", "_value")


def covering(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, value: str) -> DataFrame:
    """(key, n, lowest) of each point in an interval: how many hold it, both ends included, and the least `value` of them.

    No pairs are made. Intervals are cut into the fewest aligned pieces of 2^level; a piece is aggregated once, and a
    point looks up the one piece of each level that it lies in. Pieces above level `top` are dealt out to those of level
    `top`, so that no piece has a large share of a long log's points.
    """
    top = 32
    level, low, high = F.col("_level"), F.col("_lo"), F.col("_hi")
    up = lambda c, n: -F.call_function("shiftright", -c, n)  # noqa: E731  rounded up, as shifts round down
    i = intervals.where(F.col(start) <= F.col(end)).select(F.col(start).alias("_s"), (F.col(end) + 1).alias("_e"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(62))).alias("_level"))
    i = i.select("_v", "_level", up(F.col("_s"), level).alias("_lo"), F.call_function("shiftright", "_e", level).alias("_hi")).where(low < high)
    ends = F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1))
    pieces = i.select("_v", "_level", F.explode(F.array_compact(ends)).alias("_piece"))
    pieces = pieces.groupBy("_level", "_piece").agg(F.count("*").alias("_n"), F.min("_v").alias("_v"))
    wide = F.greatest(level - top, F.lit(0))
    first = F.call_function("shiftleft", F.col("_piece"), wide)
    dealt = pieces.select(F.least(level, F.lit(top)).alias("_level"), "_n", "_v", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1)).alias("_piece"))
    held = dealt.groupBy("_level", "_piece").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"))
    p = points.select(key, F.col(ts).alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level"))
    p = p.select(key, "_level", F.call_function("shiftright", F.col("_t"), level).alias("_piece"))
    return p.join(held, ["_level", "_piece"]).groupBy(key).agg(F.sum("_n").alias("n"), F.min("_v").alias("lowest"))


def fifo_match(rows: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, values: Sequence[str], name: str) -> DataFrame:
    """The opening rows, each with `values` of the row that closes it as the struct `name`, NULL where none does.

    Within a key, each other row closes the first open one; where none is open it closes nothing. Openings and closings that count are numbered
    alike, so the numbers are joined: a closing that meets nothing open is one that takes the balance of both to a new low.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_open", opens).withColumn("_balance", F.sum(F.when(F.col("_open"), 1).otherwise(-1)).over(w))
    low = F.greatest(-F.min("_balance").over(w), F.lit(0))
    told = marked.withColumn("_idle", low).withColumn("_opened", F.count_if("_open").over(w)).withColumn("_closed", F.count_if(~F.col("_open")).over(w) - F.col("_idle"))
    # A closing that counts has a number of its own; an idle one shares the number of the last that counted, and comes after it.
    closing = told.where(~F.col("_open")).groupBy(*by, F.col("_closed").alias("_opened")).agg(F.min_by(F.struct(*values), F.struct(*order)).alias(name)).where("_opened > 0")
    return told.where("_open").drop("_open", "_balance", "_idle", "_closed").join(closing, [*by, "_opened"], "left").drop("_opened")


def snapshots(changes: DataFrame, by: Sequence[str], ts: str, seq: str, values: Sequence[str], every: int, until: int, closed: Column | None = None) -> DataFrame:
    """(by, snapshot, values): the state of each key at the moments 0, every, 2 * every ... up to `until`, as far as it has one.

    changes: one row for each new state of a key; where `closed` is true the key has none from there on. The last state within a period
    is an aggregation; it is dealt to the snapshots up to the next period that has one, so a snapshot is as large as the state is.
    """
    period = F.call_function("div", F.col(ts) + F.lit(every - 1), F.lit(every))
    shut = F.lit(False) if closed is None else closed
    last = changes.withColumn("_shut", shut).groupBy(*by, period.alias("_p")).agg(F.max_by(F.struct("_shut", *values), F.struct(ts, seq)).alias("_v"))
    after = F.coalesce(F.lead("_p").over(Window.partitionBy(*by).orderBy("_p")), F.lit(until // every + 1)) - 1
    spread = last.withColumn("_to", F.least(after, F.lit(until // every))).where(~F.col("_v._shut") & (F.col("_p") <= F.col("_to")))
    return spread.select(*by, F.explode(F.sequence("_p", "_to")).alias("snapshot"), *(F.col("_v")[v].alias(v) for v in values))


def states_at(moments: DataFrame, moment: str, held: DataFrame, changes: DataFrame, by: Sequence[str], ts: str, seq: str, values: Sequence[str], every: int, closed: Column | None = None) -> DataFrame:
    """(moment, by, values): the state of all keys at each of many moments: that of the last snapshot, and the changes since.

    `held` are the `snapshots` of `changes`, kept as a table. A moment reads one snapshot and less than one period of changes,
    found by the period's number, not the whole log. The latest state by key is an aggregation over both.
    """
    shut = F.lit(False) if closed is None else closed
    asked = moments.select(F.col(moment).alias("_at"), F.call_function("div", F.col(moment), F.lit(every)).alias("_p"))
    none = F.lit(None).cast("long")
    base = asked.join(held.withColumnRenamed("snapshot", "_p"), "_p").select("_at", *by, F.lit(False).alias("_shut"), F.struct(none.alias("t"), none.alias("s")).alias("_order"), *values)
    tail = changes.withColumn("_shut", shut).withColumn("_p", F.call_function("div", F.col(ts), F.lit(every)))
    # What changes at the very moment of a snapshot is in it already; to take it again does no harm.
    since = asked.join(tail, "_p").where(F.col(ts) <= F.col("_at")).select("_at", *by, "_shut", F.struct(F.col(ts).cast("long").alias("t"), F.col(seq).cast("long").alias("s")).alias("_order"), *values)
    best = base.unionByName(since).groupBy("_at", *by).agg(F.max_by(F.struct("_shut", *values), "_order").alias("_v"))
    return best.where(~F.col("_v._shut")).select(F.col("_at").alias(moment), *by, *(F.col("_v")[v].alias(v) for v in values))
