"""Queries for the temporal joins, intervals and ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.time import clamp, micros, seconds
from chronofold.operators import temporal as T
from chronofold.plans.fixtures import DAY, E, HOUR, S, log_bounds, log_end, of_type, ops, statuses
from chronofold.plans.registry import query
from chronofold.sources.tables import table


def _asof(kind: str, op: str) -> str:
    return f"""WITH {E} SELECT l.event_id, r.event_id AS other_id, r.value AS other_value
    FROM (SELECT * FROM e WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = '{kind}') r
    ON l.user_id = r.user_id AND l.us {op} r.us"""


def _as_of(spark: SparkSession, sf_dir: str, kind: str, **how) -> DataFrame:
    e = ops(spark, sf_dir)
    right = of_type(e, kind).select("user_id", "us", F.col("event_id").alias("other_id"), F.col("value").alias("other_value"))
    left = of_type(e, "purchase").select("user_id", "us", "event_id")
    return T.as_of(left, right, ["user_id"], "us", ["other_id", "other_value"], "other_id", **how).select("event_id", "other_id", "other_value")


@query("asof_backward", _asof("view", ">="))
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, "view")


@query("asof_strict", _asof("click", ">"))
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, "click", strict=True)


@query("asof_forward", _asof("click", "<="))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_of(spark, sf_dir, "click", direction="forward")


@query(
    "asof_multi",
    f"""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase')
    SELECT p.event_id, a.value AS view_value, b.value AS click_value, c.value AS error_value FROM p
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') a ON p.user_id = a.user_id AND p.us >= a.us
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') b ON p.user_id = b.user_id AND p.us >= b.us
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') c ON p.user_id = c.user_id AND p.us >= c.us""",
)
def asof_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several attributes at once: one window, whatever their number."""
    e = ops(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.last(F.when(F.col("event_type") == k, F.col("value")), ignorenulls=True).over(w).alias(f"{k}_value") for k in ("view", "click", "error")]
    return e.select("event_id", "event_type", *latest).where("event_type = 'purchase'").drop("event_type")


@query("status_intervals", f"WITH {E}, {S} SELECT user_id, slot, status, start_us, end_us FROM s")
def status_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(ops(spark, sf_dir)).select("user_id", "slot", "status", "start_us", "end_us")


@query("interval_build", f"WITH {E} SELECT user_id, event_id, us AS start_us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), (SELECT max(us) FROM e)) AS end_us FROM e WHERE event_type = 'purchase'")
def interval_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot for each entity: a new value ends the old one."""
    e = ops(spark, sf_dir)
    p = of_type(e, "purchase").select("user_id", "event_id", "us")
    return T.slot_intervals(p, ["user_id"], "us", "event_id", F.lit(log_end(e))).drop("us")


@query(
    "interval_close",
    f"""WITH {E}, {S}, d AS (SELECT user_id, us FROM e WHERE event_type = 'error')
    SELECT s.user_id, s.slot, s.event_id, s.start_us, least(s.end_us, d.us) AS end_us
    FROM s ASOF LEFT JOIN d ON s.user_id = d.user_id AND s.start_us <= d.us""",
)
def interval_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destruction of an entity closes what is open on it."""
    e = ops(spark, sf_dir)
    gone = of_type(e, "error").select("user_id", F.col("us").alias("gone_us"))
    return T.closed_by(statuses(e), gone, ["user_id"], "start_us", "end_us", "gone_us").select("user_id", "slot", "event_id", "start_us", "end_us")


@query(
    "interval_contains",
    f"""WITH {E}, {S}, p AS (SELECT * FROM e WHERE event_type = 'error')
    SELECT p.event_id, s.event_id AS opened_by, s.slot FROM p JOIN s ON p.user_id = s.user_id AND p.us BETWEEN s.start_us AND s.end_us
    QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.start_us, s.event_id) = 1""",
)
def interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir)
    p = of_type(e, "error").select("user_id", F.col("event_id").alias("point_id"), "us")
    return T.first_containing(p, statuses(e), ["user_id"], "point_id", "us", "start_us", "end_us", ["start_us", "event_id"], 30 * DAY).select(F.col("point_id").alias("event_id"), F.col("event_id").alias("opened_by"), "slot")


@query("interval_semi", f"WITH {E}, {S} SELECT event_id, user_id FROM e WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.status = 'click' AND e.us BETWEEN s.start_us AND s.end_us)")
def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir)
    p = of_type(e, "purchase").select("event_id", "user_id", "us")
    return T.interval_join(p, statuses(e).where("status = 'click'").select("user_id", "start_us", "end_us"), ["user_id"], "us", "start_us", "end_us", 30 * DAY, "left_semi").select("event_id", "user_id")


@query(
    "nearest_interval",
    f"""WITH {E}, i AS (SELECT user_id, event_id AS interval_id, us AS s, least(us + CAST(value * 60000000 AS BIGINT), coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + CAST(value * 60000000 AS BIGINT)) - 1) AS t FROM e WHERE event_type = 'purchase')
    SELECT p.event_id, i.interval_id, greatest(0, i.s - p.us, p.us - i.t) AS distance FROM e p JOIN i USING (user_id) WHERE p.event_type = 'signup'
    QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY greatest(0, i.s - p.us, p.us - i.t), i.s) = 1""",
)
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases last `value` minutes, or until the next one."""
    e = ops(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    until = F.col("us") + F.round(F.col("value") * 60_000_000).cast("long")
    i = of_type(e, "purchase").withColumn("end_us", F.least(until, F.coalesce(F.lead("us").over(w), until) - 1)).select("user_id", F.col("us").alias("start_us"), "end_us", F.col("event_id").alias("interval_id"))
    p = of_type(e, "signup").select("user_id", "us", "event_id")
    return T.nearest_interval(p, i, ["user_id"], "us", "start_us", "end_us", ["interval_id"]).where(F.col("interval_id").isNotNull()).select("event_id", "interval_id", "distance")


@query(
    "band_join",
    f"""WITH {E} SELECT p.event_id, c.event_id AS click_id, c.us - p.us AS gap_us FROM e p JOIN e c ON p.user_id = c.user_id AND abs(c.us - p.us) < {6 * HOUR}
    WHERE p.event_type = 'purchase' AND c.event_type = 'click' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.us, c.event_id) = 1""",
)
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir)
    c = of_type(e, "click").select("user_id", F.col("us").alias("click_us"), F.col("event_id").alias("click_id"))
    p = of_type(e, "purchase").select("user_id", "us", "event_id")
    return T.band_join(p, c, ["user_id"], "us", "event_id", "click_us", ["click_us", "click_id"], 6 * HOUR).select("event_id", "click_id", (F.col("click_us") - F.col("us")).alias("gap_us"))


@query(
    "interval_edges",
    f"""WITH {E}, {S}, x AS (SELECT user_id, start_us AS us, 1 AS opens, 0 AS closes FROM s UNION ALL SELECT user_id, end_us, 0, 1 FROM s)
    SELECT e.event_id, CAST(sum(x.opens) AS BIGINT) AS opens, CAST(sum(x.closes) AS BIGINT) AS closes FROM e JOIN x ON e.user_id = x.user_id AND e.us = x.us GROUP BY 1""",
)
def interval_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir)
    s = statuses(e)
    edge = s.select("user_id", F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(1).alias("o"), F.lit(0).alias("c")), F.struct(F.col("end_us").alias("us"), F.lit(0).alias("o"), F.lit(1).alias("c")))).alias("x")).select("user_id", "x.*")
    return e.join(edge, ["user_id", "us"]).groupBy("event_id").agg(F.sum("o").alias("opens"), F.sum("c").alias("closes"))


@query("interval_adjacent", f"WITH {E}, {S} SELECT event_id, coalesce(start_us = lag(end_us) OVER (PARTITION BY user_id, status ORDER BY start_us, event_id), false) AS adjacent FROM s")
def interval_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "status").orderBy("start_us", "event_id")
    return statuses(ops(spark, sf_dir)).select("event_id", F.coalesce(F.col("start_us") == F.lag("end_us").over(w), F.lit(False)).alias("adjacent"))


@query(
    "interval_union",
    f"""WITH {E}, i AS (SELECT user_id, us AS start_us, us + CAST(value * 3600000000 AS BIGINT) AS end_us FROM e),
    m AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged FROM n GROUP BY user_id, island""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir).select("user_id", F.col("us").alias("start_us"), (F.col("us") + F.round(F.col("value") * 3_600_000_000).cast("long")).alias("end_us"))
    return T.interval_union(e, ["user_id"], "start_us", "end_us")


@query(
    "run_length",
    f"""WITH {E}, m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER v THEN 0 ELSE 1 END AS new, lead(us) OVER v AS nxt FROM e WINDOW v AS (PARTITION BY user_id ORDER BY us, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT user_id, event_type, min(us) AS start_us, max(coalesce(nxt, us)) AS end_us, count(*) AS n FROM n GROUP BY user_id, event_type, run HAVING event_type <> 'error' AND max(coalesce(nxt, us)) > min(us)""",
)
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one value; the idle value and empty runs are left out."""
    r = T.run_length(ops(spark, sf_dir), ["user_id"], "event_type", "us", "event_id")
    return r.where("event_type <> 'error' AND end_us > start_us").select("user_id", "event_type", "start_us", "end_us", "n")


@query(
    "hp_ranges",
    f"""WITH {E}, b AS (SELECT min(us) + 864000000000 AS lo, min(us) + 2592000000000 AS hi FROM e),
    r AS (SELECT user_id, us, value, coalesce(lead(us) OVER w, (SELECT hi FROM b)) AS nxt, first_value(value) OVER w AS initial FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT user_id, greatest(us, lo) AS start_us, least(nxt, hi) AS end_us, round(CASE WHEN initial <> 0 THEN least(value / initial, 1.0) END, 6) AS base, round(CASE WHEN initial <> 0 THEN greatest(value / initial - 1.0, 0.0) END, 6) AS bonus
    FROM r, b WHERE greatest(us, lo) < least(nxt, hi)""",
)
def hp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step function as ranges, cut to a window; its value as a share of the first one, split at 1."""
    e = ops(spark, sf_dir)
    first = e.agg(F.min("us")).first()[0] or 0
    lo, hi = F.lit(first + 10 * DAY), F.lit(first + 30 * DAY)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    r = e.withColumn("next", F.coalesce(F.lead("us").over(w), hi)).withColumn("share", F.try_divide(F.col("value"), F.first("value").over(w)))
    r = r.withColumn("start_us", F.greatest("us", lo)).withColumn("end_us", F.least("next", hi)).where("start_us < end_us")
    return r.select("user_id", "start_us", "end_us", F.round(F.when(F.col("share").isNotNull(), F.least("share", F.lit(1.0))), 6).alias("base"), F.round(F.when(F.col("share").isNotNull(), F.greatest(F.col("share") - 1.0, F.lit(0.0))), 6).alias("bonus"))


@query("cast_gap", f"WITH {E}, {S} SELECT event_id, start_us - lag(end_us) OVER (PARTITION BY user_id, slot ORDER BY start_us, event_id) AS gap_us FROM s")
def cast_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "slot").orderBy("start_us", "event_id")
    return statuses(ops(spark, sf_dir)).select("event_id", (F.col("start_us") - F.lag("end_us").over(w)).alias("gap_us"))


@query(
    "reorder_detect",
    """WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) AS us, lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS before FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, before - us AS late_us FROM x WHERE before > us""",
)
def reorder_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations earlier than the one before them in the order of the actions."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", micros("l_shipdate").alias("us"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return l.withColumn("before", F.lag("us").over(w)).where("before > us").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("before") - F.col("us")).alias("late_us"))


@query(
    "state_at",
    f"""WITH {E}, t AS (SELECT (min(us) + max(us)) // 2 AS moment FROM e)
    SELECT user_id, event_type, value, us, k FROM e, t WHERE us <= moment QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) = 1""",
)
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sum(log_bounds(spark, sf_dir)) // 2
    return T.state_at(ops(spark, sf_dir, last=at), ["user_id", "event_type"], "us", "event_id", F.lit(at), ["value", "us", "k"])


@query("tick_batches", f"WITH {E} SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY us // {DAY}) AS tick, count(*) OVER (PARTITION BY user_id, us // {DAY}) AS n_in_tick FROM e")
def tick_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of one tick, here a day, form a batch."""
    e = ops(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return e.select("event_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy("day")).cast("long").alias("tick"), F.count("*").over(Window.partitionBy("user_id", "day")).alias("n_in_tick"))


@query(
    "identity_epochs",
    f"""WITH {E}, m AS (SELECT *, CASE WHEN k % 3 = lag(k % 3) OVER v THEN 0 ELSE 1 END AS new FROM e WHERE event_type = 'signup' WINDOW v AS (PARTITION BY user_id ORDER BY us, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM m)
    SELECT user_id, CAST(epoch AS BIGINT) AS epoch, min(k % 3) AS identity, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM n GROUP BY user_id, epoch""",
)
def identity_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that comes back with another identity is another participant; with the same one it continues."""
    s = of_type(ops(spark, sf_dir), "signup").withColumn("identity", F.col("k") % 3)
    return T.change_epochs(s, ["user_id"], F.col("identity"), "us", "event_id").groupBy("user_id", "epoch").agg(F.min("identity").alias("identity"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


@query(
    "time_to_phase",
    f"""WITH {E}, p AS (SELECT user_id, us AS phase_us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS phase FROM e WHERE event_type = 'signup')
    SELECT e.event_id, p.phase, (e.us - p.phase_us) / 1e6 AS offset_s FROM (SELECT * FROM e WHERE event_type <> 'signup') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.phase_us""",
)
def time_to_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last phase that has begun, and the time since then."""
    e = ops(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    p = of_type(e, "signup").select("user_id", "us", F.col("us").alias("phase_us"), F.row_number().over(w).cast("long").alias("phase"))
    left = e.where("event_type <> 'signup'").select("user_id", "us", "event_id")
    return T.as_of(left, p, ["user_id"], "us", ["phase_us", "phase"], "phase").select("event_id", "phase", seconds(F.col("us"), F.col("phase_us")).alias("offset_s"))


@query("enc_slice", f"WITH {E}, b AS (SELECT min(us) + 864000000000 AS lo, min(us) + 1728000000000 AS hi FROM e), {S} SELECT user_id, slot, event_id, start_us, least(end_us, hi) AS end_us FROM s, b WHERE start_us BETWEEN lo AND hi")
def enc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What begins within an encounter; intervals that are open at its start are no part."""
    e = ops(spark, sf_dir)
    low = e.agg(F.min("us")).first()[0] or 0
    s = statuses(e).where(F.col("start_us").between(low + 10 * DAY, low + 20 * DAY))
    return s.select("user_id", "slot", "event_id", "start_us", F.least("end_us", F.lit(low + 20 * DAY)).alias("end_us"))


@query("ts_diff", f"WITH {E} SELECT event_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 1e6 AS since_s FROM e")
def ts_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return ops(spark, sf_dir).select("event_id", seconds(F.col("us"), F.lag("us").over(w)).alias("since_s"))


@query("ts_clamp", f"WITH {E}, b AS (SELECT min(us) + 864000000000 AS lo, min(us) + 1728000000000 AS hi FROM e) SELECT event_id, greatest(lo, least(hi, us)) AS clamped_us FROM e, b")
def ts_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, _ = log_bounds(spark, sf_dir)
    return ops(spark, sf_dir).select("event_id", clamp(F.col("us"), F.lit(low + 10 * DAY), F.lit(low + 20 * DAY)).alias("clamped_us"))
