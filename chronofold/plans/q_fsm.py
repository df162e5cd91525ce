"""Queries for state machines, plans and the joins of encounter analysis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import geometry as G
from chronofold.functions.time import micros
from chronofold.operators import analysis, fsm
from chronofold.operators import temporal as T
from chronofold.plans import fold_sql
from chronofold.plans.fixtures import DAY, E, HOUR, S, of_type, ops, statuses
from chronofold.plans.q_functions import P, _r, points, uv, xz
from chronofold.plans.registry import query
from chronofold.sources.tables import table

#: A machine with a fork: (state, successor, seconds in the state, whether it is dangerous).
SPEC = [(1, 2, 10.0, False), (2, 3, 5.0, False), (2, 4, 5.0, False), (3, 5, 7.5, True), (4, 5, 2.5, False), (5, 6, 4.0, False), (6, None, 3.0, True)]
_VALUES = ", ".join(f"({a}, {'CAST(NULL AS INT)' if b is None else b}, CAST({d} AS DOUBLE), {str(f).lower()})" for a, b, d, f in SPEC)
_GRAPH = f"g(state, successor, dur, flag) AS (SELECT * FROM (VALUES {_VALUES}) v(state, successor, dur, flag))"
_FLATTEN = f"""WITH RECURSIVE {_GRAPH}, p(state, enter_s, path, danger) AS (
  SELECT 1, CAST(0 AS DOUBLE), CAST('1' AS {{text}}), false
  UNION ALL SELECT g.successor, p.enter_s + g.dur, CAST(concat(p.path, '/', g.successor) AS {{text}}), g.flag FROM p JOIN g ON p.state = g.state WHERE g.successor IS NOT NULL)
SELECT state, enter_s, path, danger FROM p"""


@query("fsm_flatten", _FLATTEN.format(text="VARCHAR"))
def fsm_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way through the machine, with the time at which each state is entered."""
    return spark.sql(_FLATTEN.format(text="STRING"))


_LOOK = f"""WITH RECURSIVE {_GRAPH}, n AS (SELECT state, count(successor) AS ways, max(successor) AS nxt, max(dur) AS dur, bool_or(flag) AS flag FROM g GROUP BY state),
p(start, state, wait_s, found) AS (SELECT state, state, CAST(0 AS DOUBLE), flag FROM n
  UNION ALL SELECT p.start, n.nxt, p.wait_s + n.dur, m.flag FROM p JOIN n ON p.state = n.state JOIN n m ON n.nxt = m.state WHERE NOT p.found AND n.ways = 1)
SELECT start AS state, wait_s FROM p WHERE found"""


@query("fsm_lookahead", _LOOK)
def fsm_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time until the next dangerous state along single successors; none beyond a fork."""
    return spark.sql(_LOOK)


@query("fsm_overdue", f"WITH {E}, t AS (SELECT event_id, event_type, (lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us) / 1e6 AS dur FROM e) SELECT event_id, event_type, dur FROM t WHERE dur > CASE event_type WHEN 'signup' THEN 20000 WHEN 'view' THEN 40000 ELSE 60000 END + 1")
def fsm_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that last more than a second longer than expected."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    expected = F.when(F.col("event_type") == "signup", 20000).when(F.col("event_type") == "view", 40000).otherwise(60000)
    return ops(spark, sf_dir).withColumn("dur", (F.lead("us").over(w) - F.col("us")) / 1e6).where(F.col("dur") > expected + 1).select("event_id", "event_type", "dur")


@query("fsm_schedule", f"WITH {E} SELECT event_id, round(coalesce(sum(least(greatest(value, 0), 100)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS enter_s FROM e WHERE event_type = 'click'")
def fsm_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state begins when the ones before it, of bounded length, have passed."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = of_type(ops(spark, sf_dir), "click")
    return e.select("event_id", F.round(F.coalesce(F.sum(F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0))).over(w), F.lit(0.0)), 4).alias("enter_s"))


@query("fsm_flag_time", f"WITH {E}, c AS (SELECT *, CASE WHEN event_type = 'error' THEN us END AS hit FROM e) SELECT event_id, (min(hit) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - us) / 1e6 AS wait_s FROM c")
def fsm_flag_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time until the flag is next set along a chain."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("event_type") == "error", F.col("us")), ignorenulls=True).over(w)
    return ops(spark, sf_dir).select("event_id", ((hit - F.col("us")) / 1e6).alias("wait_s"))


@query("timeline_align", f"WITH {E}, o AS (SELECT user_id, k % 6 + 1 AS state, max(value) AS seen FROM e WHERE event_type = 'click' GROUP BY 1, 2), x AS (SELECT user_id, s.state, s.dur FROM (SELECT DISTINCT user_id FROM e) u, (VALUES (1, 10.0), (2, 5.0), (3, 7.5), (4, 2.5), (5, 4.0), (6, 3.0)) s(state, dur)), l AS (SELECT user_id, max(state) AS reached FROM o GROUP BY 1) SELECT x.user_id, x.state, round(CASE WHEN o.seen IS NOT NULL THEN o.seen WHEN x.state < coalesce(l.reached, 0) THEN 0 ELSE CAST(x.dur AS DOUBLE) END, 4) AS dur_s FROM x LEFT JOIN o ON x.user_id = o.user_id AND x.state = o.state LEFT JOIN l ON x.user_id = l.user_id")
def timeline_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expected chain with the observed lengths; skipped states before the last one seen take no time."""
    e = ops(spark, sf_dir)
    seen = of_type(e, "click").groupBy("user_id", (F.col("k") % 6 + 1).alias("state")).agg(F.max("value").alias("seen"))
    chain = F.array(*(F.struct(F.lit(s).cast("long").alias("state"), F.lit(d).alias("dur")) for s, d in ((1, 10.0), (2, 5.0), (3, 7.5), (4, 2.5), (5, 4.0), (6, 3.0))))
    expected = e.select("user_id").distinct().select("user_id", F.explode(chain).alias("s")).select("user_id", "s.state", "s.dur")
    last = seen.groupBy("user_id").agg(F.max("state").alias("reached"))
    j = expected.join(seen, ["user_id", "state"], "left").join(last, "user_id", "left")
    return j.select("user_id", "state", F.round(F.coalesce("seen", F.when(F.col("state") < F.coalesce("reached", F.lit(0)), 0.0).otherwise(F.col("dur"))), 4).alias("dur_s"))


@query("plan_active", f"WITH {E}, {S} SELECT p.event_id, s.event_id AS entry FROM e p JOIN s ON p.user_id = s.user_id AND p.us BETWEEN s.start_us AND s.end_us AND s.slot <= p.k % 4 WHERE p.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.start_us DESC, s.event_id DESC) = 1")
def plan_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the entries whose window and branch fit, the one that began last."""
    e = ops(spark, sf_dir)
    p = of_type(e, "purchase").select("user_id", F.col("event_id").alias("point_id"), "us", F.col("k").alias("point_k"))
    hits = T.interval_join(p, statuses(e), ["user_id"], "us", "start_us", "end_us", 30 * DAY).where("slot <= point_k % 4")
    return hits.groupBy(F.col("point_id").alias("event_id")).agg(F.max_by("event_id", F.struct("start_us", "event_id")).alias("entry"))


@query("plan_upcoming", f"WITH {E}, {S}, t AS (SELECT (min(us) + max(us)) // 2 AS moment FROM e) SELECT user_id, event_id, greatest(start_us - moment, 0) AS wait_us, row_number() OVER (PARTITION BY user_id ORDER BY start_us, event_id) AS place FROM s, t WHERE start_us <= moment + {5 * DAY} AND end_us >= moment")
def plan_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that overlap the time ahead, by start."""
    e = ops(spark, sf_dir)
    low, high = e.agg(F.min("us"), F.max("us")).first()
    at = ((low or 0) + (high or 0)) // 2
    s = statuses(e).where((F.col("start_us") <= at + 5 * DAY) & (F.col("end_us") >= at))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("start_us", "event_id"))
    return s.select("user_id", "event_id", F.greatest(F.col("start_us") - at, F.lit(0)).alias("wait_us"), place.cast("long").alias("place"))


@query(
    "alive_cross",
    f"""WITH {E}, {S}, a AS (SELECT event_id AS action, us FROM e WHERE event_type = 'purchase')
    SELECT a.action, count(*) AS n_alive, min(s.user_id) AS lowest FROM a JOIN s ON a.us BETWEEN s.start_us AND s.end_us AND s.slot = 0 GROUP BY 1""",
)
def alive_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action with all that are there at its time, counted by starts and ends and not by pairs."""
    e = ops(spark, sf_dir)
    a = of_type(e, "purchase").select(F.col("event_id").alias("action"), "us")
    s = statuses(e).where("slot = 0").select("user_id", "start_us", "end_us")
    return T.covering(a, s, "action", "us", "start_us", "end_us", "user_id").select("action", F.col("n").alias("n_alive"), "lowest")


@query("nearest_peer", f"WITH {P} SELECT a.vec_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))), 6) + 0.0 AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def nearest_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest of the same kind, by cells in growing rings."""
    return analysis.nearest_alike(points(spark, sf_dir), "vec_id", "label", "x", "z").select("vec_id", _r(F.col("distance"), "distance"))


@query(
    "cast_action_merge",
    f"""WITH {E}, c AS (SELECT user_id, event_id AS cast_id, us AS start_us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), 9223372036854775807) AS next_us FROM e WHERE event_type = 'click'),
    a AS (SELECT user_id, event_id AS action_id, us FROM e WHERE event_type = 'purchase'),
    m AS (SELECT c.*, a.action_id, row_number() OVER (PARTITION BY c.cast_id ORDER BY a.us, a.action_id) AS n FROM c LEFT JOIN a ON a.user_id = c.user_id AND a.us >= c.start_us AND a.us < c.next_us)
    SELECT cast_id, action_id FROM m WHERE n = 1
    UNION ALL SELECT NULL, action_id FROM a WHERE action_id NOT IN (SELECT action_id FROM m WHERE n = 1 AND action_id IS NOT NULL)""",
)
def cast_action_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts and actions walked together: a cast goes with the first action before the next cast; what has no partner stays alone."""
    e = of_type(ops(spark, sf_dir), "click", "purchase")
    w = Window.partitionBy("user_id").orderBy("us", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id")
    e = e.withColumn("cast_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    a = of_type(e, "purchase").withColumn("n", F.row_number().over(Window.partitionBy("user_id", "cast_id").orderBy("us", "event_id"))).withColumn("cast_id", F.when(F.col("n") == 1, F.col("cast_id")))
    matched = a.select("cast_id", F.col("event_id").alias("action_id"))
    alone = of_type(e, "click").select(F.col("event_id").alias("cast_id")).join(matched.where("cast_id IS NOT NULL").select("cast_id"), "cast_id", "left_anti")
    return matched.unionByName(alone.withColumn("action_id", F.lit(None).cast("long")))


_AT = "d AS (SELECT *, u - x AS dx, v - z AS dz, sqrt((u - x) * (u - x) + (v - z) * (v - z)) AS r FROM p)"


@query("cone_analysis", f"WITH {P}, {_AT} SELECT vec_id, round(degrees(atan2(dx, dz)), 4) + 0.0 AS angle, round(r, 6) + 0.0 AS range_, r <= 2 AND abs(atan2(dx, dz)) <= 1.0 AS hit FROM d")
def cone_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle and range of each target as seen from its source, and whether a cone would hit it."""
    d = G.sub(uv(), xz())
    return points(spark, sf_dir).select("vec_id", (F.round(F.degrees(G.to_angle(d)), 4) + F.lit(0.0)).alias("angle"), _r(G.length(d), "range_"), ((G.length(d) <= 2) & (F.abs(G.to_angle(d)) <= 1.0)).alias("hit"))


@query("rect_analysis", f"WITH {P}, {_AT} SELECT vec_id, round(dx * cos(0.7) - dz * sin(0.7), 6) + 0.0 AS normal, round(dx * sin(0.7) + dz * cos(0.7), 6) + 0.0 AS along, abs(dx * cos(0.7) - dz * sin(0.7)) <= 0.8 AND dx * sin(0.7) + dz * cos(0.7) BETWEEN 0 AND 3 AS hit FROM d")
def rect_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    side, ahead = G.local(uv(), xz(), F.lit(0.7))
    return points(spark, sf_dir).select("vec_id", _r(side, "normal"), _r(ahead, "along"), ((F.abs(side) <= 0.8) & ahead.between(0, 3)).alias("hit"))


@query("falloff", f"WITH {P}, {_AT} SELECT CAST(floor(r) AS BIGINT) AS distance, count(*) AS n, round(avg(greatest(abs(dx), abs(dz))), 6) + 0.0 AS mean_max FROM d GROUP BY 1")
def falloff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By distance, Euclidean and by the larger component."""
    dx, dz = G.sub(uv(), xz())
    return points(spark, sf_dir).groupBy(F.floor(G.length((dx, dz))).alias("distance")).agg(F.count("*").alias("n"), _r(F.avg(F.greatest(F.abs(dx), F.abs(dz))), "mean_max"))


@query("gaze", f"WITH {P}, {_AT} SELECT vec_id, round(degrees(atan2(-dx, -dz)), 4) + 0.0 AS to_source, abs(atan2(-dx, -dz)) < pi() / 4 AS hit FROM d")
def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle from the target back to the source, and whether it is within an eighth of a turn of +Z."""
    back = G.to_angle(G.sub(xz(), uv()))
    return points(spark, sf_dir).select("vec_id", (F.round(F.degrees(back), 4) + F.lit(0.0)).alias("to_source"), (F.abs(back) < math.pi / 4).alias("hit"))


@query("knockback", f"WITH {P}, {_AT} SELECT vec_id, CASE WHEN r = 0 THEN 'other' WHEN label % 5 = 0 THEN 'immune' ELSE 'moved' END AS kind, round(CASE WHEN r > 0 AND label % 5 <> 0 THEN u + dx / r * 3 ELSE u END, 6) + 0.0 AS to_x, round(CASE WHEN r > 0 AND label % 5 <> 0 THEN v + dz / r * 3 ELSE v END, 6) + 0.0 AS to_z FROM d")
def knockback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets pushed three yalms away from their source, but for those that are immune."""
    d = G.sub(uv(), xz())
    n, moved = G.normalise(d), (G.length(d) > 0) & (F.col("label") % 5 != 0)
    kind = F.when(G.length(d) == 0, "other").when(F.col("label") % 5 == 0, "immune").otherwise("moved")
    at = lambda i: F.when(moved, uv()[i] + n[i] * 3).otherwise(uv()[i])
    return points(spark, sf_dir).select("vec_id", kind.alias("kind"), _r(at(0), "to_x"), _r(at(1), "to_z"))


@query(
    "tether_break",
    f"""WITH {E}, {S}, v AS (SELECT user_id, us, value FROM e WHERE event_type = 'view')
    SELECT s.event_id, a.value AS at_start, b.value AS at_end, round(b.value - a.value, 4) + 0.0 AS change FROM s ASOF LEFT JOIN v a ON s.user_id = a.user_id AND s.start_us >= a.us ASOF LEFT JOIN v b ON s.user_id = b.user_id AND s.end_us >= b.us""",
)
def tether_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure at both ends of an interval."""
    e = ops(spark, sf_dir)
    v = lambda n: of_type(e, "view").select("user_id", "event_id", F.col("us"), F.col("value").alias(n))
    s = statuses(e).select("user_id", F.col("event_id").alias("tether"), F.col("start_us").alias("us"), "end_us")
    a = T.as_of(s, v("at_start"), ["user_id"], "us", ["at_start"], "event_id").drop("us").withColumnRenamed("end_us", "us")
    b = T.as_of(a, v("at_end"), ["user_id"], "us", ["at_end"], "event_id")
    return b.select(F.col("tether").alias("event_id"), "at_start", "at_end", (F.round(F.col("at_end") - F.col("at_start"), 4) + F.lit(0.0)).alias("change"))


@query("position_cloud", f"WITH {P} SELECT label, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(z / 0.5) AS BIGINT) AS cz, count(*) AS n, count(*) FILTER (WHERE vec_id % 7 = 0) AS n_dead FROM p GROUP BY 1, 2, 3")
def position_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where things have been, by cell, and how often dead."""
    return points(spark, sf_dir).groupBy("label", F.floor(F.col("x") / 0.5).alias("cx"), F.floor(F.col("z") / 0.5).alias("cz")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 7 == 0).alias("n_dead"))


@query(
    "arc_union",
    f"""WITH {P}, a AS (SELECT label, atan2(x, z) - 0.002 AS lo, atan2(x, z) + 0.002 AS hi FROM p),
    s AS (SELECT label, greatest(lo, -pi()) AS lo, least(hi, pi()) AS hi FROM a UNION ALL SELECT label, lo + 2 * pi(), pi() FROM a WHERE lo < -pi() UNION ALL SELECT label, -pi(), hi - 2 * pi() FROM a WHERE hi > pi()),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY label ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
    n AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT label, round(min(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi FROM n GROUP BY label, island""",
)
def arc_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden arcs merged; those across the end of the circle are split there."""
    a = points(spark, sf_dir).select("label", (G.to_angle(xz()) - 0.002).alias("lo"), (G.to_angle(xz()) + 0.002).alias("hi"))
    s = fsm.split_arcs(a, "lo", "hi")
    return T.interval_union(s, ["label"], "lo", "hi").select("label", _r(F.col("lo"), "lo"), _r(F.col("hi"), "hi"))


_ISLANDS = """{0}_m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY label ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {1}),
    {0} AS (SELECT label, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM {0}_m) GROUP BY label, island)"""


@query(
    "arc_allowed",
    f"""WITH {P}, c AS (SELECT label, atan2(x, z) AS t, 0.5 / count(*) OVER (PARTITION BY label) AS half FROM p), a AS (SELECT label, t - half AS lo, t + half AS hi FROM c),
    s AS (SELECT label, greatest(lo, -pi()) AS lo, least(hi, pi()) AS hi FROM a UNION ALL SELECT label, lo + 2 * pi(), pi() FROM a WHERE lo < -pi() UNION ALL SELECT label, -pi(), hi - 2 * pi() FROM a WHERE hi > pi()),
    {_ISLANDS.format("f", "s")},
    g AS (SELECT f.*, cushion, row_number() OVER w AS place, count(*) OVER (PARTITION BY f.label) AS many, coalesce(lag(hi) OVER w, max(hi) OVER (PARTITION BY f.label) - 2 * pi()) AS before, coalesce(lead(lo) OVER w, min(lo) OVER (PARTITION BY f.label) + 2 * pi()) AS after
        FROM f JOIN (SELECT label, min(half) AS cushion FROM c GROUP BY label) USING (label) WINDOW w AS (PARTITION BY f.label ORDER BY lo)),
    allowed AS (SELECT label, before + cushion AS lo, lo - cushion AS hi FROM g WHERE place > 1 OR lo > -pi() UNION ALL SELECT label, hi + cushion, after - cushion FROM g WHERE place = many AND hi < pi()),
    u AS (SELECT label, lo + turn * 2 * pi() AS lo, hi + turn * 2 * pi() AS hi FROM f, (SELECT unnest([-1, 0, 1]) AS turn)),
    {_ISLANDS.format("l", "u")},
    n AS (SELECT *, lag(hi) OVER w AS before, lead(lo) OVER w AS after FROM l WINDOW w AS (PARTITION BY label ORDER BY lo)),
    d AS (SELECT label, vec_id, atan2(u, v) AS angle FROM p),
    j AS (SELECT d.label, vec_id, angle, n.lo AS b, n.hi AS e, before, after FROM d ASOF JOIN n ON d.label = n.label AND d.angle >= n.lo),
    k AS (SELECT label, vec_id, 'next_ccw' AS kind, e AS lo, after AS hi FROM j UNION ALL SELECT label, vec_id, 'next_cw', CASE WHEN angle <= e THEN before ELSE e END, CASE WHEN angle <= e THEN b ELSE after END FROM j),
    q AS (SELECT *, CASE WHEN lo >= pi() THEN -2 * pi() WHEN hi <= -pi() THEN 2 * pi() ELSE 0 END AS turn FROM k)
    SELECT label, 'forbidden' AS kind, CAST(NULL AS BIGINT) AS vec_id, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM f
    UNION ALL SELECT label, 'allowed', NULL, round(lo, 6) + 0.0, round(hi, 6) + 0.0 FROM allowed WHERE lo < hi
    UNION ALL SELECT label, kind, vec_id, round(lo + turn, 6) + 0.0, round(hi + turn, 6) + 0.0 FROM q""",
)
def arc_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden arcs, allowed ones with a cushion, and
    for each row the next allowed one in both directions from where (u, v) points. All arcs of a label together are
    one radian long, so that they never fill the circle."""
    p = points(spark, sf_dir)
    half = F.lit(0.5) / F.count("*").over(Window.partitionBy("label"))
    a = p.select("label", G.to_angle(xz()).alias("at"), half.alias("half"))
    arcs = fsm.split_arcs(a.select("label", (F.col("at") - F.col("half")).alias("lo"), (F.col("at") + F.col("half")).alias("hi")), "lo", "hi")
    forbidden = T.interval_union(arcs, ["label"], "lo", "hi").select("label", "lo", "hi")
    cushion = a.groupBy("label").agg(F.min("half").alias("cushion"))
    allowed = fsm.allowed_arcs(forbidden.join(cushion, "label"), "label", "lo", "hi", "cushion")
    toward = fsm.next_allowed(p.select("label", "vec_id", G.to_angle(uv()).alias("angle")), forbidden, "label", "angle", "lo", "hi")
    row = lambda d, kind, b="", i=None: d.select("label", F.lit(kind).alias("kind"), (F.col(i) if i else F.lit(None)).cast("long").alias("vec_id"), _r(F.col(f"{b}lo"), "lo"), _r(F.col(f"{b}hi"), "hi"))
    parts = [row(forbidden, "forbidden"), row(allowed, "allowed"), row(toward, "next_ccw", "ccw.", "vec_id"), row(toward, "next_cw", "cw.", "vec_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- folds whose next step needs the last one's result --------------------------------------------


@query("ema", fold_sql.EMA)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "value"), ["user_id"], ["us", "event_id"], fsm.moving_average, "user_id long, event_id long, average double")


@query("cdc_dedup", fold_sql.CDC)
def cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "value"), ["user_id"], ["us", "event_id"], fsm.changes_beyond, "user_id long, event_id long, value double")


@query("dedup_keys", fold_sql.NAMES)
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.split(F.lower("p_name"), " ")[0].alias("name"), "p_partkey")
    return fsm.fold(p, ["brand"], ["p_partkey"], fsm.distinct_names, "brand string, p_partkey long, unique_name string")


@query("request_match", fold_sql.REQUESTS)
def request_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "event_type", "k"), ["user_id"], ["us", "event_id"], fsm.match_requests, "user_id long, request long, response long, outcome string")


@query("protocol_check", fold_sql.PROTOCOL)
def protocol_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "event_type", "k"), ["user_id"], ["us", "event_id"], fsm.check_protocol, "user_id long, event_id long, warning string")


@query("cooldown_sim", fold_sql.CHARGES)
def cooldown_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(of_type(ops(spark, sf_dir), "click").select("user_id", "event_id", "us"), ["user_id"], ["us", "event_id"], fsm.simulate_charges, "user_id long, event_id long, charges double, deficit_s double")


@query("fsm_run", fold_sql.MACHINE)
def fsm_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "event_type"), ["user_id"], ["us", "event_id"], fsm.run_machine, "user_id long, us long, from_state string, to_state string, cause string")


@query("encounter_sessions", fold_sql.SESSIONS)
def encounter_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(ops(spark, sf_dir).select("user_id", "event_id", "us", "event_type", "k"), ["user_id"], ["us", "event_id"], fsm.sessions, "user_id long, session long, start_us long, end_us long, n_phases long, n_members long")


@query("hull", fold_sql.HULL)
def hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.fold(points(spark, sf_dir).select("label", "vec_id", "x", "z"), ["label"], ["vec_id"], fsm.thinned_hull, "label int, place long, x double, z double")


@query("priority_pick", fold_sql.PICK)
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queues, their lines as entries: what each order would start next."""
    entries = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("queue"), F.col("l_partkey").alias("entry"), (F.col("l_quantity") - 5).alias("priority"), (-F.col("l_quantity")).alias("behind"), micros("l_shipdate").alias("expire"),
        "l_suppkey", F.col("l_discount").alias("delay"), F.col("l_tax").alias("duration"), F.col("l_extendedprice").alias("cast"), F.lit(60000.0).alias("longest"), (F.col("l_returnflag") != "R").alias("usable"),
    )
    return fsm.pick_in_time(entries, "queue", ["behind", "expire", "entry", "l_suppkey"])


@query("request_audit", fold_sql.AUDIT)
def request_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks ask, purchases answer, errors reject, views start or stop casts; a signup is another player."""
    e, k = ops(spark, sf_dir), F.col("k")
    view = F.when(k % 2 == 0, "start").otherwise("stop")
    kind = F.when(F.col("event_type") == "view", view).otherwise(F.element_at(F.create_map(*(F.lit(x) for x in ("click", "ask", "purchase", "answer", "error", "reject", "signup", "reset"))), F.col("event_type")))
    rows = e.select("user_id", "event_id", "us", kind.alias("kind"), (k % 8).alias("seq"), F.call_function("div", k, F.lit(8)).alias("rest")).where("kind <> 'answer' OR seq <> 0")
    rows = rows.withColumn("action", F.col("rest") % 4).drop("rest")
    return fsm.fold(rows, ["user_id"], ["us", "event_id"], fsm.audit_requests, "user_id long, event_id long, warning string")
