"""Queries for reading and writing logs, on logs made from the events of one user each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.codec import from_hex
from chronofold.functions.time import micros
from chronofold.operators import replay
from chronofold.plans.fixtures import DAY, E, log_bounds, of_type, ops
from chronofold.plans.registry import query
from chronofold.sources import oplog
from chronofold.sources.tables import scratch, table

_TAGS = {"signup": "ACT+", "view": "MOVE", "click": "CST!", "error": "ACT-", "purchase": "HP"}
_SQL_TAG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v:<4}'" for k, v in _TAGS.items()) + " END"


def _tag() -> Column:
    out = F.lit(None).cast("string")
    for k, v in _TAGS.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return oplog.emit(e, F.col("ts"), _tag(), [F.hex("user_id"), F.col("k"), F.format_string("%.3f", F.col("value"))]).select("event_id", "line")


@query("emit_text", f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z|' || {_SQL_TAG} || '|' || upper(format('{{:x}}', user_id)) || '|' || json_extract_string(props, '$.k') || '|' || format('{{:.3f}}', value) AS line FROM events")
def emit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("scan_log_text", f"WITH {E} SELECT event_id, us AS ts_us, {_SQL_TAG} AS tag, user_id AS instance, k, value FROM e")
def scan_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among lines that are no records."""
    lines = _lines(spark, sf_dir)
    noise = lines.where("event_id % 7 = 0").select("event_id", F.explode(F.array(F.lit(""), F.lit("# comment|HP  |1"), F.lit("2024-01-01T00:00:00|TOOLONG|1"), F.lit("one field"))).alias("line"))
    p = oplog.parse(lines.unionByName(noise))
    return p.select("event_id", "ts_us", "tag", from_hex(oplog.field(0)).cast("long").alias("instance"), oplog.field(1).cast("long").alias("k"), oplog.field(2).cast("double").alias("value"))


@query("scan_versioned", f"WITH {E} SELECT event_id, 17 + user_id % 4 AS version, round(CASE WHEN 17 + user_id % 4 < 19 THEN 500 - value ELSE value END, 3) AS elapsed, CASE WHEN 17 + user_id % 4 >= 20 THEN k ELSE -1 END AS extra FROM e")
def scan_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that only later versions have, and one whose meaning changed: the rest became what has passed."""
    v = F.lit(17) + F.col("user_id") % 4
    e = ops(spark, sf_dir).withColumn("version", v)
    elapsed = F.when(F.col("version") < 19, F.lit(500) - F.col("value")).otherwise(F.col("value"))
    return e.select("event_id", "version", F.round(elapsed, 3).alias("elapsed"), oplog.since(F.col("version"), 20, F.col("k"), F.lit(-1).cast("long")).alias("extra"))


@query("frame_synth", f"WITH {E}, t AS (SELECT user_id, event_id, us // 86400000000 AS day, lag(us // 86400000000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e) SELECT user_id, event_id AS before_event, day FROM t WHERE before IS NULL OR day > before")
def frame_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame wherever the time advances; old logs have none of their own."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    d = ops(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    d = d.withColumn("before", F.lag("day").over(w))
    return d.where(F.col("before").isNull() | (F.col("day") > F.col("before"))).select("user_id", F.col("event_id").alias("before_event"), "day")


@query("frame_time", f"WITH {E}, f AS (SELECT *, first_value(us * 10 + k) OVER (PARTITION BY user_id ORDER BY event_id) AS q0, first_value(us) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e) SELECT event_id, CASE WHEN us * 10 + k < q0 THEN s ELSE s + (us * 10 + k - q0) // 10 END AS time_us FROM f")
def frame_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from a counter of 10 MHz."""
    e = ops(spark, sf_dir).withColumn("qpc", F.col("us") * 10 + F.col("k")).withColumn("start", F.first("us").over(Window.partitionBy("user_id").orderBy("event_id")))
    return oplog.frame_time(e, ["user_id"], "qpc", 10_000_000, F.col("start"), "event_id").select("event_id", "time_us")


@query("log_split", f"WITH {E}, s AS (SELECT user_id, us, event_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e) SELECT user_id, part, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2")
def log_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = oplog.split_at(ops(spark, sf_dir), ["user_id"], F.col("event_type") == "signup", "us", "event_id")
    return s.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("log_isolate", f"WITH {E}, b AS (SELECT min(us) + 864000000000 AS lo, min(us) + 2592000000000 AS hi FROM e), m AS (SELECT DISTINCT user_id FROM e, b WHERE event_type = 'purchase' AND us BETWEEN lo AND hi) SELECT event_id, e.user_id FROM e, b WHERE us BETWEEN lo AND hi AND (event_type = 'error' OR user_id IN (SELECT user_id FROM m))")
def log_isolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stretch of time: what concerns its members, and what concerns all."""
    low, _ = log_bounds(spark, sf_dir)
    part = ops(spark, sf_dir, low + 10 * DAY, low + 30 * DAY)
    members = of_type(part, "purchase").select("user_id").distinct()
    own = part.where("event_type <> 'error'").join(members, "user_id", "left_semi")
    return own.select("event_id", "user_id").unionByName(of_type(part, "error").select("event_id", "user_id"))


@query("snapshot", f"WITH {E}, t AS (SELECT (min(us) + max(us)) // 2 AS moment FROM e), l AS (SELECT user_id, event_type, event_id, us, value FROM e, t WHERE us <= moment QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) = 1) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS op_seq FROM l")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest operations that lead to the state at one moment, in order."""
    from chronofold.operators.temporal import state_at

    at = sum(log_bounds(spark, sf_dir)) // 2
    s = state_at(ops(spark, sf_dir, last=at), ["user_id", "event_type"], "us", "event_id", F.lit(at), ["event_id", "us", "value"])
    return s.withColumn("op_seq", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long"))


@query("anonymize", f"WITH {E}, f AS (SELECT user_id % 3 AS log, user_id, min((us, event_id)) AS f FROM e GROUP BY 1, 2), n AS (SELECT log, user_id, 'Player ' || row_number() OVER (PARTITION BY log ORDER BY f) AS pseudonym FROM f) SELECT e.event_id, n.pseudonym FROM e JOIN n ON e.user_id = n.user_id")
def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir).withColumn("log", F.col("user_id") % 3)
    return oplog.pseudonyms(e, ["log"], "user_id", "us", "event_id").select("event_id", "pseudonym")


_RECORDS = {"signup": "ACT+", "view": "HP", "click": "STA+", "purchase": "STA-", "error": "ACT-"}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records of one log, written as text and read again."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    own, slot, value = F.hex("user_id"), F.col("k") % 4, F.format_string("%.3f", F.col("value"))
    tag, fields = F.lit(None).cast("string"), F.lit("")
    told = {"signup": [own, F.hex("k"), "0", "0", "name", "0", "0001"], "view": [own, F.floor("value").cast("string"), "100"], "click": [own, slot.cast("string"), F.concat("k", F.lit(" name")), "1F", value, own], "purchase": [own, slot.cast("string")], "error": [own]}
    for kind, parts in told.items():
        tag = F.when(F.col("event_type") == kind, _RECORDS[kind]).otherwise(tag)
        fields = F.when(F.col("event_type") == kind, F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(fields)
    lines = oplog.emit(e, F.col("ts"), tag, [fields]).select(F.lit("log").alias("replay_id"), F.col("event_id").alias("op_seq"), "line")
    # Each table of a replay reads the records anew: they are made and parsed once.
    records = oplog.parse(lines).drop("line")
    path = f"{scratch(spark, 'records')}/all"
    records.write.parquet(path)
    return spark.read.schema(records.schema).parquet(path)


@query(
    "replay_statuses",
    f"""WITH {E}, w AS (SELECT event_id, user_id, event_type, us, k, round(value, 3) AS remaining, CASE WHEN event_type IN ('click', 'purchase') THEN lead(us) OVER (PARTITION BY user_id, k % 4, event_type IN ('click', 'purchase') ORDER BY us, event_id) END AS nxt,
    min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone, (SELECT max(us) FROM e) AS over FROM e)
    SELECT event_id, user_id AS instance, k % 4 AS slot, k AS status, CAST(31 AS BIGINT) AS extra, remaining AS remaining_s, us AS start_us, least(coalesce(nxt, over), coalesce(gone, over)) AS end_us FROM w WHERE event_type = 'click'""",
)
def replay_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status intervals from the typed records of a log: closed by the next write to a slot, or by the end of the entity."""
    s = replay.statuses(_records(spark, sf_dir))
    return s.select(F.col("op_seq").alias("event_id"), F.col("instance").cast("long").alias("instance"), "slot", "status", "extra", "remaining_s", "start_us", "end_us")


@query("replay_hp", f"WITH {E} SELECT user_id AS instance, us AS ts_us, CAST(floor(value) AS BIGINT) AS hp, CAST(100 AS BIGINT) AS max_hp FROM e WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) = 1")
def replay_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = replay.hp_history(_records(spark, sf_dir))
    return h.select(F.col("instance").cast("long").alias("instance"), "ts_us", "hp", "max_hp")
