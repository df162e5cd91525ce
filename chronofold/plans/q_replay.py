"""Queries on log files: the events of each user are written as a log of some version and form, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.time import moment
from chronofold.operators import replay
from chronofold.operators.temporal import snapshots, states_at
from chronofold.plans.fixtures import E, log_bounds, ops
from chronofold.plans.registry import query
from chronofold.sources import oplog
from chronofold.sources.records import ALIASES, typed
from chronofold.sources.tables import scratch


def _number(c: Column) -> Column:
    return c.cast("long").cast("string")


def _joined(parts: list[Column | str]) -> Column:
    """Tag and fields as text. Those that are fixed are joined here: a case of few pieces is short, and Java doesn't compile a method of more than 8,000 bytes."""
    out: list[Column | str] = []
    for i, p in enumerate(parts):
        for piece in ("|", p) if i else (p,):
            if isinstance(piece, str) and out and isinstance(out[-1], str):
                out[-1] += piece
            else:
                out.append(piece)
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in out))


def _either(cases: dict[str, list[Column | str]]) -> Column:
    """Tag and fields by event type, as an array."""
    out = F.lit(None).cast("array<string>")
    for kind, parts in cases.items():
        out = F.when(F.col("event_type") == kind, F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(out)
    return out


def _texts() -> dict[str, Column]:
    """The texts that all versions have in common, made once for each operation; what is null is an empty field."""
    return {
        "_own": F.hex("event_id"),
        "_v": F.format_string("%.3f", F.col("value")),
        "_left": F.format_string("%.3f", F.lit(600.0) - F.round("value", 3)),
        "_whole": F.coalesce(_number(F.col("value")), F.lit("")),
        "_k": F.coalesce(_number(F.col("k")), F.lit("")),
    }


def _written() -> dict[int, dict[str, list[Column | str]]]:
    """What each version writes for the same five operations, from their `_texts`."""
    own, v, left, whole, k = (F.col(f"_{c}") for c in ("own", "v", "left", "whole", "k"))
    found: dict[int, dict[str, list[Column | str]]] = {
        5: {
            "signup": ["ACT+", F.concat(own, F.lit("/2A/name/Enemy/"), v, F.lit("/0/1/90")), "WAR", "True", "0.500", "0", "100/200"],
            "view": ["HP  ", own, F.concat(whole, F.lit("/900"))],
            "click": ["CST+", own, F.concat(F.lit("Spell "), k), "0", "0/0/0", F.concat(v, F.lit("/600.000"))],
            "purchase": ["CLCD", "False", "1", k, v, "600"],
            "error": ["MOVE", F.concat(own, F.lit("/2A/name/Enemy/0/0/"), v, F.lit("/90"))],
        },
        12: {
            "signup": ["ACT+", own, "2A", "-1", "name", "0205", "WAR", "0", F.concat(v, F.lit("/0/1")), "90", "0.500", "100", "200", "0", "0", "True", "False", "0"],
            "view": ["HP  ", own, whole, "900", "0", "0"],
            "click": ["CST+", own, F.concat(F.lit("Spell "), k), "0", "0/0/0", F.concat(v, F.lit("/600.000")), "False", "0"],
            "purchase": ["CLCD", "False", "1", k, v, "600"],
            "error": ["MOVE", own, F.concat(F.lit("0/0/"), v), "90"],
        },
    }
    found[19] = found[12] | {
        "signup": [*found[12]["signup"][:5], "0", *found[12]["signup"][5:], "0"],
        "click": [*found[12]["click"][:5], F.concat(left, F.lit("/600.000")), "False", "0"],
        "purchase": ["CLCD", "False", "1", k, left, "600"],
    }
    found[31] = found[19] | {
        "signup": ["ACT+", own, "2A", "-1", "0", "name", "0", "0205", "WAR", "0", F.concat(v, F.lit("/0/1")), "90", "0.500", "100", "200", "0", "0", "10000", "True", "False", "0", "0", "0"],
        "view": [*found[12]["view"], "10000"],
    }
    return found


_HEAD = {5: "VER |5", 12: "VER |12|10000000|game", 19: "VER |19|10000000|game", 31: "VER |31|10000000|game"}


def _exact() -> dict[str, list[Column | str]]:
    """Five operations in the very form in which the latest version writes them."""
    own, v = F.format_string("%08X", "event_id"), F.format_string("%.3f", F.col("value"))
    return {
        "signup": ["ACT+", own, "2A", "-1", "0", "name", "0", "0205", "WAR", "0", F.concat(v, F.lit("/0.000/1.000")), "90.000", "0.500", "100", "200", "0", "0", "10000", "True", "False", "00000000", "0", "0"],
        "view": ["HP  ", own, _number(F.col("value")), "900", "0", "0", "10000"],
        "click": ["CST+", own, F.concat(F.lit("Spell "), _number(F.col("k"))), "00000000", "0.000/0.000/0.000", F.concat(v, F.lit("/600.000")), "False", "0.000"],
        "purchase": ["STA+", own, _number(F.col("k")), "55", "001F", v, F.format_string("%08X", "user_id")],
        "error": ["MOVE", own, F.concat(F.lit("0.000/0.000/"), v), "90.000"],
    }


def _log_name() -> Column:
    return F.concat(F.lit("by user/"), F.col("user_id").cast("string"), F.lit(".log"))


def _user() -> Column:
    return F.regexp_extract("replay_id", r"(\d+)\.log$", 1).cast("long")


def _line(us: Column, record: Column) -> Column:
    return F.concat(F.date_format(moment(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z|"), record)


def _payloads(records: DataFrame) -> DataFrame:
    """The typed records of six tags, a few fields of each; the logs are read once."""
    none = lambda t: F.lit(None).cast(t)
    id_ = F.col("instance").cast("long")
    of = {
        "ACT+": (id_, F.col("type").cast("long"), F.col("max_mp"), F.col("position.x")),
        "HP  ": (id_, F.col("hp"), F.col("max_mp"), F.col("max_hp").cast("double")),
        "CST+": (id_, F.col("action.id"), none("long"), F.col("time.elapsed")),
        "CLCD": (none("long"), F.element_at("cooldowns", 1)["group"], none("long"), F.element_at("cooldowns", 1)["elapsed"]),
        "STA+": (id_, F.col("slot"), F.col("extra"), F.col("remaining_s")),
        "MOVE": (id_, none("long"), none("long"), F.col("position.z")),
    }
    wanted = records.where(F.col("tag").isin(*of, *(old for old, now in ALIASES.items() if now in of)))
    records = oplog.saved(wanted, "records")
    out = None
    for tag, (instance, a, b, x) in of.items():
        part = typed(records, tag).select(_user().alias("user_id"), F.lit(tag.strip()).alias("tag"), "ts_us", instance.alias("instance"), a.alias("a"), b.alias("b"), F.round(x, 3).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


_SQL_PAYLOADS = "SELECT user_id, us AS ts_us, CASE event_type WHEN 'signup' THEN 'ACT+' WHEN 'view' THEN 'HP' WHEN 'click' THEN 'CST+' WHEN 'purchase' THEN '{bought}' ELSE 'MOVE' END AS tag, {id} AS instance, CASE event_type WHEN 'signup' THEN 517 WHEN 'view' THEN CAST(trunc(value) AS BIGINT) WHEN 'error' THEN NULL ELSE k END AS a, CASE WHEN event_type IN ('signup', 'view') THEN 10000 {b} END AS b, round(CASE event_type WHEN 'view' THEN 900 {left} ELSE round(value, 3) END, 3) AS x FROM e"


@query("versioned_logs", f"WITH {E} {_SQL_PAYLOADS.format(bought='CLCD', id='''CASE WHEN event_type <> 'purchase' THEN event_id END''', b='', left='''WHEN 'click' THEN 600 - round(value, 3) WHEN 'purchase' THEN 600 - round(value, 3)''')}")
def versioned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user, of version 5, 12, 19 or 31: whatever a version writes, and wherever its fields stand, the rows are the same."""
    written = _written()
    versions = list(written)
    e = ops(spark, sf_dir)
    record, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, v in enumerate(versions):
        own = F.col("user_id") % len(versions) == i
        told = F.lit(None).cast("string")
        for kind, parts in written[v].items():
            told = F.when(F.col("event_type") == kind, _joined(parts)).otherwise(told)
        record, head = F.when(own, told).otherwise(record), F.when(own, F.lit(_HEAD[v])).otherwise(head)
    lines = e.withColumns(_texts()).select(_log_name().alias("replay_id"), F.col("event_id").alias("op_seq"), _line(F.col("us"), record).alias("line"))
    first = e.groupBy("user_id").agg(F.min("us").alias("us")).select(_log_name().alias("replay_id"), F.lit(-1).cast("long").alias("op_seq"), _line(F.col("us"), head).alias("line"))
    path = scratch(spark, "versions")
    oplog.write_lines(first.unionByName(lines), path)
    return _payloads(oplog.read_records(spark, path))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the latest version, a log for each user: at each event a frame and its operation. Logs are in order of time."""
    e = ops(spark, sf_dir)
    counter = (F.col("us") * 10).cast("string")
    frame = F.array(*(F.lit(p) for p in ("FRAM", "16.000", "", "0" * 16, "0" * 16)), counter, *(F.lit(p) for p in ("1", "0.25", "0.25", "1", "45.000")))
    own = e.select(_log_name().alias("replay_id"), "us", "event_id", F.posexplode(F.array(frame, _either(_exact()))).alias("n", "parts"))
    first = e.groupBy("user_id").agg(F.min("us").alias("us")).select(_log_name().alias("replay_id"), "us", F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("n"), F.array(*(F.lit(p) for p in ("VER ", "31", "10000000", "game"))).alias("parts"))
    # In one bigint: the time, then the event's place among those of its time, then the frame before the operation.
    log = Window.partitionBy("_hash", "replay_id").orderBy("us", "event_id", "n")
    # Dealt as `write_logs` deals them, so that there is one shuffle for both.
    dealt = first.unionByName(own).repartition("replay_id").withColumn("_hash", oplog.name_hash())
    told = dealt.withColumn("op_seq", F.row_number().over(log).cast("long"))
    return told.select("replay_id", "op_seq", F.col("us").alias("ts_us"), F.lit(31).alias("version"), F.element_at("parts", 1).alias("tag"), F.slice("parts", 2, 99).alias("fields"))


@query("binary_scan", f"WITH {E} {_SQL_PAYLOADS.format(bought='STA+', id='event_id', b='''WHEN event_type = 'purchase' THEN 31''', left='')}")
def binary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as bytes and read again; times are those that the counters of frames give."""
    path = scratch(spark, "binary")
    oplog.write_logs(_latest(spark, sf_dir), path)
    return _payloads(oplog.read_records(spark, path))


_SQL_STAMP = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || '0Z|'"
_SQL_ID, _SQL_USER = "format('{:08X}', event_id)", "format('{:08X}', user_id)"
_SQL_LINES = f"""WITH {E}, l AS (
    SELECT user_id, min(us) AS us, -1 AS event_id, 0 AS n, 'VER |31|10000000|game' AS t FROM e GROUP BY user_id
    UNION ALL SELECT user_id, us, event_id, 0, 'FRAM|16.000||0000000000000000|0000000000000000|' || us * 10 || '|1|0.25|0.25|1|45.000' FROM e
    UNION ALL SELECT user_id, us, event_id, 1, CASE event_type
        WHEN 'signup' THEN 'ACT+|' || {_SQL_ID} || '|2A|-1|0|name|0|0205|WAR|0|' || format('{{:.3f}}', value) || '/0.000/1.000|90.000|0.500|100|200|0|0|10000|True|False|00000000|0|0'
        WHEN 'view' THEN 'HP  |' || {_SQL_ID} || '|' || CAST(trunc(value) AS BIGINT) || '|900|0|0|10000'
        WHEN 'click' THEN 'CST+|' || {_SQL_ID} || '|Spell ' || k || '|00000000|0.000/0.000/0.000|' || format('{{:.3f}}', value) || '/600.000|False|0.000'
        WHEN 'purchase' THEN 'STA+|' || {_SQL_ID} || '|' || k || '|55|001F|' || format('{{:.3f}}', value) || '|' || {_SQL_USER}
        ELSE 'MOVE|' || {_SQL_ID} || '|0.000/0.000/' || format('{{:.3f}}', value) || '|90.000' END FROM e)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id, n) AS line_no, {_SQL_STAMP} || t AS line FROM l"""


@query("log_convert", _SQL_LINES)
def log_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from text to bytes and back: the lines are those that were written first."""
    text, raw, back = (scratch(spark, n) for n in ("text", "binary", "text"))
    oplog.write_logs(_latest(spark, sf_dir), text, "text")
    oplog.convert(spark, text, raw, "binary")
    oplog.convert(spark, raw, back, "text")
    order = Window.partitionBy("replay_id").orderBy("op_seq")
    return oplog.read_text(spark, back).select(_user().alias("user_id"), F.row_number().over(order).cast("long").alias("line_no"), "line")


@query(
    "log_problems",
    f"""WITH {E}, a AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS before FROM e WHERE event_type IN ('signup', 'error')),
    p AS (SELECT user_id, CASE WHEN event_type = 'click' AND k = 1 THEN 'unknown tag' WHEN event_type = 'view' AND k = 2 THEN 'fields are not as they should be' WHEN event_type = 'signup' AND before = 'signup' THEN 'made while it is there' END AS problem FROM e LEFT JOIN a USING (event_id))
    SELECT user_id, problem, count(*) AS n FROM p GROUP BY ALL""",
)
def log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the records of each log, and how many can be used."""
    e = ops(spark, sf_dir)
    own = F.hex("k")
    parts = _either(_exact() | {"signup": ["ACT+", own, *_exact()["signup"][2:]], "error": ["ACT-", own]})
    parts = F.when((F.col("event_type") == "click") & (F.col("k") == 1), F.array(F.lit("ZZZZ"), own)).otherwise(parts)
    parts = F.when((F.col("event_type") == "view") & (F.col("k") == 2), F.array(F.lit("HP  "), own, F.lit("1/2"))).otherwise(parts)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    told = e.select(_log_name().alias("replay_id"), order.alias("op_seq"), F.col("us").alias("ts_us"), F.lit(31).alias("version"), F.element_at(parts, 1).alias("tag"), F.slice(parts, 2, 99).alias("fields"))
    good, bad = oplog.sorted_out(told, whole_logs=False)
    both = good.select("replay_id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("replay_id", "problem"))
    return both.groupBy(_user().alias("user_id"), "problem").agg(F.count("*").alias("n"))


@query(
    "replay_tables",
    f"""WITH {E}, w AS (SELECT *, max(us) OVER (PARTITION BY user_id) AS over, CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 2 END AS slot,
        min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY user_id, k ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone,
        least(1, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id, k ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) AS epoch FROM e),
    c AS (SELECT *, 'status' AS channel, event_type = 'click' AS opens FROM w WHERE event_type IN ('click', 'purchase') UNION ALL SELECT *, 'life', event_type = 'signup' FROM w WHERE event_type IN ('signup', 'error') UNION ALL SELECT *, 'points', TRUE FROM w WHERE event_type IN ('signup', 'view')),
    n AS (SELECT *, lead(us) OVER (PARTITION BY user_id, k, channel, slot ORDER BY us, event_id) AS next FROM c)
    SELECT user_id, channel, k AS instance, slot, epoch, event_id, us AS start_us, coalesce(least(next, gone), over) AS end_us FROM n WHERE opens AND (channel <> 'points' OR next IS NULL OR next > us)""",
)
def replay_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives, statuses and points of the entities of each log: three of the tables that one pass over its records writes."""
    own, slot = F.hex("k"), (F.col("event_id") % 2).cast("string")
    parts = _either(
        {"signup": ["ACT+", own, *_exact()["signup"][2:]], "error": ["ACT-", own], "click": ["STA+", own, slot, _number(F.col("k")), "001F", "1.000", own], "purchase": ["STA-", own, slot], "view": ["HP  ", own, _number(F.col("value")), "900", "0", "0", "10000"]}
    )
    e = ops(spark, sf_dir)
    told = e.select(_log_name().alias("replay_id"), F.col("event_id").alias("op_seq"), F.col("us").alias("ts_us"), F.element_at(parts, 1).alias("tag"), F.slice(parts, 2, 99).alias("fields"))
    tables = replay.Tables.write(told, f"{scratch(spark, 'replay')}/tables")
    out = None
    for channel in ("life", "status", "points"):
        part = tables.rows(channel).select(_user().alias("user_id"), F.lit(channel).alias("channel"), F.col("instance").cast("long").alias("instance"), F.col("slot").cast("long").alias("slot"), "epoch", F.col("op_seq").alias("event_id"), "start_us", "end_us")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "states_many",
    f"""WITH {E}, b AS (SELECT min(us) AS lo, max(us) AS hi FROM e), m AS (SELECT lo + (hi - lo) // 20 * i AS moment FROM b, (SELECT unnest(range(21)) AS i))
    SELECT moment, user_id, event_type, value FROM m JOIN e ON us <= moment QUALIFY row_number() OVER (PARTITION BY moment, user_id, event_type ORDER BY us DESC, event_id DESC) = 1""",
)
def states_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at 21 moments, from eight snapshots and the changes since each."""
    low, high = log_bounds(spark, sf_dir)
    every = max((high - low) // 7, 1)
    e = ops(spark, sf_dir).withColumn("t", F.col("us") - low)
    path = f"{scratch(spark, 'states')}/snapshots"
    snapshots(e, ["user_id", "event_type"], "t", "event_id", ["value"], every, high - low).write.partitionBy("snapshot").parquet(path)
    moments = spark.range(21).select((F.lit((high - low) // 20) * F.col("id")).alias("moment"))
    found = states_at(moments, "moment", spark.read.parquet(path).withColumn("snapshot", F.col("snapshot").cast("long")), e, ["user_id", "event_type"], "t", "event_id", ["value"], every)
    return found.withColumn("moment", F.col("moment") + low)
