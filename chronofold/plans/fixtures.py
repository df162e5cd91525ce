"""How the tables stand in for logs: events are operations, ordered by (ts, event_id) within a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.time import instant, micros
from chronofold.sources.tables import table

#: The same reading of `events` in DuckDB, for the oracles.
E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
#: Slots written by signup, click and view, each open until the next write to it or the end of the log.
S = """w AS (SELECT user_id, k % 4 AS slot, event_type AS status, event_id, us AS start_us FROM e WHERE event_type IN ('signup', 'click', 'view')),
s AS (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY user_id, slot ORDER BY start_us, event_id), (SELECT max(us) FROM e)) AS end_us FROM w)"""

HOUR = 3_600_000_000
DAY = 24 * HOUR


def ops(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(event_id, user_id, event_type, value, us, k); of the times from `first` to `last` alone, which the scan then skips by."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp_ntz")
    if first is not None:
        e = e.where(at >= instant(first))
    if last is not None:
        e = e.where(at <= instant(last))
    return e.select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def of_type(e: DataFrame, *types: str) -> DataFrame:
    return e.where(F.col("event_type").isin(*types))


def log_bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Times of the first and the last operation, from one column; zeros where there is none."""
    found = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(micros("a"), micros("b")).first()
    return found[0] or 0, found[1] or 0


def log_end(e: DataFrame) -> int:
    """Time of the last operation: one number."""
    return e.agg(F.max("us")).first()[0] or 0


def statuses(e: DataFrame) -> DataFrame:
    """(user_id, slot, status, event_id, start_us, end_us)."""
    from chronofold.operators.temporal import slot_intervals

    w = of_type(e, "signup", "click", "view").select("user_id", (F.col("k") % 4).alias("slot"), F.col("event_type").alias("status"), "event_id", "us")
    return slot_intervals(w, ["user_id", "slot"], "us", "event_id", F.lit(log_end(e))).drop("us")
