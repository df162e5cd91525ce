"""State-transition timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import analysis
from chronofold.plans.registry import query
from chronofold.sources.tables import table


@query(
    "transition_timings",
    """
    WITH s AS (
      SELECT user_id, event_type AS from_state,
             lead(event_type) OVER w AS to_state,
             (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS dur
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT from_state, to_state, count(*) AS n, round(min(dur), 3) AS min_s, round(max(dur), 3) AS max_s,
           round(avg(dur), 3) AS avg_s, round(stddev_samp(dur), 3) AS sd_s
    FROM s WHERE to_state IS NOT NULL GROUP BY 1, 2
    """,
)
def transition_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.transition_timings(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    return t.select("from_state", "to_state", "n", *(F.round(c, 3).alias(c) for c in ("min_s", "max_s", "avg_s", "sd_s")))
