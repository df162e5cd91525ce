"""State graphs as rows: states with their durations, and their successors, of which a state may have several.

Both operators go through the graph a step at a time: a step is one aggregation by state of the rows that reached it, so forks that meet
again go on as one, and one equi-join with the edges. The edges are dealt by state once, for all steps; a step shuffles only the rows
of the one before. Each step is written, which cuts its lineage. A path has no more states than its machine; a graph that goes on
beyond that has a cycle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.sources.tables import scratch


class Cycle(ValueError):
    """The states of a machine lead back to one of them."""


def _steps(first: DataFrame, edges: DataFrame, on: list[str], step, most: int) -> DataFrame:
    """The rows of all steps, from `first` until there are none; step(rows, edges) gives those of the next."""
    spark = first.sparkSession
    path = scratch(spark, "steps")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = edges.repartition(parts, *on).sortWithinPartitions(*on).persist(StorageLevel.DISK_ONLY)
    try:
        now = first
        for n in range(most + 1):
            now.write.parquet(f"{path}/step={n}")
            now = spark.read.schema(first.schema).parquet(f"{path}/step={n}")
            if now.isEmpty():
                return spark.read.schema(first.schema).parquet(path)
            now = step(now, kept)
    finally:
        kept.unpersist()
    raise Cycle(f"a state is reached after {most} others of its machine")


def _most(states: DataFrame, machine: str) -> int:
    return states.groupBy(machine).count().agg(F.max("count")).first()[0] or 0


def flattened(states: DataFrame, successors: DataFrame, machine: str = "machine", state: str = "state") -> DataFrame:
    """(machine, state, n_paths, earliest, latest): in how many ways each state is reached from its machine's start, and when at the earliest and the latest.

    states: machine, state, `duration` and `start`, whether the machine begins there; successors: machine, state and the `next` one.
    """
    went = successors.join(states.select(machine, state, "duration"), [machine, state])
    zero = F.lit(0).cast(states.schema["duration"].dataType)
    first = states.where("start").select(machine, state, F.lit(1).cast("long").alias("n_paths"), zero.alias("earliest"), zero.alias("latest"))
    told = [F.sum("n_paths").cast("long").alias("n_paths"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest")]

    def step(now: DataFrame, went: DataFrame) -> DataFrame:
        gone = now.groupBy(machine, state).agg(*told).join(went, [machine, state])
        return gone.select(machine, F.col("next").alias(state), "n_paths", *((F.col(c) + F.col("duration")).cast(first.schema[c].dataType).alias(c) for c in ("earliest", "latest")))

    return _steps(first, went, [machine, state], step, _most(states, machine)).groupBy(machine, state).agg(*told)


def time_to_flag(states: DataFrame, successors: DataFrame, machine: str = "machine", state: str = "state") -> DataFrame:
    """(machine, state, left): the least time from the beginning of a state to that of a flagged one; states that lead to none are left out.

    states: machine, state, `duration` and `flag`. The flagged ones are gone back from.
    """
    first = states.where("flag").select(machine, state, F.lit(0).cast(states.schema["duration"].dataType).alias("left"))
    back = successors.join(states.where("not flag").select(machine, state, "duration"), [machine, state]).select(machine, F.col(state).alias("_from"), F.col("next").alias(state), "duration")

    def step(now: DataFrame, back: DataFrame) -> DataFrame:
        gone = now.groupBy(machine, state).agg(F.min("left").alias("left")).join(back, [machine, state])
        return gone.select(machine, F.col("_from").alias(state), (F.col("left") + F.col("duration")).cast(first.schema["left"].dataType).alias("left"))

    return _steps(first, back, [machine, state], step, _most(states, machine)).groupBy(machine, state).agg(F.min("left").alias("left"))


def aligned(states: DataFrame, successors: DataFrame, seen: DataFrame, machine: str = "machine", state: str = "state") -> DataFrame:
    """(machine, state, earliest, visited): `flattened` with the durations observed: visited states take theirs, unvisited ones none.

    seen: machine, state and the duration `took`. A state that several ways lead to begins when the last of them is over.
    """
    told = states.join(seen.select(machine, state, "took"), [machine, state], "left").withColumn("visited", F.col("took").isNotNull())
    took = F.coalesce("took", F.lit(0)).cast(states.schema["duration"].dataType)
    found = flattened(told.withColumn("duration", took), successors, machine, state).select(machine, state, F.col("latest").alias("enters"))
    return found.join(told.select(machine, state, "visited"), [machine, state])
