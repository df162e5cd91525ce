"""Grouped analyses over ordered logs; each is a function DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds, to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def transitions(events: DataFrame, entity: str, state: str, ts: str, seq: str) -> DataFrame:
    """One row per pair of consecutive states of an entity, with the time spent in the first."""
    w = Window.partitionBy(entity).orderBy(ts, seq)
    return (
        events.select(entity, ts, seq, F.col(state).alias("from_state"))
        .withColumn("to_state", F.lead("from_state").over(w))
        .withColumn("dur", seconds_between(F.lead(ts).over(w), F.col(ts)))
        .where(F.col("to_state").isNotNull())
    )


def transition_timings(events: DataFrame, entity: str, state: str, ts: str, seq: str) -> DataFrame:
    """Count, least, greatest, mean and sample deviation of the time in a state, by transition.

    The deviation of a single instance is NULL.
    """
    return (
        transitions(events, entity, state, ts, seq)
        .groupBy("from_state", "to_state")
        .agg(
            F.count("*").alias("n"),
            F.min("dur").alias("min_s"),
            F.max("dur").alias("max_s"),
            F.avg("dur").alias("avg_s"),
            F.stddev_samp("dur").alias("sd_s"),
        )
    )


def nearest_alike(points: DataFrame, key: str, by: str, x: str, z: str) -> DataFrame:
    """(key, distance) of each point that has another one with the same `by`: how far the nearest of those is.

    Searched on a grid for each `by`, at first with about one point a cell. Where the nearest in a cell and the eight
    around it is within a cell's width, none is nearer; other points go on with cells three times as wide, until a cell
    holds all. A cell in which many distinct points crowd makes pairs of them; equal points are one place.
    """
    spots = points.where(f"{by} IS NOT NULL AND {x} IS NOT NULL AND {z} IS NOT NULL").groupBy(by, x, z).agg(F.count("*").alias("_n"))
    size = spots.groupBy(by).agg(F.min(x).alias("_x0"), F.min(z).alias("_z0"), F.greatest(F.max(x) - F.min(x), F.max(z) - F.min(z)).alias("_wide"), F.count("*").alias("_spots"))
    spots = spots.join(size, by).select(by, x, z, "_n", "_x0", "_z0", "_wide", (F.col("_wide") / F.ceil(F.sqrt("_spots"))).alias("_cell")).persist()
    found = spots.where("_n > 1").select(by, x, z, F.lit(0.0).alias("distance"))
    left = spots.where("_n = 1 AND _wide > 0")
    factor = 1
    while not left.isEmpty():
        cell = F.col("_cell") * factor
        at = lambda c, c0, cell=cell: F.floor((F.col(c) - F.col(c0)) / cell)
        others = spots.where("_wide > 0").select(by, F.col(x).alias("_ox"), F.col(z).alias("_oz"), at(x, "_x0").alias("_cx"), at(z, "_z0").alias("_cz"))
        near = F.explode(F.array(*(F.struct((at(x, "_x0") + i).alias("_cx"), (at(z, "_z0") + j).alias("_cz")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        mine = left.withColumn("_near", near).select(*left.columns, "_near.*")
        dx, dz = F.col(x) - F.col("_ox"), F.col(z) - F.col("_oz")
        pairs = mine.join(others, [by, "_cx", "_cz"], "left").withColumn("_d", F.when((dx != 0) | (dz != 0), F.sqrt(dx * dx + dz * dz)))
        best = pairs.groupBy(*left.columns).agg(F.min("_d").alias("distance")).persist()
        #: A cell's width, less what rounding can move a point across its edge; cells wider than all hold every point.
        sure = F.coalesce((F.col("distance") <= cell * (1 - 1e-9)) | (cell > F.col("_wide") * (1 + 1e-9)), F.lit(False))
        found = found.unionByName(best.where(sure).select(by, x, z, "distance"))
        left = best.where(~sure).drop("distance")
        factor *= 3
    return points.join(found, [by, x, z]).select(key, "distance")
