"""Profiles: what is known of each kind of thing over many logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_text(values: Column | str, sep: str = "/") -> Column:
    """Aggregate: the sorted distinct values as text, `none` where there are none."""
    c = F.col(values) if isinstance(values, str) else values
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), sep), F.lit("")), F.lit("none"))


def profile(rows: DataFrame, by: Sequence[str], sets: Mapping[str, Column] = {}, any_of: Mapping[str, Column] = {}, low: Mapping[str, Column] = {}, high: Mapping[str, Column] = {}, last: Mapping[str, Column] = {}, order: Sequence[str] = ()) -> DataFrame:
    """One row per key: counts, sets as text, flags, extremes and last values, in one aggregation."""
    aggs = [F.count("*").alias("n")]
    aggs += [set_text(c).alias(n) for n, c in sets.items()]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in any_of.items()]
    aggs += [F.min(c).alias(n) for n, c in low.items()] + [F.max(c).alias(n) for n, c in high.items()]
    aggs += [F.max_by(c, F.struct(*order)).alias(n) for n, c in last.items()]
    return rows.groupBy(*by).agg(*aggs)


def transition_outliers(transitions: DataFrame) -> DataFrame:
    """Instances that last unlike the others of their transition: further than one sample deviation from the mean.

    Means and deviations are aggregated first and joined to the instances, so no task has to hold a transition's rows;
    where they are few, which is checked by their size, they are broadcast.
    """
    usual = transitions.groupBy(F.col("from_state").alias("_from"), F.col("to_state").alias("_to")).agg(F.avg("dur").alias("avg_s"), F.stddev_samp("dur").alias("sd_s"))
    same = F.col("from_state").eqNullSafe(F.col("_from")) & F.col("to_state").eqNullSafe(F.col("_to"))
    return transitions.join(usual, same).where(F.abs(F.col("dur") - F.col("avg_s")) > F.col("sd_s")).drop("_from", "_to")


def histogram(rows: DataFrame, by: Sequence[str], value: Column, scale: float = 1000.0) -> DataFrame:
    """Counts by key and value, rounded half to even."""
    return rows.groupBy(*by, F.bround(value * scale).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def mask(bit: Column | str) -> Column:
    """Aggregate: the set of bits 0 to 63; others are no members."""
    c = F.col(bit) if isinstance(bit, str) else bit
    one = F.when(c.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int")))
    return F.coalesce(F.bit_or(one), F.lit(0).cast("long"))


def deviations(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Number, mean, population deviation and the key of the least value."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.min_by(key, F.struct(value, key)).alias("lowest"))


def top_ties(rows: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """All rows that share the greatest value of their key."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(order.desc()))).where("_r = 1").drop("_r")
