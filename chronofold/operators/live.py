"""Actions against everyone who is there: from the tables of `replay.build`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.replay import Tables
from chronofold.operators.temporal import as_of, interval_join

#: Types of entities that count as players.
PLAYERS = (0x104, 0x209, 0x203)
_MODES = ("source", "target", "toward")
_HOUR = 3_600_000_000


def alive_at(tables: Tables, moments: DataFrame, ts: str, bucket: int = _HOUR, types: tuple[int, ...] = PLAYERS) -> DataFrame:
    """`moments` (replay_id, ts and more), each with every `player` who is there at that time and not dead."""
    lives = tables.read("life").where(F.col("type").isin(*types)).select("replay_id", F.col("instance").alias("player"), F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    there = interval_join(moments, lives, ["replay_id"], ts, "_from", "_to", bucket).drop("_from", "_to").dropDuplicates()
    dead = tables.read("dead").select("replay_id", F.col("instance").alias("player"), F.col("start_us").alias(ts), "op_seq", F.col("on").alias("_dead"))
    return as_of(there, dead, ["replay_id", "player"], ts, ["_dead"], "op_seq").where(~F.coalesce("_dead", F.lit(False))).drop("_dead")


def placed(tables: Tables, rows: DataFrame, who: str, ts: str, name: str) -> DataFrame:
    """`rows` with `name`: position and rotation of the entity `who` at the time `ts`, NULL where it has none."""
    history = tables.read("position").select("replay_id", F.col("instance").alias(who), F.col("start_us").alias(ts), "op_seq", F.struct("position.x", "position.z", "rotation").alias(name))
    return as_of(rows, history, ["replay_id", who], ts, [name], "op_seq")


def cones(tables: Tables, bucket: int = _HOUR) -> DataFrame:
    """(replay_id, op_seq, player, mode, angle, range, hit): where every player stood as each action happened, as seen from its origin.

    The angle is in degrees from the action's direction, positive to the left of it. mode: source, from the source along its rotation; target, from the
    action's place along the source's rotation; toward, from the source towards that place. Source and place are those of the latest cast of the
    same action that began before it, or else the source's position then and the main target's, or the place told where there is none.
    An action upon its own source aims at its first target. Distances of zero have no angle.
    """
    acts = tables.read("action").select("replay_id", "op_seq", F.col("start_us").alias("ts_us"), F.col("instance").alias("source"), F.col("target").alias("main"), F.col("action.kind").alias("kind"), F.col("action.id").alias("id"), F.struct("position.x", "position.z").alias("told"), F.transform("targets", lambda t: t["target"]).alias("hits"))
    casts = tables.read("cast").select("replay_id", F.col("instance").alias("source"), F.col("action.kind").alias("kind"), F.col("action.id").alias("id"), F.col("start_us").alias("ts_us"), F.col("op_seq").alias("seq"), F.struct("location.x", "location.z", "rotation").alias("cast"))
    acts = as_of(acts, casts, ["replay_id", "source", "kind", "id"], "ts_us", ["cast"], "seq", strict=True)
    acts = acts.withColumn("first", F.get("hits", F.lit(0)))
    for who, name in (("source", "of_source"), ("main", "of_main"), ("first", "of_first")):
        acts = placed(tables, acts, who, "ts_us", name)
    xz = lambda c: F.struct(F.col(c)["x"].alias("x"), F.col(c)["z"].alias("z"))
    either = lambda *c: F.coalesce(*(F.when(F.col(x).isNotNull(), xz(x)) for x in c))
    acts = acts.withColumn("at", either("cast", "of_source")).withColumn("facing", F.coalesce("cast.rotation", "of_source.rotation")).withColumn("place", either("cast", "of_main", "told"))
    acts = acts.withColumn("place", F.when(F.col("place").eqNullSafe(F.col("at")) & F.col("of_first").isNotNull(), xz("of_first")).otherwise(F.col("place")))
    acts = acts.select("replay_id", "op_seq", "ts_us", "hits", "at", "facing", "place")
    seen = placed(tables, alive_at(tables, acts, "ts_us", bucket), "player", "ts_us", "stands")
    ahead = F.struct(F.sin("facing").alias("x"), F.cos("facing").alias("z"))
    aim = F.struct((F.col("place.x") - F.col("at.x")).alias("x"), (F.col("place.z") - F.col("at.z")).alias("z"))

    def view(mode: str, origin: str, way: Column) -> Column:
        tx, tz = F.col("stands.x") - F.col(origin)["x"], F.col("stands.z") - F.col(origin)["z"]
        left, along = tx * way["z"] - tz * way["x"], tx * way["x"] + tz * way["z"]
        range_ = F.sqrt(tx * tx + tz * tz)
        angle = F.when((range_ > 0) & ((way["x"] != 0) | (way["z"] != 0)), F.degrees(F.atan2(left, along)))
        return F.struct(F.lit(mode).alias("mode"), angle.alias("angle"), range_.alias("range"))

    views = F.array(view(_MODES[0], "at", ahead), view(_MODES[1], "place", ahead), view(_MODES[2], "at", aim))
    told = seen.select("replay_id", "op_seq", "player", F.explode(views).alias("v"), F.array_contains("hits", F.col("player")).alias("hit"))
    return told.select("replay_id", "op_seq", "player", "v.*", "hit")
