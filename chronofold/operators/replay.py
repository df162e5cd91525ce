"""From the records of logs to participants, their intervals and their actions.

records: (replay_id, op_seq, ts_us, tag, fields), as `oplog.parse` gives them. All order is that of (ts_us, op_seq), and
each table carries replay_id. What is open when its entity is destroyed ends there, else at the end of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.operators.temporal import fifo_match
from chronofold.sources.records import payload, typed, upgraded

_ORDER = ("ts_us", "op_seq")


def _entity(records: DataFrame, *tags: str) -> DataFrame:
    """(replay_id, instance, ts_us, op_seq, tag) of records that begin with an entity."""
    parts = [typed(records, t).select("replay_id", "instance", "ts_us", "op_seq", F.lit(t).alias("tag")) for t in tags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ends(records: DataFrame) -> DataFrame:
    return records.groupBy("replay_id").agg(F.max("ts_us").alias("log_end"))


def _later(column: Column, *by: str) -> Column:
    """The next value of `column` after a row, NULLs passed over; read from the end, where a frame grows row by row."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in _ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(column, ignorenulls=True).over(w)


def existence(records: DataFrame) -> DataFrame:
    """(replay_id, instance, epoch, start_us, end_us, oid, type, owner): when an entity was there.

    An id that comes back with another identity, or after the zone has changed since it went, is another
    participant: the next epoch. With the same identity it is one participant with several ranges.
    """
    made = typed(records, "ACT+").select("replay_id", "instance", "ts_us", "op_seq", F.lit("ACT+").alias("tag"), "oid", "type", "owner")
    gone = _entity(records, "ACT-").withColumns({c: F.lit(None).cast("decimal(20,0)") for c in ("oid", "type", "owner")})
    zones = records.where("tag = 'ZONE'").select("replay_id", F.lit(None).cast("decimal(20,0)").alias("instance"), "ts_us", "op_seq", "tag")
    zones = zones.withColumns({c: F.lit(None).cast("decimal(20,0)") for c in ("oid", "type", "owner")})
    log = Window.partitionBy("replay_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = made.unionByName(gone).unionByName(zones).withColumn("zone", F.count_if(F.col("tag") == "ZONE").over(log)).where("tag <> 'ZONE'")
    own = Window.partitionBy("replay_id", "instance").orderBy(*_ORDER)
    born = F.col("tag") == "ACT+"
    before = F.last(F.when(born, F.struct("oid", "type", "owner")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    left = F.last(F.when(~born, F.col("zone")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = born & (before.isNull() | ~F.struct("oid", "type", "owner").eqNullSafe(before) | (F.coalesce(left, F.col("zone")) < F.col("zone")))
    told = events.withColumn("new", new).withColumn("end", F.lead("ts_us").over(own))
    told = told.withColumn("epoch", F.count_if("new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(born)
    return told.join(_ends(records), "replay_id").select("replay_id", "instance", "epoch", F.col("ts_us").alias("start_us"), F.coalesce("end", "log_end").alias("end_us"), "oid", "type", "owner")


def participants(records: DataFrame) -> DataFrame:
    """(replay_id, instance, epoch, oid, type, owner, first_us, last_us, n_ranges)."""
    return existence(records).groupBy("replay_id", "instance", "epoch", "oid", "type", "owner").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count("*").alias("n_ranges"))


def _until(opened: DataFrame, closing: DataFrame, records: DataFrame, *slot: str) -> DataFrame:
    """`opened` with end_us: the next opening or closing of its slot, the end of its entity or the end of the log."""
    key = ["replay_id", "instance", *slot]
    mark = lambda d, kind: d.select("replay_id", "instance", *(F.col(c) if c in d.columns else F.lit(None).cast("long").alias(c) for c in slot), "ts_us", "op_seq", F.lit(kind).alias("kind"))
    writes = mark(opened, "open").unionByName(mark(closing, "close"))
    ends = writes.withColumn("next", F.lead("ts_us").over(Window.partitionBy(*key).orderBy(*_ORDER)))
    both = ends.unionByName(mark(_entity(records, "ACT-"), "gone").withColumn("next", F.lit(None).cast("long")))
    both = both.withColumn("gone", _later(F.when(F.col("kind") == "gone", F.col("ts_us")), "replay_id", "instance")).where("kind = 'open'")
    found = opened.join(both.select("replay_id", "op_seq", F.least("next", "gone").alias("stop")), ["replay_id", "op_seq"]).join(_ends(records), "replay_id")
    return found.withColumn("end_us", F.coalesce("stop", "log_end")).drop("stop", "log_end").withColumnRenamed("ts_us", "start_us")


def statuses(records: DataFrame) -> DataFrame:
    """An interval for each status that is put into a slot; a refresh closes one and opens another."""
    return _until(typed(records, "STA+"), typed(records, "STA-"), records, "slot")


def casts(records: DataFrame) -> DataFrame:
    """An interval for each cast."""
    return _until(typed(records, "CST+"), typed(records, "CST-"), records)


def tethers(records: DataFrame) -> DataFrame:
    """An interval for each tether; number 0 ends the one before."""
    every = typed(records, "TETH")
    return _until(every.where("tether <> 0"), every.where("tether = 0"), records)


def hp_history(records: DataFrame) -> DataFrame:
    """(replay_id, instance, ts_us, hp, max_hp): of several values at one time the last record's."""
    return typed(records, "HP  ").groupBy("replay_id", "instance", "ts_us").agg(F.max_by(F.struct("hp", "max_hp"), "op_seq").alias("v")).select("replay_id", "instance", "ts_us", "v.*")


def confirmations(records: DataFrame) -> DataFrame:
    """(replay_id, op_seq, global_sequence, target_index, target, confirmed_us): each target of each action.

    A target confirms by the action's sequence and its own place among the targets; the first one counts, others are dropped.
    """
    acts = typed(records, "CST!").select("replay_id", "op_seq", "global_sequence", F.posexplode("targets").alias("target_index", "t")).select("replay_id", "op_seq", "global_sequence", F.col("target_index").cast("long").alias("target_index"), "t.target")
    told = typed(records, "ER  ").select("replay_id", F.col("instance").alias("target"), "global_sequence", "target_index", F.col("op_seq").alias("told_seq"), F.col("ts_us").alias("told_us"))
    hits = acts.join(told, ["replay_id", "target", "global_sequence", "target_index"], "left")
    later = F.col("told_seq") > F.col("op_seq")
    return hits.groupBy("replay_id", "op_seq", "global_sequence", "target_index", "target").agg(F.min_by(F.when(later, F.col("told_us")), F.when(later, F.col("told_seq"))).alias("confirmed_us"))


def encounters(records: DataFrame, oids: list[int]) -> DataFrame:
    """(replay_id, instance, number, start_us, end_us): fights of entities with one of the `oids`, from entering combat
    to leaving it, dying or going."""
    bosses = existence(records).where(F.col("oid").isin(oids)).select("replay_id", "instance").distinct()
    marks = _entity(records, "COM+", "COM-", "DIE+", "ACT-").join(bosses, ["replay_id", "instance"])
    own = Window.partitionBy("replay_id", "instance").orderBy(*_ORDER)
    turns = marks.withColumn("on", F.col("tag") == "COM+").withColumn("was", F.coalesce(F.lag("on").over(own), F.lit(False))).where("on <> was").withColumn("end", F.lead("ts_us").over(own))
    fights = turns.where("on").withColumn("number", F.row_number().over(own).cast("long")).join(_ends(records), "replay_id")
    return fights.select("replay_id", "instance", "number", F.col("ts_us").alias("start_us"), F.coalesce("end", "log_end").alias("end_us"))


# All tables from one pass

#: The channels that a record writes to, and the field that tells the slot there. What opens in a slot lasts until the next write to it.
_OPENS = {
    "life": {"ACT+": None}, "name": {"ACT+": None, "NAME": None}, "targetable": {"ACT+": None, "ATG+": None, "ATG-": None}, "ally": {"ACT+": None, "ALLY": None}, "dead": {"DIE+": None, "DIE-": None},
    "position": {"ACT+": None, "MOVE": None}, "points": {"ACT+": None, "HP  ": None}, "size": {"ACT+": None, "ACSZ": None}, "status": {"STA+": 1}, "cast": {"CST+": None}, "tether": {"TETH": None},
    "animation": {"EANM": None}, "event_state": {"EVTS": None}, "timeline": {"PATE": None}, "action": {"CST!": None}, "icon": {"ICON": None}, "confirmation": {"ER  ": None}, "combat": {"COM+": None},
}
_CLOSES = {"life": {"ACT-": None}, "status": {"STA-": 1}, "cast": {"CST-": None}, "combat": {"COM-": None, "DIE+": None}}
#: Of several values at one time the last one counts.
_HISTORIES = ("name", "targetable", "ally", "dead", "position", "points", "size", "animation", "event_state", "timeline")
#: Records that a task of `build` is to have.
PART_ROWS = 1 << 16
#: Records of no entity, one table each.
_OF_LOG = {"zone": "ZONE", "marker": "UMRK", "director": "DIRU", "map_effect": "ENVC", "message": "SLOG", "request": "CLAR", "reject": "CLRJ", "party": "PAR "}


def _marks() -> Column:
    """What each record writes: (channel, slot, opens)."""
    by_tag: dict[str, list[Column]] = {}
    mark = lambda channel, slot, opens: F.struct(F.lit(channel).alias("channel"), (F.get("fields", F.lit(slot)) if slot else F.lit(None)).try_cast("int").alias("slot"), opens.alias("opens"))
    for told, opens in ((_OPENS, True), (_CLOSES, False)):
        for channel, tags in told.items():
            for tag, slot in tags.items():
                # A tether of number 0 is the end of one.
                by_tag.setdefault(tag, []).append(mark(channel, slot, F.get("fields", F.lit(1)) != "0" if channel == "tether" else F.lit(opens)))
    for channel, tag in _OF_LOG.items():
        by_tag.setdefault(tag, []).append(mark(channel, None, F.lit(True)))
    out = F.lit(None)
    for tag, marks in by_tag.items():
        out = F.when(F.col("tag") == tag, F.array(*marks)).otherwise(out)
    return out


def build(records: DataFrame) -> DataFrame:
    """All tables of all logs, as rows of one: (replay_id, channel, instance, slot, epoch, start_us, end_us, op_seq, tag, fields).

    channel names the table. The records are shuffled once, by entity, and sorted there; what an entity's records write to each
    channel and slot ends with the next write, with the entity or with the log. epoch tells participants with one id apart, see
    `existence`. Records of no entity are dealt by their place in the log and end where they start. `Tables` reads one channel typed.
    """
    now = upgraded(records) if "version" in records.columns else records
    heads = now.groupBy("replay_id").agg(F.max("ts_us").alias("log_end"), F.sort_array(F.collect_list(F.when(F.col("tag") == "ZONE", F.struct("ts_us", "op_seq")))).alias("zones"))
    entity = _OF_LOG.values()
    first = F.split_part(F.get("fields", F.lit(0)), F.lit("/"), F.lit(1))
    id_ = F.when(~F.col("tag").isin(*entity), F.conv(first, 16, 10).try_cast("decimal(20,0)"))
    tags = {t for told in (*_OPENS.values(), *_CLOSES.values()) for t in told} | set(entity)
    rows = now.where(F.col("tag").isin(*sorted(tags)))
    # As many parts as the rows ask for: what a task sorts does not grow with the logs.
    parts = max(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS + 1)
    rows = rows.select("replay_id", "op_seq", "ts_us", "tag", "fields", id_.alias("instance"), F.when(id_.isNull(), F.col("op_seq")).alias("_place"))
    rows = rows.join(heads, "replay_id").repartition(parts, "replay_id", "instance", "_place")
    own = Window.partitionBy("replay_id", "instance", "_place").orderBy(*_ORDER)
    past, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    born, gone = F.col("tag") == "ACT+", F.col("tag") == "ACT-"
    identity = F.struct(F.get("fields", F.lit(1)), F.get("fields", F.lit(6)), F.get("fields", F.lit(18)))
    before, left = F.last(F.when(born, identity), ignorenulls=True).over(past), F.last(F.when(gone, F.struct("ts_us", "op_seq")), ignorenulls=True).over(past)
    moved = F.exists("zones", lambda z: (z > F.col("_left")) & (z < F.struct("ts_us", "op_seq")))
    told = rows.withColumn("_before", before).withColumn("_left", left)
    told = told.withColumn("_new", born & (F.col("_before").isNull() | ~identity.eqNullSafe(F.col("_before")) | F.coalesce(moved, F.lit(False))))
    told = told.withColumn("epoch", F.count_if("_new").over(so_far)).withColumn("_gone", _later(F.when(gone, F.col("ts_us")), "replay_id", "instance", "_place"))
    each = told.select("replay_id", "instance", "_place", "epoch", "op_seq", "ts_us", "tag", "fields", "log_end", "_gone", F.explode(_marks()).alias("mark")).select("*", "mark.*").drop("mark")
    slots = Window.partitionBy("replay_id", "instance", "_place", "channel", "slot").orderBy(*_ORDER)
    each = each.withColumn("_next", F.lead("ts_us").over(slots)).where("opens")
    lasting = ~F.col("channel").isin("action", "icon", "confirmation", *_OF_LOG)
    last_of_time = ~F.col("channel").isin(*_HISTORIES) | F.col("_next").isNull() | (F.col("_next") > F.col("ts_us"))
    end = F.when(lasting, F.coalesce(F.least("_next", "_gone"), "log_end")).otherwise(F.col("ts_us"))
    return each.where(last_of_time).select("replay_id", "channel", "instance", "slot", "epoch", F.col("ts_us").alias("start_us"), end.alias("end_us"), "op_seq", "tag", "fields")


class Tables:
    """The tables of `build`, written once, a folder for each channel."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    @classmethod
    def write(cls, records: DataFrame, path: str) -> Tables:
        build(records).write.partitionBy("channel").parquet(path)
        return cls(records.sparkSession, path)

    def rows(self, channel: str) -> DataFrame:
        """The untyped rows of a channel; no other channel's files are read."""
        return self._spark.read.parquet(self._path).where(F.col("channel") == channel)

    def read(self, channel: str) -> DataFrame:
        """The rows of a channel with their typed fields; a history has those that all its records have."""
        tags = [_OF_LOG[channel]] if channel in _OF_LOG else list(_OPENS[channel])
        rest = ["replay_id", "instance", "slot", "epoch", "start_us", "end_us", "op_seq"]
        parts = []
        for tag in tags:
            own = self.rows(channel).where(F.col("tag") == tag)
            typed_ = own.select(*(F.col(c).alias(f"_{c}") for c in rest), "fields").select(*(f"_{c}" for c in rest), *payload(tag))
            typed_ = typed_.withColumn("on", F.lit(tag[3] == "+")) if channel in ("dead", "targetable") and "on" not in typed_.columns and tag != "ACT+" else typed_
            typed_ = typed_.withColumn("on", F.col("targetable")) if channel == "targetable" and tag == "ACT+" else typed_
            parts.append(typed_.drop(*(c for c in rest if c in typed_.columns)).withColumnsRenamed({f"_{c}": c for c in rest}))
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        out = parts[0].select(*shared)
        for p in parts[1:]:
            out = out.unionByName(p.select(*shared))
        return out


def client_actions(records: DataFrame) -> DataFrame:
    """(replay_id, op_seq, sequence, kind, id, requested_us, rejected_us, action_us): what the log's own player asked for, and what came of it.

    A request is made before it is told: by what its cast has already taken, or by the missing part of half a second. Rejects and actions answer the
    first open request of their sequence, rejects of sequence 0 the first of their action that nothing else has answered.
    The player is the entity in slot 0 of the party.
    """
    asked, refused, done = (typed(records, t) for t in ("CLAR", "CLRJ", "CST!"))
    lock = F.col("lock_s")
    early = F.when(F.col("cast.total") > 0, F.col("cast.elapsed")).when((lock >= 0.4) & (lock < 0.5), 0.5 - lock).otherwise(0.0)
    player = typed(records, "PAR ").where("slot = 0").select("replay_id", F.col("instance").alias("player")).distinct()
    kind = lambda k: F.lit(k).alias("what")
    same = ["replay_id", "op_seq", "ts_us", F.col("action.kind").alias("kind"), F.col("action.id").alias("id")]
    requests = asked.select(*same, "sequence", kind("request"), (F.col("ts_us") - F.round(early * 1e6).cast("long")).alias("requested_us"))
    rejects = refused.select(*same, "sequence", kind("reject"))
    actions = done.join(player, (done["replay_id"] == player["replay_id"]) & (done["instance"] == player["player"]), "left_semi").select(*same, F.col("source_sequence").alias("sequence"), kind("action"))
    answers = rejects.unionByName(actions)
    by_sequence = fifo_match(requests.unionByName(answers.where("sequence <> 0"), allowMissingColumns=True), ["replay_id", "sequence"], ["ts_us", "op_seq"], F.col("what") == "request", ["what", "ts_us"], "answer")
    open_ = by_sequence.where("answer is null").drop("answer")
    by_action = fifo_match(open_.unionByName(rejects.where("sequence = 0"), allowMissingColumns=True), ["replay_id", "kind", "id"], ["ts_us", "op_seq"], F.col("what") == "request", ["what", "ts_us"], "answer")
    told = by_sequence.where("answer is not null").unionByName(by_action)
    at = lambda k: F.when(F.col("answer.what") == k, F.col("answer.ts_us"))
    return told.select("replay_id", "op_seq", "sequence", "kind", "id", "requested_us", at("reject").alias("rejected_us"), at("action").alias("action_us"))
