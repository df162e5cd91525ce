"""The fold of an entity's records on a stream, with timers: what nobody ends ends by itself, also where an entity falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "replay_id string, instance long, slot int, status long, start_us long, end_us long, how string"


def use_state_store(spark: SparkSession) -> None:
    """State by key and timers need the store that keeps its state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Statuses(StatefulProcessor):
    """The open statuses of one entity, by slot: status, start and end. A timer stands at each end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "slot int", "status long, start_us long, until_us long")

    def _closed(self, key: tuple, slot: int, end_us: int, how: str) -> tuple:
        status, start, until = self._open.getValue((slot,))
        self._open.removeKey((slot,))
        return (key[0], int(key[1]), int(slot), int(status), int(start), int(min(end_us, until)), "expired" if until <= end_us else how)

    def _expired(self, key: tuple, now_us: int) -> list[tuple]:
        over = sorted((v[2], k[0]) for k, v in list(self._open.iterator()) if v[2] <= now_us)
        return [self._closed(key, slot, until, "expired") for until, slot in over]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows)).sort_values(["ts_us", "op_seq"], kind="stable")
        out: list[tuple] = []
        for r in told.itertuples(index=False):
            now = int(r.ts_us)
            out += self._expired(key, now)
            if r.tag == "ACT-":
                out += [self._closed(key, k[0], now, "destroyed") for k, _ in sorted(self._open.iterator())]
                continue
            slot = int(r.slot)
            if self._open.containsKey((slot,)):
                out.append(self._closed(key, slot, now, "replaced" if r.tag == "STA+" else "removed"))
            if r.tag == "STA+":
                until = now + round(float(r.remaining_s) * 1e6)
                self._open.updateValue((slot,), (int(r.status), now, until))
                self._handle.registerTimer(-(-until // 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._expired(key, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def statuses(records: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(replay_id, instance, slot, status, start_us, end_us, how) of a stream of (replay_id, instance, ts, ts_us, op_seq, tag, slot, status, remaining_s).

    A status ends when its slot is written to or cleared, with its entity, or after the time it has: as soon as the watermark, `late` behind the
    newest `ts` of all entities, has passed that, whether or not its own entity is heard of again. An entity's rows come in order over batches.
    """
    own = records.withWatermark("ts", late).groupBy("replay_id", "instance")
    return own.transformWithStateInPandas(statefulProcessor=_Statuses(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def statuses_of(records: DataFrame) -> DataFrame:
    """The same of a whole table: intervals closed by the next write to the slot, the entity's end or their time, whichever is first; open ones are left out."""
    own = Window.partitionBy("replay_id", "instance")
    ordered = own.orderBy("ts_us", "op_seq")
    ahead = ordered.rowsBetween(1, Window.unboundedFollowing)
    told = records.withColumn("_gone", F.min(F.when(F.col("tag") == "ACT-", F.struct("ts_us", "op_seq"))).over(ahead))
    slots = Window.partitionBy("replay_id", "instance", "slot").orderBy("ts_us", "op_seq")
    writes = told.where("tag in ('STA+', 'STA-')").withColumn("_next", F.lead(F.struct("ts_us", "op_seq")).over(slots)).withColumn("_by", F.lead("tag").over(slots))
    until = F.col("ts_us") + F.round(F.col("remaining_s") * 1e6).cast("long")
    first = F.least("_next", "_gone")
    how = F.when(first.isNull() | (until <= first["ts_us"]), "expired").when(first.eqNullSafe(F.col("_gone")), "destroyed").when(F.col("_by") == "STA+", "replaced").otherwise("removed")
    return writes.where("tag = 'STA+'").select("replay_id", "instance", "slot", "status", F.col("ts_us").alias("start_us"), F.least(until, first["ts_us"]).alias("end_us"), how.alias("how"))
