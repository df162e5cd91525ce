"""Streams give what the batch gives, however the log is cut into files."""

from chronofold.plans import fixtures
from chronofold.streaming import stateful

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, name, make):
    e = fixtures.ops(spark, SF).where("user_id < 5").select("user_id", "event_id", "event_type", "us")
    all_rows = sorted(e.collect(), key=lambda r: (r["us"], r["event_id"]))
    src = tmp_path / name
    for i in range(3):
        part = all_rows[i * len(all_rows) // 3 : (i + 1) * len(all_rows) // 3]
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return all_rows, spark.table(name).collect()


def test_transitions(spark, tmp_path):
    log, got = _stream(spark, tmp_path, "transitions", stateful.transitions)
    want, last = [], {}
    for r in log:
        if r["user_id"] in last:
            p = last[r["user_id"]]
            want.append((r["user_id"], p["event_id"], p["event_type"], r["event_type"], r["us"] - p["us"]))
        last[r["user_id"]] = r
    assert sorted(map(tuple, got)) == sorted(want)


def test_pending(spark, tmp_path):
    ttl = 6 * fixtures.HOUR
    log, got = _stream(spark, tmp_path, "pending", lambda s: stateful.pending(s, "purchase", "click", ttl))
    want = set()
    for i, r in enumerate(log):
        if r["event_type"] != "purchase":
            continue
        later = [x for x in log[i + 1 :] if x["user_id"] == r["user_id"]]
        hit = next((x for x in later if x["event_type"] == "click"), None)
        if hit is not None and hit["us"] <= r["us"] + ttl:
            want.add((r["user_id"], r["event_id"], r["us"], hit["us"], True))
        elif any(x["us"] > r["us"] + ttl for x in later):
            want.add((r["user_id"], r["event_id"], r["us"], r["us"] + ttl, False))
    assert set(map(tuple, got)) == want


def test_statuses_end_by_themselves(spark, tmp_path):
    """However the log is cut into files the stream gives what the whole table gives; entities that fall silent are no exception."""
    import random

    from pyspark.sql import functions as F

    from chronofold.streaming import entities

    rnd = random.Random(6)
    rows = []
    for i in range(300):
        t = 1_700_000_000_000_000 + i * 700_000 + rnd.randrange(300_000)
        who = rnd.randrange(6)
        if who == 5 and i > 40:
            continue
        tag = rnd.choices(["STA+", "STA-", "ACT-"], [6, 2, 1])[0]
        rows.append((f"log{who % 2}", who, t, i, tag, None if tag == "ACT-" else rnd.randrange(3), rnd.randrange(50) if tag == "STA+" else None, float(rnd.choice([0.5, 3.25, 9.0, 60.0])) if tag == "STA+" else None))
    schema = "replay_id string, instance long, ts_us long, op_seq long, tag string, slot int, status long, remaining_s double"
    src = tmp_path / "ops"
    end = max(r[2] for r in rows) + 200_000_000
    # The last file only moves the clock on: another log's entity is heard of much later.
    parts = [rows[:90], rows[90:180], rows[180:], [("clock", 99, end, 10**6, "ACT-", None, None, None)], [("clock", 99, end + 1, 10**6 + 1, "ACT-", None, None, None)]]
    for p in parts:
        spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(src))
    entities.use_state_store(spark)
    try:
        stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = entities.statuses(stream).writeStream.format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = {tuple(r) for r in spark.table("statuses").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {tuple(r) for r in entities.statuses_of(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and {h for *_, h in want} == {"expired", "replaced", "removed", "destroyed"}
    assert any(r[1] == 5 and r[6] == "expired" for r in got)
