"""Hand-made logs as files, read, decoded and built into tables."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import fsm, replay
from chronofold.sources import oplog, records

T0 = 1_700_000_000


def stamp(t):
    import datetime

    return datetime.datetime.fromtimestamp(T0 + t, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S") + ".0000000Z"


def make(i, oid, kind="0101", owner="0"):
    return f"ACT+|{i:X}|{oid:X}|3|0|some name|7|{kind}|WAR|90|1.5/2/-3|90|0.500|100|200|0|50|60|True|False|{owner}|0|0"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Reads (seconds, record) rows back from one file, in their order."""

    def write(rows):
        path = tmp_path_factory.mktemp("logs")
        (path / "one.log").write_text("# made by hand\n\n" + "\n".join(f"{stamp(t)}|{r}" for t, r in rows) + "\nno record\n")
        return oplog.parse(oplog.read_lines(spark, str(path))).cache()

    return write


def at(df, *cols):
    """Rows with times as seconds from the start."""
    return sorted(tuple((r[c] // 1_000_000 - T0) if c.endswith("_us") and r[c] is not None else (int(r[c]) if c == "instance" else r[c]) for c in cols) for r in df.collect())


def test_every_layout_is_read(spark):
    assert len(records.TAGS) == len(set(records.TAGS)) and all(len(t) == 4 for t in records.TAGS)
    none = spark.createDataFrame([], "replay_id string, op_seq long, ts_us long, tag string, fields array<string>")
    for tag in records.TAGS:
        assert records.typed(none, tag).count() == 0, tag


def test_typed_fields(log):
    r = log([(0, make(0xE0000001FFFFFFFF, 0x2A)), (1, "CST+|10/2A/boss/Enemy|Spell 123|20|1/2/3|0.5/4.5|True|180"), (2, "CST!|10|Spell 9|20|0.60|8|1/2/3|7|5|0|20!1F!0!FFFFFFFFFFFFFFFF|21"), (3, "STA+|10|2|55 some status|1F|12.5|20"), (4, "HP  |10|x|200")])
    a = records.typed(r, "ACT+").first()
    assert (int(a.instance), int(a.oid), a.name, int(a.type), a.level, a.position.z, a.targetable, a.ally) == (0xE0000001FFFFFFFF, 42, "some name", 0x101, 90, -3.0, True, False)
    c = records.typed(r, "CST+").first()
    assert (int(c.instance), c.action.kind, c.action.id, c.time.elapsed, c.time.total, c.interruptible) == (16, "Spell", 123, 0.5, 4.5, True) and c.rotation == pytest.approx(3.14159265)
    e = records.typed(r, "CST!").first()
    assert (e.global_sequence, e.source_sequence, [int(t.target) for t in e.targets], [int(x) for x in e.targets[0].effects], e.targets[1].effects) == (7, 5, [32, 33], [31, 0, (1 << 64) - 1], [])
    s = records.typed(r, "STA+").first()
    assert (s.slot, s.status, s.extra, s.remaining_s, int(s.source)) == (2, 55, 31, 12.5, 32)
    h = records.typed(r, "HP  ").first()
    assert (h.hp, h.max_hp, h.shield) == (None, 200, None)


def test_order_of_a_tie(log):
    r = log([(1, "HP  |A|10|100"), (1, "HP  |A|20|100"), (2, "HP  |A|30|100")])
    assert at(replay.hp_history(r), "ts_us", "hp") == [(1, 20), (2, 30)]


def test_statuses_and_casts(log):
    r = log([(0, make(10, 1)), (1, "STA+|A|0|5|0|1|B"), (3, "STA+|A|0|5|0|1|B"), (4, "STA+|A|1|6|0|1|B"), (5, "CST+|A|Spell 1|B|0/0/0|0/9|False|0"), (7, "ACT-|A"), (8, "STA+|C|0|5|0|1|B"), (9, "STA+|D|0|5|0|1|B"), (10, "STA-|D|0"), (11, "TETH|C|3|D"), (12, "TETH|C|0|0"), (13, "UMRK|end")])
    assert at(replay.statuses(r), "instance", "slot", "start_us", "end_us") == [(10, 0, 1, 3), (10, 0, 3, 7), (10, 1, 4, 7), (12, 0, 8, 13), (13, 0, 9, 10)]
    assert at(replay.casts(r), "instance", "start_us", "end_us") == [(10, 5, 7)]
    assert at(replay.tethers(r), "instance", "start_us", "end_us") == [(12, 11, 12)]


def test_participants(log):
    r = log([(0, "ZONE|1|1"), (1, make(1, 5)), (2, "ACT-|1"), (3, make(1, 5)), (4, "ACT-|1"), (5, make(1, 6)), (6, "ACT-|1"), (7, "ZONE|2|2"), (8, make(1, 6)), (9, make(2, 7)), (10, "ACT-|2"), (11, "UMRK|end")])
    assert at(replay.existence(r), "instance", "epoch", "start_us", "end_us") == [(1, 1, 1, 2), (1, 1, 3, 4), (1, 2, 5, 6), (1, 3, 8, 11), (2, 1, 9, 10)]
    assert at(replay.participants(r).withColumn("oid", F.col("oid").cast("int")), "instance", "epoch", "oid", "n_ranges") == [(1, 1, 5, 2), (1, 2, 6, 1), (1, 3, 6, 1), (2, 1, 7, 1)]


def test_confirmations(log):
    r = log([(1, "CST!|A|Spell 1|B|0|8|0/0/0|7|0|0|B!1|C!2"), (2, "ER  |C|7|1"), (3, "ER  |C|7|1"), (3, "ER  |C|7|5"), (3, "ER  |C|9|0"), (4, "ER  |D|7|0")])
    assert at(replay.confirmations(r), "target_index", "confirmed_us") == [(0, None), (1, 2)]


def test_encounters(log):
    r = log([(0, make(1, 5)), (1, "COM+|1"), (2, "COM+|2"), (4, "COM-|1"), (5, "COM+|1"), (6, "COM+|1"), (8, "DIE+|1"), (9, "COM-|1"), (10, "COM+|1"), (12, "UMRK|end")])
    assert at(replay.encounters(r, [5]), "number", "start_us", "end_us") == [(1, 1, 4), (2, 5, 8), (3, 10, 12)]


def test_files_of_several_splits(spark, tmp_path):
    """Lines keep their order where a file is read in splits, in whatever partitions these come."""
    lines = [f"{stamp(i // 100)}|UMRK|number {i} " + "x" * 60 for i in range(60_000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = oplog.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 2
        assert [r.line for r in df.orderBy("op_seq").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_folds_without_values_elsewhere():
    from types import SimpleNamespace as R

    h = fsm.HOUR
    v = lambda t, x: R(us=t * h, event_id=t, value=x)
    assert list(fsm.moving_average(iter([v(0, 10.0), v(12, 20.0), v(60, 0.0)]))) == [(0, 10.0), (12, 15.0), (60, 0.0)]
    q = lambda i, e, k: R(event_id=i, event_type=e, k=k, us=i)
    asked = [q(1, "click", 1), q(2, "click", 1), q(3, "click", 2), q(4, "purchase", 2), q(5, "purchase", 2), q(6, "purchase", 9), q(7, "purchase", 1)]
    assert list(fsm.check_protocol(iter(asked))) == [(2, "repeated request"), (4, "overtakes 2"), (5, "answered twice"), (6, "unexpected answer"), (2, "never answered")]
    seen = [q(1, "view", 0), q(2, "signup", 3), q(3, "click", 3), q(4, "click", 4), q(5, "error", 4), q(6, "signup", 1), q(7, "view", 1)]
    assert list(fsm.sessions(iter(seen))) == [(1, 2, 5, 2, 2), (2, 6, 7, 0, 1)]


def test_a_fold_keeps_order_and_keys_apart(spark):
    rows = spark.createDataFrame([(u, t, float(t * 30)) for u in range(20) for t in reversed(range(40))], "u int, event_id long, value double")
    got = fsm.fold(rows, ["u"], ["event_id"], fsm.changes_beyond, "u int, event_id long, value double").collect()
    assert sorted(got) == [(u, t, t * 30.0) for u in range(20) for t in range(40)]


def test_tables_of_one_pass(spark, log, tmp_path):
    """Each table is what the plain functions give, from one shuffle of the records."""
    r = log([
        (0, "ZONE|1|1"), (0, make(10, 1)), (1, "STA+|A|0|5|0|1|B"), (3, "STA+|A|0|5|0|1|B"), (4, "STA+|A|1|6|0|1|B"), (5, "CST+|A|Spell 1|B|0/0/0|0/9|False|0"), (5, "HP  |A|90|200"), (5, "HP  |A|80|200"), (6, "COM+|A"), (6, "NAME|A|other|0"), (7, "ACT-|A"),
        (7, "DIRU|1|2|3|4|5|6"), (8, "STA+|C|0|5|0|1|B"), (8, make(10, 1)), (9, "ACT-|A"), (9, "ZONE|2|2"), (9, make(10, 1)), (9, "STA+|D|0|5|0|1|B"), (10, "STA-|D|0"), (11, "TETH|C|3|D"), (12, "TETH|C|0|0"), (12, "DIE+|A"), (13, "UMRK|end"),
    ])
    t = replay.Tables.write(r, str(tmp_path / "tables"))
    ids = lambda df: df.withColumn("instance", F.col("instance").cast("int"))
    assert at(t.read("status"), "instance", "slot", "start_us", "end_us") == at(replay.statuses(r), "instance", "slot", "start_us", "end_us")
    assert at(t.read("cast"), "instance", "start_us", "end_us") == at(replay.casts(r), "instance", "start_us", "end_us")
    assert at(t.read("tether"), "instance", "start_us", "end_us") == at(replay.tethers(r), "instance", "start_us", "end_us")
    assert at(t.read("life"), "instance", "epoch", "start_us", "end_us") == at(replay.existence(r), "instance", "epoch", "start_us", "end_us") == [(10, 1, 0, 7), (10, 1, 8, 9), (10, 2, 9, 13)]
    assert at(t.read("points").where("hp <> 100"), "start_us", "end_us", "hp") == [(5, 7, 80)]
    assert at(t.read("name"), "epoch", "start_us", "end_us", "name") == [(1, 0, 6, "some name"), (1, 6, 7, "other"), (1, 8, 9, "some name"), (2, 9, 13, "some name")]
    assert at(t.read("dead"), "instance", "start_us", "on") == [(10, 12, True)]
    assert at(t.read("combat"), "start_us", "end_us") == [(6, 7)]
    assert at(t.read("targetable"), "start_us", "end_us", "on") == [(0, 7, True), (8, 9, True), (9, 13, True)]
    assert [int(x.update) for x in t.read("director").collect()] == [2] and t.read("zone").count() == 2 and ids(t.read("action")).count() == 0
    plan = replay.build(r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(replay_id#") <= 4


def test_client_actions(log):
    ask = lambda seq, lock="0.1", cast="0/0", what="Spell 1": f"CLAR|{what}|B|0/0/0|{seq}|{lock}|{cast}|0/0"
    r = log([
        (0, "PAR |0|1|A|False"), (1, ask(1)), (2, ask(2, "0.4")), (3, ask(3, "0.1", "0.5/2.5")), (4, "CLRJ|Spell 1|2|0/0|579"), (5, "CST!|A|Spell 1|B|0|8|0/0/0|7|1|0"), (5, "CST!|C|Spell 1|B|0|8|0/0/0|7|3|0"), (6, "CLRJ|Spell 1|0|0/0|579"), (7, "CLRJ|Spell 1|9|0/0|1"), (8, ask(4, what="Item 5")),
    ])
    got = {x.sequence: tuple(None if v is None else v / 1e6 - T0 for v in (x.requested_us, x.rejected_us, x.action_us)) for x in replay.client_actions(r).collect()}
    assert {k: tuple(None if v is None else round(v, 3) for v in x) for k, x in got.items()} == {1: (1, None, 5), 2: (1.9, 4, None), 3: (2.5, 6, None), 4: (8, None, None)}


def test_cones(spark, log, tmp_path):
    """A player ahead, one to the left, one who is dead and one who is gone; an action with a cast, one without, one upon its source."""
    from chronofold.operators import live

    def place(i, x, z, deg=0, kind="0104"):
        return f"ACT+|{i:X}|{i:X}|3|0|name|7|{kind}|WAR|90|{x}/0/{z}|{deg}|0.500|100|200|0|50|60|10000|True|False|0|0|0"

    r = log([
        (0, place(1, 0, 0, 90, "0205")), (0, place(2, 10, 0)), (0, place(3, 0, 10)), (0, place(4, 5, 5)), (0, place(5, 1, 1)), (0, place(6, 1, 1, 0, "0700")), (1, "DIE+|4"), (2, "ACT-|5"), (3, "MOVE|3|0/0/20|0"),
        (4, "CST!|1|Spell 1|3|0|8|0/0/0|7|0|0|2!1"), (5, "CST+|1|Spell 2|3|0/0/10|0/2|False|0"), (6, "CST!|1|Spell 2|3|0|8|0/0/0|8|0|0"), (7, "CST!|1|Spell 3|1|0|8|0/0/0|9|0|0|3!1"),
    ])
    t = replay.Tables.write(r, str(tmp_path / "tables"))
    got = {}
    seqs = [x.op_seq for x in r.where("tag = 'CST!'").orderBy("op_seq").collect()]
    for x in live.cones(t).collect():
        got[seqs.index(x.op_seq), int(x.player), x.mode] = (x.angle if x.angle is None else round(x.angle, 6) + 0.0, round(x.range, 6), x.hit)
    assert {k[1] for k in got} == {2, 3} and len(got) == 18
    # The source looks along x; the place is that of the main target at (0, 20).
    assert got[0, 2, "source"] == (0.0, 10.0, True) and got[0, 3, "source"] == (-90.0, 20.0, False)
    assert got[0, 2, "toward"] == (90.0, 10.0, True) and got[0, 3, "toward"] == (0.0, 20.0, False)
    assert got[0, 3, "target"] == (None, 0.0, False) and got[0, 2, "target"][1] == round(500**0.5, 6)
    # The cast was at (0, 10) looking along z, and that is source and place.
    assert got[1, 3, "source"] == (0.0, 10.0, False) and got[1, 3, "target"] == (0.0, 10.0, False) and got[1, 3, "toward"] == (None, 10.0, False)
    # Upon itself: towards its first target.
    assert got[2, 3, "toward"] == (0.0, 20.0, True)


def test_parts_grow_with_the_records(spark, monkeypatch):
    """What a task sorts is bounded by the records of a part, not by the size of all logs."""
    rows = [("log", i, i, "HP  ", [f"{i % 50:X}", str(i), "900", "0", "0", "10000"]) for i in range(400)]
    records = spark.createDataFrame(rows, "replay_id string, op_seq long, ts_us long, tag string, fields array<string>")
    monkeypatch.setattr(replay, "PART_ROWS", 20)
    found = replay.build(records)
    assert found.rdd.getNumPartitions() == 21
    assert found.count() == 400
