"""Hand-made logs for what the tables don't have: ties, refreshes, open ends, closed ranges, bad lines."""

import os
from itertools import pairwise
from types import SimpleNamespace as R

import pytest
from pyspark.sql import functions as F

from chronofold.functions import codec, geometry
from chronofold.operators import analysis, fsm, profiles, temporal
from chronofold.sources import oplog


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_later_seq_wins_a_tie(spark):
    left = spark.createDataFrame([(1, 10, 7)], "u int, t long, id int")
    right = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 11, 3, "c")], "u int, t long, seq int, v string")
    assert rows(temporal.as_of(left, right, ["u"], "t", ["v"], "seq"), "id", "v") == [(7, "b")]
    assert rows(temporal.as_of(left, right, ["u"], "t", ["v"], "seq", strict=True), "id", "v") == [(7, None)]
    assert rows(temporal.as_of(left, right, ["u"], "t", ["v"], "seq", direction="forward"), "id", "v") == [(7, "a")]
    assert rows(temporal.as_of(left, right, ["u"], "t", ["v"], "seq", direction="forward", strict=True), "id", "v") == [(7, "c")]


def test_refresh_splits_and_open_ends_with_the_log(spark):
    w = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 15, 2)], "u int, slot int, t long, seq int")
    assert rows(temporal.slot_intervals(w, ["u", "slot"], "t", "seq", F.lit(99)), "start_us", "end_us") == [(10, 15), (15, 99)]


def test_destruction_closes(spark):
    i = spark.createDataFrame([(1, 10, 50), (1, 30, 40), (2, 10, 50)], "u int, s long, e long")
    d = spark.createDataFrame([(1, 35)], "u int, gone long")
    assert rows(temporal.closed_by(i, d, ["u"], "s", "e", "gone"), "u", "s", "e") == [(1, 10, 35), (1, 30, 35), (2, 10, 50)]


def test_ranges_are_closed(spark):
    p = spark.createDataFrame([(1, 10), (1, 20), (1, 21)], "u int, t long")
    i = spark.createDataFrame([(1, 10, 20)], "u int, s long, e long")
    assert rows(temporal.interval_join(p, i, ["u"], "t", "s", "e", 7), "t") == [(10,), (20,)]
    assert rows(temporal.interval_join(p, i, ["u"], "t", "s", "e", 7, "left_anti"), "t") == [(21,)]


def test_single_instance_has_no_deviation(spark):
    e = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 5, 2)], "u int, s string, t int, seq int").withColumn("t", F.timestamp_seconds("t"))
    assert [r["sd_s"] for r in analysis.transition_timings(e, "u", "s", "t", "seq").collect()] == [None]


def test_interval_union_is_disjoint_and_merges_touching(spark):
    i = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 1, 2), (1, 9, 10)], "u int, s long, e long")
    got = rows(temporal.interval_union(i, ["u"], "s", "e"), "s", "e", "n_merged")
    assert got == [(0, 7, 3), (9, 10, 1)]
    assert all(a[1] < b[0] for a, b in pairwise(got))


def test_state_is_the_fold_of_the_prefix(spark):
    log = [(1, t, t, t * 3 % 7) for t in range(20)]
    df = spark.createDataFrame(log, "u int, t long, seq long, v long")
    for at in (0, 7, 19):
        assert rows(temporal.state_at(df, ["u"], "t", "seq", F.lit(at), ["v"]), "v") == [([x for x in log if x[1] <= at][-1][3],)]


def test_same_identity_continues_other_begins(spark):
    df = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b"), (1, 4, 4, "a")], "u int, t long, seq long, oid string")
    assert [r[1] for r in rows(temporal.change_epochs(df, ["u"], F.col("oid"), "t", "seq"), "t", "epoch")] == [1, 1, 2, 3]


def test_parse_skips_what_is_no_record(spark):
    lines = ["", "# x|HP  |1", "2024-01-01T00:00:00.1234567Z|HP  |1|2", "2024-01-01T00:00:00Z|TOOLONG|1", "alone", "2024-01-01T00:00:01Z|ZZZZ|"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = oplog.parse(df).collect()
    assert [(r["ts_us"], r["tag"], r["fields"]) for r in got] == [(1704067200123456, "HP  ", ["1", "2"]), (1704067201000000, "ZZZZ", [""])]
    with pytest.raises(Exception, match="unknown tag"):
        oplog.parse(df, known=["HP  "], mode="FAILFAST").collect()


def test_emit_then_parse_is_the_identity(spark):
    df = spark.createDataFrame([(1, 255, "a b"), (2, 0, None)], "i int, n long, t string").withColumn("ts", F.lit("2024-05-06 07:08:09.101112").cast("timestamp_ntz"))
    p = oplog.parse(oplog.emit(df, F.col("ts"), F.lit("HP"), [F.hex("n"), F.col("t")]))
    assert [(r["tag"], *r["fields"]) for r in p.orderBy("i").collect()] == [("HP  ", "FF", "a b"), ("HP  ", "0", "")]


def test_read_lines_keeps_the_order_of_a_file(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.log").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("no")
    assert rows(oplog.read_lines(spark, str(tmp_path)), "replay_id", "op_seq", "line") == [("deep/a.log", 0, "x"), ("deep/a.log", 1, "y")]


def test_unsigned_hex(spark):
    df = spark.createDataFrame([("FFFFFFFFFFFFFFFF",), ("zz",)], "h string")
    assert [r[0] for r in df.select(codec.from_hex(F.col("h"))).collect()] == [18446744073709551615, None]


def test_mask_ignores_what_is_out_of_range(spark):
    df = spark.createDataFrame([(0,), (63,), (64,), (-1,)], "b int")
    assert df.agg(profiles.mask("b")).first()[0] == 1 - (1 << 63)


def test_wrapped_angles(spark):
    for a, want in ((3.5, 3.5 - 6.283185307179586), (-3.5, 6.283185307179586 - 3.5), (3.141592653589793, 3.141592653589793)):
        assert spark.range(1).select(geometry.wrap(F.lit(a))).first()[0] == pytest.approx(want)


def test_folds():
    assert list(fsm.distinct_names(iter([R(name=n, p_partkey=i) for i, n in enumerate(["a", "a", "a1", "a"])]))) == [(0, "a"), (1, "a1"), (2, "a11"), (3, "a2")]
    assert [v for _, v in fsm.changes_beyond(iter([R(event_id=i, value=v) for i, v in enumerate([0, 15, 25, 30, 50])]))] == [0, 25, 50]
    h = fsm.HOUR
    ev = lambda t, e: R(us=t * h, event_type=e, event_id=t)
    assert [x[1:] for x in fsm.run_machine(iter([ev(0, "signup"), ev(1, "click"), ev(2, "purchase"), ev(100, "view")]))] == [("idle", "ready", "signup"), ("ready", "busy", "click"), ("busy", "done", "purchase"), ("done", "idle", "timeout")]
    assert [round(c) for _, c, _ in fsm.simulate_charges(iter([R(us=0, event_id=i) for i in range(4)]))] == [2, 1, 0, 0]
    q = lambda i, e, k: R(event_id=i, event_type=e, k=k)
    assert list(fsm.match_requests(iter([q(1, "click", 3), q(2, "click", 11), q(3, "purchase", 3), q(4, "error", 3), q(5, "click", 0)]))) == [(2, 3, "confirmed"), (1, 4, "rejected"), (5, None, "open")]
    square = [R(x=float(x), z=float(z)) for x in range(3) for z in range(3)]
    assert {(x, z) for _, x, z in fsm.thinned_hull(iter(square))} == {(0, 0), (0, 2), (2, 0), (2, 2)}


def test_pick_in_time(spark):
    """What is kept for later sets a bound; what can start at once and fits is taken; conditions count last for what waits."""
    entry = lambda i, p, delay, duration=0.0, usable=True, cast=0.0: (i, float(p), delay, duration, usable, cast, 2.0)
    cases = [
        ([entry(1, 9, 0.0), entry(2, 8, 0.0)], (1, 0.0)),
        ([entry(1, 9, 1.0), entry(2, 8, 0.0, 0.6)], (2, 0.0)),
        ([entry(1, 9, 1.0), entry(2, 8, 0.0, 1.1)], (1, 1.0)),
        ([entry(1, 9, 1.0), entry(2, 8, 0.5, 0.4), entry(3, 7, 0.0, 0.6)], (2, 0.5)),
        ([entry(1, 9, 1.0, usable=False), entry(2, 8, 0.0, 2.0)], None),
        ([entry(1, 9, 0.0, usable=False), entry(2, 8, 0.0, cast=3.0), entry(3, 7, 0.0)], (3, 0.0)),
        ([entry(1, 9, 1.0), entry(2, 8, 0.5, 0.9), entry(3, 7, 0.0, 0.8)], (3, 0.0)),
        ([entry(1, 9, 2.0), entry(2, 8, 1.0, 0.5, usable=False)], None),
        ([entry(1, -1, 0.0)], None),
    ]
    rows = [(q, -e[1], *e) for q, (entries, _) in enumerate(cases) for e in entries]
    df = spark.createDataFrame(rows, "queue long, behind double, entry long, priority double, delay double, duration double, usable boolean, cast double, longest double")
    got = {r.queue: (r.entry, r.start_s) for r in fsm.pick_in_time(df, "queue", ["behind"]).collect()}
    assert got == {q: want for q, (_, want) in enumerate(cases) if want}


def test_folds_without_windows():
    """Averages move by the share of a day; answers are held against the queue; sessions end with an error."""
    h = fsm.HOUR
    assert list(fsm.moving_average(iter([R(event_id=i, us=t * h, value=v) for i, (t, v) in enumerate([(0, 10.0), (12, 20.0), (60, 0.0)])]))) == [(0, 10.0), (1, 15.0), (2, 0.0)]
    q = lambda i, e, k: R(event_id=i, us=i, event_type=e, k=k)
    asked = [q(1, "click", 1), q(2, "click", 2), q(3, "click", 1), q(4, "purchase", 2), q(5, "purchase", 2), q(6, "purchase", 9), q(7, "purchase", 1)]
    assert list(fsm.check_protocol(iter(asked))) == [(3, "repeated request"), (4, "overtakes 1"), (5, "answered twice"), (6, "unexpected answer"), (3, "never answered")]
    log = [q(1, "click", 1), q(2, "signup", 1), q(3, "click", 2), q(4, "signup", 2), q(5, "error", 3), q(6, "error", 4), q(7, "signup", 5), q(8, "view", 5)]
    assert list(fsm.sessions(iter(log))) == [(1, 2, 5, 1, 3), (2, 7, 8, 0, 1)]


def test_request_audit():
    """Rejections by sequence or by action, answers out of order, late or to another, casts with and without requests."""
    row = lambda i, kind, seq=0, action=0, us=0: R(event_id=i, kind=kind, seq=seq, action=action, us=us)
    audit = lambda *rows: [w for _, w in fsm.audit_requests(iter(rows))]
    ask = row(1, "ask", 3, 7)
    assert audit(ask, row(2, "answer", 3, 7)) == []
    assert audit(ask, row(2, "answer", 3, 8)) == ["answer to another"]
    assert audit(ask, row(2, "answer", 3, 7, us=48 * fsm.HOUR)) == ["answer too late"]
    assert audit(ask, row(2, "ask", 4, 8), row(3, "answer", 4, 8), row(4, "answer", 3, 7)) == ["ask while 1 wait", "answer out of order", "answer of none"]
    assert audit(ask, row(2, "reject", 3, 7), ask, row(3, "reject", 0, 7), ask, row(4, "reject", 5, 7), row(5, "answer", 3, 7)) == ["reject", "reject of another", "reject of none", "answer of none"]
    assert audit(row(1, "start", 0, 7), row(2, "start", 0, 7), row(3, "stop")) == ["start of none", "start of none, start during a cast", "stop of none"]
    assert audit(ask, row(2, "start", 0, 8), row(3, "reset"), row(4, "stop")) == ["start of another"]
    assert audit(ask, row(2, "start", 0, 7), row(3, "ask", 4, 8), row(4, "answer", 4, 8)) == []
    assert audit(ask, row(2, "start", 0, 7), row(3, "stop"), row(4, "answer", 3, 7)) == ["answer of none"]


def test_alive_cross_of_every_action(spark):
    """Every purchase has its row, not those with one k alone; equal to pairs of all with all."""
    from chronofold.plans.fixtures import of_type, ops, statuses
    from chronofold.plans.registry import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    e = ops(spark, sf)
    spans = [tuple(r) for r in statuses(e).where("slot = 0").select("start_us", "end_us", "user_id").collect()]
    want = {}
    for r in of_type(e, "purchase").collect():
        alive = [u for s, t, u in spans if s <= r["us"] <= t]
        if alive:
            want[r["event_id"]] = (len(alive), min(alive))
    got = {r["action"]: (r["n_alive"], r["lowest"]) for r in queries()["alive_cross"](spark, sf).collect()}
    assert got == want and len(got) > 50


def test_covering_edges(spark):
    points = spark.createDataFrame([(i, t) for i, t in enumerate(range(-9, 10))] + [(99, 1 << 40)], "id long, t long")
    spans = [(-5, -5, 3), (-4, 3, 2), (0, 0, 9), (2, 8, 1), (7, 6, 0), (5, (1 << 40) + 3, 7), (5, 1 << 40, 8)]
    got = {r["id"]: (r["n"], r["lowest"]) for r in temporal.covering(points, spark.createDataFrame(spans, "s long, e long, u long"), "id", "t", "s", "e", "u").collect()}
    at = lambda t: [u for s, e, u in spans if s <= t <= e]
    assert got == {i: (len(at(t)), min(at(t))) for i, t in [tuple(r) for r in points.collect()] if at(t)}


def test_nearest_peer_among_all(spark):
    """The nearest of all of the same label, also in another block of ids; crowds, equal places and far points as well."""
    from chronofold.plans.q_functions import points
    from chronofold.plans.registry import queries

    def brute(rows):
        out = {}
        for i, label, x, z in rows:
            d = [((x - a) ** 2 + (z - b) ** 2) ** 0.5 for j, m, a, b in rows if m == label and j != i]
            if d:
                out[i] = round(min(d), 6)
        return out

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in points(spark, sf).select("vec_id", "label", "x", "z").collect()]
    got = {r["vec_id"]: r["distance"] for r in queries()["nearest_peer"](spark, sf).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)
    odd = [(i, 1, i * 0.001, (i * i % 7) * 0.001) for i in range(60)] + [(100, 1, 1e6, 3.0), (101, 1, 1e6, 9.0), (102, 1, -5e5, 0.0), (103, 2, 0.0, 0.0), (104, 3, 1.0, 1.0), (105, 3, 1.0, 1.0), (106, 3, 4.0, 5.0)]
    got = {r["id"]: round(r["distance"], 6) for r in analysis.nearest_alike(spark.createDataFrame(odd, "id long, label long, x double, z double"), "id", "label", "x", "z").collect()}
    want = brute(odd)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_arcs_allowed_and_next(spark):
    """Allowed arcs with a cushion, and the next one, as in the reference's list of arcs; all rows take part."""
    from math import pi

    from chronofold.plans.registry import queries

    arcs = [(1, -pi, -3.0), (1, -1.0, 0.0), (1, 0.05, 0.5), (1, 3.0, pi), (2, -1.0, 1.0)]
    forbidden = spark.createDataFrame([(*a, 0.1) for a in arcs], "label long, lo double, hi double, cushion double")
    allowed = {(r.label, round(r.lo, 6), round(r.hi, 6)) for r in fsm.allowed_arcs(forbidden, "label", "lo", "hi", "cushion").collect()}
    assert allowed == {(1, -2.9, -1.1), (1, 0.6, 2.9), (2, round(1.1 - 2 * pi, 6), -1.1), (2, 1.1, round(2 * pi - 1.1, 6))}
    asked = {0: (1, -2.0), 1: (1, -0.5), 2: (1, 3.1), 3: (1, -3.1), 4: (2, 0.0), 5: (2, -2.0), 6: (2, 2.0)}
    got = {r.id: [round(x, 6) for x in (*r.ccw, *r.cw)] for r in fsm.next_allowed(spark.createDataFrame([(i, *a) for i, a in asked.items()], "id long, label long, angle double"), forbidden.drop("cushion"), "label", "angle", "lo", "hi").collect()}
    left, right = [round(1 - 2 * pi, 6), -1.0], [1.0, round(2 * pi - 1, 6)]
    assert got == {0: [-3.0, -1.0] * 2, 1: [0.0, 0.05, -3.0, -1.0], 2: [-3.0, -1.0, 0.5, 3.0], 3: [-3.0, -1.0, 0.5, 3.0], 4: right + left, 5: left * 2, 6: right * 2}
    free = fsm.next_allowed(spark.createDataFrame([(9, 3, 0.5), (8, 4, 0.5)], "id long, label long, angle double"), spark.createDataFrame([(4, -pi, pi)], "label long, lo double, hi double"), "label", "angle", "lo", "hi")
    assert {r.id: (r.ccw and tuple(r.ccw), r.cw and tuple(r.cw)) for r in free.collect()} == {9: ((-pi, pi), (-pi, pi)), 8: (None, None)}
    rows = queries()["arc_allowed"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).collect()
    n = spark.read.parquet(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/embeddings.parquet").count()
    assert {k: sum(r.kind == k for r in rows) for k in ("next_ccw", "next_cw")} == {"next_ccw": n, "next_cw": n}
    assert all(r.lo < r.hi for r in rows) and {r.kind for r in rows} == {"forbidden", "allowed", "next_ccw", "next_cw"}


def test_first_open_is_closed_first(spark):
    import random

    from chronofold.operators.temporal import fifo_match

    rnd = random.Random(4)
    rows = [(k, i, rnd.random() < 0.5) for k in range(30) for i in range(rnd.randint(0, 40))]
    want = {}
    for k in range(30):
        queue = []
        for _, i, opens in (r for r in rows if r[0] == k):
            if opens:
                want[k, i] = None
                queue.append(i)
            elif queue:
                want[k, queue.pop(0)] = i
    df = spark.createDataFrame(rows, "k int, i int, o boolean")
    got = {(r.k, r.i): r.by and r.by.i for r in fifo_match(df, ["k"], ["i"], F.col("o"), ["i"], "by").collect()}
    assert got == want


def test_states_at_many_moments(spark):
    """Snapshots and the changes since give what all changes up to the moment give."""
    import random

    from chronofold.operators.temporal import snapshots, states_at

    rnd = random.Random(9)
    rows = [(rnd.randrange(12), rnd.randrange(1000), i, rnd.randrange(100), rnd.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, i long, v int, gone boolean")
    asked = [0, 1, 99, 100, 101, 500, 777, 999, 1500]
    want = set()
    for m in asked:
        for k in range(12):
            last = max((r for r in rows if r[0] == k and r[1] <= m), key=lambda r: (r[1], r[2]), default=None)
            if last and not last[4]:
                want.add((m, k, last[3]))
    for every in (1, 100, 10_000):
        held = snapshots(df, ["k"], "t", "i", ["v"], every, 1600, F.col("gone"))
        got = states_at(spark.createDataFrame([(m,) for m in asked], "m long"), "m", held, df, ["k"], "t", "i", ["v"], every, F.col("gone"))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), every
