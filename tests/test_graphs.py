"""State graphs against all their paths."""

import random

import pytest

from chronofold.operators import graphs


def made(spark, machines):
    """machines: {name: {state: (duration, flag, successors)}}; a machine begins at state 0."""
    states = [(m, s, d, s == 0, f) for m, of in machines.items() for s, (d, f, _) in of.items()]
    went = [(m, s, n) for m, of in machines.items() for s, (_, _, after) in of.items() for n in after]
    return spark.createDataFrame(states, "machine string, state int, duration long, start boolean, flag boolean"), spark.createDataFrame(went, "machine string, state int, next int")


def paths(of, state=0, at=0):
    yield state, at
    for n in of[state][2]:
        yield from paths(of, n, at + of[state][0])


@pytest.fixture(scope="module")
def machines():
    rnd = random.Random(2)
    found = {}
    for m in range(12):
        n = rnd.randint(1, 9)
        found[f"m{m}"] = {s: (rnd.randint(0, 9), rnd.random() < 0.2, rnd.sample(range(s + 1, n), min(rnd.randint(0, 3), n - s - 1))) for s in range(n)}
    return found


def test_flattened(spark, machines):
    want = set()
    for m, of in machines.items():
        seen = {}
        for s, at in paths(of):
            seen.setdefault(s, []).append(at)
        want |= {(m, s, len(x), min(x), max(x)) for s, x in seen.items()}
    assert {tuple(r) for r in graphs.flattened(*made(spark, machines)).collect()} == want


def test_time_to_flag(spark, machines):
    want = set()
    for m, of in machines.items():
        for s in of:
            left = [at for x, at in paths(of, s) if of[x][1]]
            if left:
                want.add((m, s, min(left)))
    assert {tuple(r) for r in graphs.time_to_flag(*made(spark, machines)).collect()} == want


def test_aligned(spark):
    """A skipped state takes no time; what two ways lead to begins after the longer one."""
    fork = {"a": {0: (10, False, [1, 2]), 1: (20, False, [3]), 2: (30, False, [3]), 3: (5, False, [])}}
    seen = spark.createDataFrame([("a", 0, 12), ("a", 1, 25), ("a", 3, 4)], "machine string, state int, took long")
    got = {r.state: (r.enters, r.visited) for r in graphs.aligned(*made(spark, fork), seen).collect()}
    assert got == {0: (0, True), 1: (12, True), 2: (12, False), 3: (37, True)}


def test_cycles_are_told(spark):
    with pytest.raises(graphs.Cycle):
        graphs.flattened(*made(spark, {"a": {0: (1, False, [1]), 1: (1, False, [0])}}))


def test_nothing(spark):
    assert graphs.flattened(*(d.limit(0) for d in made(spark, {"a": {0: (1, True, [0])}}))).count() == 0


def test_edges_are_dealt_once(spark, machines, monkeypatch):
    """A step joins the rows before it with edges that lie where they were dealt to: it reads no file but theirs, and none are left behind."""
    seen, real = [], graphs._steps

    def spied(first, edges, on, step, most):
        def told(now, kept):
            out = step(now, kept)
            seen.append((kept.storageLevel.useDisk, out._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation")))
            return out

        return real(first, edges, on, told, most)

    monkeypatch.setattr(graphs, "_steps", spied)
    graphs.flattened(*made(spark, machines)).collect()
    graphs.time_to_flag(*made(spark, machines)).collect()
    assert seen and set(seen) == {(True, 1)}
    assert spark._jsc.getPersistentRDDs().size() == 0
