"""Logs of several versions and forms: the same rows from each, there and back, and what is wrong with some set apart."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.sources import binary, oplog, records

from .test_replay import stamp

#: One log in the layouts of four versions.
VERSIONS = {
    5: [
        "ZONE|7", "ACT+|1A/2B/some name/Enemy/1.5/2/-3/90|WAR|True|0.5|0|100/200/3/50|True|4", "ACT+|1B/2C/other/Unknown/0/0/0/0|None|False|1", "MOVE|1A/2B/x/Enemy/9/8/7/180", "NAME|1A/2B/renamed/Enemy/0/0/0/0", "HP  |1A|90/200",
        "ENVC|80030000|1F|00020001", "WAY+|B|1/2/3", "CST+|1A|Spell 9|1B|0/0/0|2.500/4.500", "CST!|1A|Spell 9|1B|0.60|8|1B!1F", "ICON|1A|55", "CLCD|False|2|1|2.5|10|2|0|60", "CLDA|Spell 1|Item 2", "PAR |0|AB|1A", "CLSR|1A||PLD", "TETH|1A|3|1B",
    ],
    12: [
        "ZONE|7", "ACT+|1A|2B|4|some name|0205|WAR|0|1.5/2/-3|90|0.5|100|200|3|50|True|True|0", "ACT+|1B|2C|-1|other|0201|None|0|0/0/0|0|1|0|0|0|0|False|False|0", "MOVE|1A|9/8/7|180", "NAME|1A|renamed", "HP  |1A|90|200|0|0",
        "ENVC|1F|00020001", "WAY+|1|1/2/3", "CST+|1A|Spell 9|1B|0/0/0|2.500/4.500", "CST!|1A|Spell 9|1B|0.60|8|0/0/0|0|0|1B!1F", "ICON|1A|55", "CLCD|False|2|1|2.5|10|2|0|60", "CLDA|Spell 1|Item 2", "PAR |0|AB|1A", "CLSR|1A||PLD|0", "TETH|1A|3|1B",
    ],
    19: [
        "ZONE|7|0", "ACT+|1A|2B|4|some name|0|0205|WAR|0|1.5/2/-3|90|0.5|100|200|3|50|True|True|0|0", "ACT+|1B|2C|-1|other|0|0201|None|0|0/0/0|0|1|0|0|0|0|False|False|0|0", "MOVE|1A|9/8/7|180", "NAME|1A|renamed|0", "HP  |1A|90|200|0|0",
        "ENVC|1F|00020001", "WAY+|1|1/2/3", "CST+|1A|Spell 9|1B|0/0/0|2.000/4.500", "CST!|1A|Spell 9|1B|0.60|8|0/0/0|0|0|1B!1F", "ICON|1A|55", "CLCD|False|2|1|7.5|10|2|60|60", "CLDA|Spell 1|Item 2", "PAR |0|AB|1A|False|a name", "CLSR|1A||PLD|0", "TETH|1A|3|1B",
    ],
    31: [
        "ZONE|7|0", "ACT+|0000001A|2B|4|0|some name|0|0205|WAR|0|1.500/2.000/-3.000|90.000|0.500|100|200|3|50|10000|True|True|00000000|0|0", "ACT+|0000001B|2C|-1|0|other|0|0201|None|0|0.000/0.000/0.000|0.000|1.000|0|0|0|0|10000|False|False|00000000|0|0",
        "MOVE|0000001A|9.000/8.000/7.000|180.000", "NAME|0000001A|renamed|0", "HP  |0000001A|90|200|0|0|10000", "ENVC|1F|00020001", "WAY+|1|1.000/2.000/3.000", "CST+|0000001A|Spell 9|0000001B|0.000/0.000/0.000|2.000/4.500|False|0.000",
        "CST!|0000001A|Spell 9|0000001B|0.60|8|0.000/0.000/0.000|0|0|0.000|0000001B!000000000000001F", "ICON|0000001A|55|00000000", "CLCD|False|2|1|7.5|10|2|60|60", "CLDA|2|Spell 1|1|1|Item 2|1|1", "PAR |0|AB|0000001A|False", "CLSR|0000001A||PLD|0", "TETH|0000001A|3|0000001B",
    ],
}
HEADS = {5: "VER |5", 12: "VER |12|10000000|game", 19: "VER |19|10000000|game", 31: "VER |31|10000000|game"}


def save(folder, name, version, rows):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(f"{stamp(0)}|{r}" for r in [HEADS[version], *rows]) + "\n")


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("versions")
    for version, rows in VERSIONS.items():
        save(folder, f"v{version}.log", version, rows)
    return oplog.read_records(spark, str(folder)).cache()


@pytest.mark.parametrize("tag", sorted({r[:4] for r in VERSIONS[31]}))
def test_versions_give_the_same_rows(logs, tag):
    rows = {}
    for r in records.typed(logs, tag).orderBy("op_seq").collect():
        d = r.asDict(recursive=True)
        rows.setdefault((d.pop("replay_id"), d.pop("version")), []).append({k: v for k, v in d.items() if k not in ("op_seq", "error")})
    assert len(rows) == 4
    first = rows[("v31.log", 31)]
    assert len(first) == sum(r.startswith(tag) for r in VERSIONS[31]) and all(v == first for v in rows.values())
    assert not any(v is None for d in first for v in d.values())


def test_typed_lists(logs):
    c = records.typed(logs.where("version = 5"), "CLCD").first()
    assert [tuple(x) for x in c.cooldowns] == [(1, 7.5, 10.0), (2, 60.0, 60.0)]
    assert [(x.action.kind, x.charges) for x in records.typed(logs.where("version = 12"), "CLDA").first().slots] == [("Spell", 1), ("Item", 1)]
    assert int(records.typed(logs.where("version = 5"), "ACT+").orderBy("op_seq").first().type) == 0x205


def test_old_tags_and_rooms(spark, tmp_path):
    rows = ["PAR+|0|AB|1A", "PAR!|1|AC|1B", "PAR-|1", "TET+|1A|3|1B", "TET-|1A", "STA!|1A|2|5 name|1F|1.5|1B"]
    (tmp_path / "old.log").write_text("\n".join(f"{stamp(i)}|{r}" for i, r in enumerate(["VER |3", *rows])) + "\n")
    save(tmp_path, "rooms.log", 19, ["DDMP|" + "0F" * 25])
    r = oplog.read_records(spark, str(tmp_path))
    assert [(p.slot, int(p.content), int(p.instance)) for p in records.typed(r, "PAR ").orderBy("op_seq").collect()] == [(0, 0xAB, 0x1A), (1, 0xAC, 0x1B), (1, 0, 0)]
    assert [(t.tether, int(t.target)) for t in records.typed(r, "TETH").orderBy("op_seq").collect()] == [(3, 0x1B), (0, 0)]
    assert records.typed(r, "STA+").first().status == 5
    assert [int(x) for x in records.typed(r, "DDMP").first().rooms] == [15] * 25
    good, bad = oplog.sorted_out(r)
    assert good.count() == 9 and bad.count() == 0
    # Time goes on at each line of the old log; the version's own line begins none.
    assert oplog.frames(r).count() == 6


def test_names_of_logs_are_paths(spark, tmp_path):
    for name in ("a/run.log", "b/run.log", "b/deep er/x+y %20.log"):
        save(tmp_path, name, 31, ["UMRK|in " + name])
    r = oplog.parse(oplog.read_lines(spark, str(tmp_path)))
    assert sorted((x.replay_id, x.text) for x in records.typed(r, "UMRK").collect()) == sorted((n, "in " + n) for n in ("a/run.log", "b/run.log", "b/deep er/x+y %20.log"))
    assert {x.replay_id for x in oplog.read_lines(spark, str(tmp_path / "a" / "run.log")).collect()} == {"run.log"}


def frame(i):
    return f"FRAM|16.000||000000000000000A|0000000000000000|{1000 + i * 10_000_000}|{i}|0.25|0.25|1|45.000"


EVERY = [
    frame(0), *VERSIONS[31], frame(2), "UMRK|a mark ä日", "RSV |key|", "DIRU|80030000|00000001|00000002|00000003|00000004|00000005", "LEME|01|02|0AFF", "PVP+", "PVP-", "SLOG|5|2|-1|7", "SLOG|5|0", "ACSZ|0000001A|0.750", "ATG+|0000001A",
    "AVIS|0000001A|86", "RFLG|0000001A|-1", "MDLS|0000001A|1|2|3", "FORA|0000001A|9|2", "ER  |0000001A|7|1", "STA+|0000001A|2|55 |001F|12.500|E0000000", "STA-|0000001A|2", "AIE+|0000001A|0|7|1|0000001B|Spell 9|" + "|".join(["000000000000001F"] * 8),
    "VFX |0000001A|9|0000001B", "ESTA|0000001A|00FF", "EANM|0000001A|0001|0002", "PATE|0000001A|0001", "PATS|0000001A|2|0000001A|0001|0000001B|0002", "NYEL|0000001A|300", "LB  |1|2", frame(3), "CLAR|Item 5|0000001A|1.000/2.000/3.000|7|0.600|0.000/2.500|0.000/2.500",
    "CLRJ|Spell 5|7|0.000/2.500|579", "CDN+|12.5", "CDN-", "CLST|400|400|100", "CLBH|1|3|2", "CBLU|2|11|12", "CBST|1|3", "CLVL|3|-1|80|90", "CLAF|5|1.000/2.000/3.000|30.000|50|2|9", "CPET|0000001A|1|2", "CHOC|0000001A|1|0.5|True", "CLFT|0000001A",
    "CLFD|-90.000", "CLKV|1|2|3|4|5|6", "FATE|5|638000000000000000", "HATE|0000001A|1|0000001B|100", "CLPR|0|0.5|1|2", "INVT|5|6", "FLOS|5|0000001A", "WAY-|1", "SGN+|3|0000001A", "DDPG|1|2|3|4|5|6|7|8|9|True", "DDMP|" + "|".join(["00FF"] * 25),
    "DDPT|" + "|".join(["0000001A|3"] * 4), "DDIT|" + "|".join(["1|F"] * 16), "DDCT|" + "|".join(["1|2"] * 16), "DDMG|0102", "IPCI|5", "IPCX|1|2|3|4|5", "IPCS|-3|200|5|0000001A|638000000000000000|00FF",
]


def clock(rows):
    """Lines at the time of their frame."""
    out, at = [], 0
    for r in rows:
        at = (int(r.split("|")[5]) - 1000) // 10_000_000 if r.startswith("FRAM") else at
        out.append(f"{stamp(at)}|{r}".replace("|55 |", "|55|"))
    return out


def test_there_and_back(spark, tmp_path):
    """Text to binary and back is the same text; binary to text and back the same bytes; both give the same records."""
    lines = {"one.log": clock(["VER |31|10000000|game", *EVERY]), "sub/two.log": clock(["VER |31|10000000|game", frame(0), "UMRK|" + "x" * 300, *EVERY[::3]])}
    for name, text in lines.items():
        (tmp_path / "text" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "text" / name).write_text("\n".join(text) + "\n")
    places = [str(tmp_path / p) for p in ("text", "binary", "back", "again")]
    for a, b, form in zip(places, places[1:], ("binary", "text", "binary"), strict=False):
        assert oplog.convert(spark, a, b, form).count() == 0
    for name, text in lines.items():
        assert (tmp_path / "back" / name).read_text().split("\n") == [*text, ""]
        assert (tmp_path / "binary" / name).read_bytes() == (tmp_path / "again" / name).read_bytes()
        assert (tmp_path / "binary" / name).read_bytes().startswith(b"BLOGVER ")
    assert not list((tmp_path / "binary").glob("_staged*"))
    read = [{(r.replay_id, r.ts_us, r.tag, tuple(r.fields)) for r in oplog.read_records(spark, p).collect()} for p in places]
    assert len(read[0]) > 90 and all(r == read[0] for r in read)


def test_old_logs_become_binary(spark, tmp_path):
    for version, rows in VERSIONS.items():
        save(tmp_path / "from", f"v{version}.log", version, rows)
    oplog.convert(spark, str(tmp_path / "from"), str(tmp_path / "to"), "binary")
    found = {v: (tmp_path / "to" / f"v{v}.log").read_bytes() for v in VERSIONS}
    assert found[12] == found[19] == found[31]
    assert found[5] == found[31].replace(b"\x04game", b"\x03old")


def test_cut_logs(spark, tmp_path):
    """A record of plain numbers that is cut off ends in zeros; any other breaks its log, and no other log."""
    whole = b"BLOGVER " + struct.pack("<iQ", 31, 10**7) + b"\x04game" + struct.pack("<q", binary.EPOCH_TICKS)
    (tmp_path / "numbers.log").write_bytes(whole + b"CLPR" + struct.pack("<ff", 1, 2) + b"\0")
    (tmp_path / "text.log").write_bytes(whole + b"PVP+UMRK\x09abc")
    (tmp_path / "tag.log").write_bytes(whole + b"PVP+XXXX")
    (tmp_path / "end.log").write_bytes(whole + b"PVP+PV")
    (tmp_path / "brotli.log").write_bytes(b"BLCBxxxx")
    (tmp_path / "fine.log").write_text(f"{stamp(0)}|{HEADS[31]}\n{stamp(1)}|PVP+\n")
    good, bad = oplog.sorted_out(oplog.read_records(spark, str(tmp_path)))
    assert {r.replay_id for r in good.collect()} == {"numbers.log", "end.log", "fine.log"}
    assert [r.fields for r in good.where("tag = 'CLPR'").collect()] == [["1", "2", "0", "0"]]
    assert {(r.replay_id, r.problem) for r in bad.collect() if r.problem} == {("text.log", "the log ends within a record"), ("tag.log", "unknown tag XXXX"), ("brotli.log", "there is no codec for compressed logs")}
    rows, apart = oplog.sorted_out(oplog.read_records(spark, str(tmp_path)), whole_logs=False)
    assert {r.replay_id for r in rows.collect()} == {"numbers.log", "end.log", "fine.log", "text.log", "tag.log"} and apart.count() == 3


def test_problems_of_text(spark, tmp_path):
    act = VERSIONS[31][1]
    cases = {
        "fine.log": (HEADS[31], act, "ACT-|1A", act, "UMRK|"),
        "twice.log": (HEADS[31], act, act.replace("0000001A", "1a")),
        "tag.log": (HEADS[31], "ZZZZ|1"),
        "number.log": (HEADS[31], "HP  |1A|x|200|0|0|0"),
        "short.log": (HEADS[31], "HP  |1A|1"),
        "old.log": ("VER |1", "PVP+"),
        "none.log": ("PVP+",),
        "list.log": (HEADS[31], "SLOG|5|x"),
        "layout.log": (HEADS[19], "HP  |1A|90/200"),
    }
    for name, rows in cases.items():
        (tmp_path / name).write_text("\n".join(f"{stamp(0)}|{r}" for r in rows) + "\n")
    (tmp_path / "time.log").write_text(f"{stamp(0)}|{HEADS[31]}\nyesterday|PVP+\n")
    r = oplog.read_records(spark, str(tmp_path))
    good, bad = oplog.sorted_out(r)
    assert {x.replay_id for x in good.collect()} == {"fine.log"}
    unread = "fields are not as they should be"
    want = {"twice.log": "made while it is there", "tag.log": "unknown tag", "number.log": unread, "short.log": unread, "old.log": "version is too old", "none.log": "no version", "list.log": unread, "layout.log": unread, "time.log": "no time"}
    assert {x.replay_id: x.problem for x in bad.collect() if x.problem} == want
    rows, apart = oplog.sorted_out(r, whole_logs=False)
    assert rows.count() + apart.count() == r.count() and rows.where("replay_id = 'tag.log'").count() == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_pieces_of_any_size(seed, piece):
    """A log is read the same in whatever pieces it comes."""
    import io

    rnd = random.Random(seed)
    rows = [r for r in EVERY if rnd.random() < 0.3 and not r.startswith("FRAM")]
    made = binary.Encoder()
    raw = made.header() + b"".join(made.record(0, r[:4], r.split("|")[1:]) for r in ["VER |31|10000000|game", *rows])

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, rnd.randint(1, piece)))

    got = [(tag, fields) for _, _, tag, fields in binary.Decoder(Slow(raw))]
    assert got[1:] == [(r[:4], [f.replace("55 ", "55") for f in r.split("|")[1:]]) for r in rows]


def test_every_layout_has_a_grammar(spark):
    good, bad = oplog.sorted_out(spark.createDataFrame([("l", i, 0, 31, r[:4], r.split("|")[1:]) for i, r in enumerate([HEADS[31], *EVERY])], "replay_id string, op_seq long, ts_us long, version int, tag string, fields array<string>").where(F.col("tag") != "ACT+"))
    assert bad.count() == 0 and len(records.grammars()) > len(records.KNOWN)


def test_short_text_logs_share_tasks(spark, tmp_path):
    """Many short logs are one part and one scan, which Spark's reader of text has no hand in; a longer log is split by Spark."""
    for i in range(300):
        save(tmp_path, f"by user/{i}.log", 31, [f"UMRK|{i}"])
    assert len(binary.BinaryLogReader(str(tmp_path), True).partitions()) == 1
    r = oplog.read_records(spark, str(tmp_path))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and plan.count("binary_log") == 1
    assert sorted((x.replay_id, x.version, x.tag, x.fields[0]) for x in r.where("tag <> 'VER '").collect()) == sorted((f"by user/{i}.log", 31, "UMRK", str(i)) for i in range(300))


def test_long_text_logs_are_split(spark, tmp_path):
    """A text log too long for one task is read by Spark, once, beside short ones."""
    save(tmp_path, "short.log", 19, ["UMRK|a"])
    save(tmp_path, "long.log", 12, ["UMRK|" + "b" * (1 << 20)] * 34)
    assert [u.rsplit("/", 1)[1] for u in oplog._long_text(spark, str(tmp_path))] == ["long.log"]
    read = oplog.read_records(spark, str(tmp_path)).groupBy("replay_id", "version", "tag").count().collect()
    assert sorted(map(tuple, read)) == [("long.log", 12, "UMRK", 34), ("long.log", 12, "VER ", 1), ("short.log", 19, "UMRK", 1), ("short.log", 19, "VER ", 1)]
    assert oplog.read_text(spark, str(tmp_path)).count() == 37


def test_lines_of_text_are_those_of_spark(spark, tmp_path):
    odd = {"crlf.log": b"a\r\nb\rc\n\nd", "bom.log": b"\xef\xbb\xbfone\ntwo\n", "empty.log": b"", "end.log": b"\n", "few.log": b"ab", "wide.log": "ä日 x\x0by\n".encode()}
    for name, raw in odd.items():
        (tmp_path / name).write_bytes(raw)
    rows = [sorted((x.replay_id, x.op_seq, x.line) for x in read(spark, str(tmp_path)).collect()) for read in (oplog.read_text, oplog.read_lines)]
    own = [[(name, [x[2] for x in r if x[0] == name]) for name in odd] for r in rows]
    assert own[0] == own[1]


@pytest.mark.parametrize("first", ["VER |31|1|g", "VER |x", "VER ", "# VER |31\n0|VER |12", " 12", "VER | 7 |1", "VER |99999999999"])
def test_version_of_text(spark, tmp_path, first):
    (tmp_path / "a.log").write_text(f"{stamp(0)}|{first}\n{stamp(0)}|UMRK|x\n{stamp(0)}|VER |30\n" if not first.startswith("#") else f"{first}\n{stamp(0)}|UMRK|x\n")
    want = oplog.with_version(oplog.parse(oplog.read_lines(spark, str(tmp_path))))
    got = oplog.read_records(spark, str(tmp_path))
    columns = ("ts_us", "version", "tag", "fields")
    assert [tuple(r) for r in got.orderBy("op_seq").select(*columns).collect()] == [tuple(r) for r in want.orderBy("op_seq").select(*columns).collect()]


def test_records_are_checked_by_one_literal(spark):
    """No expression comes with a row, as each would be compiled for each record; and the good are found without a join of all records with it."""
    r = spark.createDataFrame([("l", 0, 0, 31, "VER ", ["31"])], "replay_id string, op_seq long, ts_us long, version int, tag string, fields array<string>")
    plan = oplog.sorted_out(r)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "g_expression" not in plan and plan.count("Join") == 1


def test_names_of_logs_stay_in_the_store(tmp_path):
    """What a task tells the driver doesn't grow with its logs."""
    import pickle

    import pyarrow as pa

    writer = binary.LogWriter(str(tmp_path), binary=False)
    names = [f"by user/{i}.log" for i in range(500)]
    told = writer.write(iter([pa.RecordBatch.from_pydict({"replay_id": names, "line": ["x"] * 500})]))
    assert len(pickle.dumps(told)) < 500
    writer.commit([told, None])
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()) == sorted(names)


def test_packed_is_field_by_field(monkeypatch):
    """Fields of fixed width that are packed and unpacked at once give what they give one by one, wherever a log is cut off."""
    import io

    rows = ["VER |31|10000000|game", *(r.replace("|55 |", "|55|") for r in EVERY)]

    def made(written=rows):
        e = binary.Encoder()
        return e.header() + b"".join(e.record(0, r[:4], r.split("|")[1:] if "|" in r else []) for r in written)

    def read(raw):
        out = []
        try:
            for r in binary.Decoder(io.BytesIO(raw)):
                out.append(r)
        except binary.Broken as e:
            out.append(str(e))
        return out

    odd = [rows[0], "MOVE|1A|1/2/3/4|9", "CHOC|1A|1|0.5", "TETH|1A", "CST+|E0000000|Spell 9 x|1B/2|nan/inf/0|1/2"]
    raw = made()
    cuts = range(len(raw) - 900, len(raw) + 1, 1)
    at_once = made(odd), [read(raw[:n]) for n in cuts]
    assert any(step for tag in records.TAGS for step in binary._writes(tag)[1])
    monkeypatch.setattr(binary, "_writes", lambda tag: (0, (), records.layout(tag)))
    monkeypatch.setattr(binary, "_reads", lambda tag, version: tuple((None, f) for f in records.layout(tag, version)))
    assert made() == raw
    assert (made(odd), [read(raw[:n]) for n in cuts]) == at_once


def test_versions_share_a_scan(spark, tmp_path):
    """Logs of all versions, binary ones among them, are read in one scan without a join for the version of each."""
    for version, rows in VERSIONS.items():
        save(tmp_path, f"v{version}.log", version, rows)
    made = binary.Encoder()
    (tmp_path / "raw.log").write_bytes(made.header() + made.record(0, "VER ", ["31", "10000000", "game"]) + made.record(0, "PVP+", []))
    r = oplog.read_records(spark, str(tmp_path))
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.replay_id, x.version) for x in r.select("replay_id", "version").distinct().collect()} == {*((f"v{v}.log", v) for v in VERSIONS), ("raw.log", 31)}


@pytest.fixture
def written(spark, monkeypatch):
    """What is given to writers of logs: the columns, the plan and the length of the longest method made of it, without running it."""
    from pyspark.sql.readwriter import DataFrameWriter

    told = []

    def save(self, *a, **k):
        told.append((self._df.columns, self._df._jdf.queryExecution().executedPlan().toString(), longest(spark, self._df)))

    monkeypatch.setattr(DataFrameWriter, "save", save)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield told
    spark.conf.set("spark.sql.adaptive.enabled", before)


def longest(spark, df):
    """Bytes of the longest method of those that Spark makes of whole stages."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))


#: Java compiles no longer method.
COMPILED = 8000


def test_text_logs_are_written_from_lines_alone(spark, written):
    """No column of lists goes along, whose nulls Spark counts anew for each row; logs are sorted by a number before their names."""
    from chronofold.plans import q_replay

    monkey = pytest.MonkeyPatch()
    monkey.setattr(q_replay, "_payloads", lambda records: records)
    q_replay.versioned_logs(spark, "/root/testdata/sf0.001")
    monkey.undo()
    r = spark.createDataFrame([("l", 0, 0, 31, "VER ", ["31"])], "replay_id string, op_seq long, ts_us long, version int, tag string, fields array<string>")
    oplog.write_logs(r, "/nowhere", "text")
    assert [c for c, _, _ in written] == [["replay_id", "op_seq", "line"]] * 2
    assert all("Sort [xxhash64(replay_id" in plan for _, plan, _ in written)
    assert all(n < COMPILED for _, _, n in written)


def test_upgrades_are_compiled(spark, written):
    """Records are brought to the latest version by methods short enough for Java to compile."""
    r = spark.range(9).selectExpr("'l' as replay_id", "id as op_seq", "id as ts_us", "31 as version", "element_at(array('ACT+', 'CST+', 'HP  ', 'STA!'), int(id % 4) + 1) as tag", "array('1A', string(id)) as fields")
    oplog.write_logs(r, "/nowhere")
    [(_, _, n)] = written
    assert 0 < n < COMPILED
    own = r.withColumn("version", F.col("op_seq").cast("int"))
    assert all(0 < longest(spark, records.typed(own, tag)) < COMPILED for tag in ("ACT+", "CST+", "HP  "))


def test_odd_lines_are_no_records(spark):
    """Whether a line is a record is told by its second part, without its parts."""
    lines = ["a|VER ", "a|VER |", "|VER |5|6", "VER ", "abcd", "a|VE|x", "a|VERSION|x", "a||VER ", "# a|VER |", "   ", "", "a|ä日 x|", "a|VER", "||||", "a|VER \r|x"]
    want = ["a|VER ", "a|VER |", "|VER |5|6", "a|ä日 x|"]
    r = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "replay_id string, op_seq long, line string")
    assert sorted(x.line for x in oplog.parse(r).collect()) == sorted(want)
