"""Layouts of log records: what versions of logs write, and the typed payloads of the latest version.

Logs of every version are brought to the latest layout first (`upgraded`); so there is one way to read a record's
fields (`typed`), and one to write them. The version is that of the log's own `VER ` record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATEST = 31
#: Older logs are not read; binary ones exist from the second on.
OLDEST, OLDEST_BINARY = 2, 10

#: The fields of the records by tag, in the order in which logs have them.
#: name:type, with @ the versions that have the field and = what stands for it elsewhere, or where a text record ends before it; - has no name.
#: Integers u and i, hexadecimal ones x and reals f have their bits, and behind a slash the digits that text is written with.
#: count*item is a list: behind a count of that type, or of so many items; (a,b) are items of several fields.
LAYOUTS = """
VER : version:i32 frequency:u64@10-=10000000 game_version:text@11-=old
FRAM: previous_ms:f64/3 -:void gauge_low:x64/16=0000000000000000 gauge_high:x64/16@18-=0000000000000000 counter:u64@10-=0 index:u32@10-=0 raw_step_s:f32@10-=0 step_s:f32@10-=0 speed:f32@10-=1 camera:angle@16-=0.000
UMRK: text:text
RSV : key:text value:text
ZONE: zone:u16 content:u16@13-=0
DIRU: director:x32/8 update:x32/8 param1:x32/8 param2:x32/8 param3:x32/8 param4:x32/8
ENVC: -:x32/8@-10 index:x8/2 state:x32/8
LEME: sequence:x8/2 param:x8/2 data:bytes
PVP+:
PVP-:
SLOG: message:u32 args:i32*i32
ACT+: instance:x64/8 oid:x32/1 spawn:i32=-1 layout:x32/1@26-=0 name:text name_id:u32@13-=0 type:x16/4 class:class level:i32@12-=0 position:vector rotation:angle radius:f32/3 hp:u32 max_hp:u32 shield:u32 mp:u32 max_mp:u32@24-=10000 targetable:bool ally:bool=False owner:actor=00000000 fate:u32@14-=0 flags:i32@27-=0
ACT-: instance:actor
NAME: instance:x64/8 name:text name_id:u32@13-=0
CLSR: instance:actor -:void class:class level:i32@12-=0
MOVE: instance:x64/8 position:vector rotation:angle
ACSZ: instance:actor radius:f32/3
HP  : instance:actor hp:u32 max_hp:u32 shield:u32 mp:u32 max_mp:u32@24-=10000
ATG+: instance:actor
ATG-: instance:actor
AVIS: instance:actor visibility:u16
RFLG: instance:actor flags:i32
ALLY: instance:actor ally:bool
DIE+: instance:actor
DIE-: instance:actor
COM+: instance:actor
COM-: instance:actor
NENP: instance:actor aggressive:bool
MDLS: instance:actor model:u8 animation1:u8=0 animation2:u8=0
EVTS: instance:actor state:u8
TARG: instance:actor target:actor
MNTD: instance:actor mount:u32
FORA: instance:actor level:u8 element:u8
TETH: instance:actor tether:u32=0 target:actor=00000000
CST+: instance:actor action:action target:actor location:vector time:pair interruptible:bool=False rotation:angle=0.000
CST-: instance:actor
CST!: instance:actor action:action target:actor lock_s:f32/2 max_targets:u32 position:vector@6-=0.000/0.000/0.000 global_sequence:u32@7-=0 source_sequence:u32@9-=0 rotation:angle@21-=0.000 targets:targets
ER  : instance:actor global_sequence:u32 target_index:i32
STA+: instance:actor slot:i32 status:status
STA-: instance:actor slot:i32
AIE+: instance:actor slot:i32 global_sequence:u32 target_index:i32 source:actor action:action effects:8*x64/16
AIE-: instance:actor slot:i32
ICON: instance:actor icon:u32 target:actor@22-=00000000
VFX : instance:actor effect:u32 target:actor
ESTA: instance:actor state:x16/4
EANM: instance:actor param1:x16/4 param2:x16/4
PATE: instance:actor timeline:x16/4
PATS: instance:actor actions:i32*(actor:actor,timeline:x16/4)
NYEL: instance:actor message:u16
OPNT: instance:actor
PAR : slot:i32 content:x64/1=0 instance:x64/8=00000000 in_cutscene:bool@15-=False -:text@15-30
LB  : current:i32 max:i32
CLAR: action:action target:actor position:vector sequence:u32 lock_s:f32/3 cast:pair recast:pair
CLRJ: action:action sequence:u32 recast:pair message:u32
CDN+: remaining_s:f32
CDN-:
CLAL: lock_s:f32
CLCB: action:u32 remaining_s:f32
CLST: skill_speed:i32 spell_speed:i32 haste:i32
CLMV: speed:f32
FLY+:
FLY-:
CLCD: reset:bool cooldowns:u8*(group:u8,elapsed:f32,total:f32)
CLDA: slots:u8*(action:action,charges:u8,most:u8)
CLBH: contents:u8*(entry:u8,count:u8)
CBLU: values:u8*u32
CBST: values:u8*u8
CLVL: values:u8*i16
CLAF: fate:u32 center:vector radius:f32/3 progress:u8@27-=0 handed_in:u8@27-=0 npc:u32@29-=0
CPET: pet:x64/8 order:u8 stance:u8
CHOC: companion:x64/8 stance:u8 left_s:f32 stabled:bool@30-=False
CLFT: target:x64/8
CLFD: direction:angle
CLKV: values:6*u32
FATE: fate:u32 start_ticks:i64
HATE: instance:actor targets:i32*(actor:actor,enmity:i32)
CLPR: timer1:f32 timer2:f32 timer3:f32 timer4:f32
INVT: item:u32 quantity:u32
FLOS: action:u32 target:actor
WAY+: mark:u8 position:vector
WAY-: mark:u8
SGN+: sign:u8 target:actor
SGN-: sign:u8
DDPG: dungeon:u8 floor:u8 tileset:u8 weapon:u8 armor:u8 gear:u8 hoards:u8 return:u8 passage:u8 hoard_here:bool@29-=False
DDMP: rooms:25*x16/4
DDPT: members:4*(actor:actor,room:u8)
DDIT: items:16*(count:u8,flags:x8/1)
DDCT: chests:16*(kind:u8,room:u8)
DDMG: data:bytes
IPCI: value:u32
IPCX: session:u32 zone:u32 key0:u32 key1:u32 key2:u32
IPCS: packet:i32 opcode:u16 epoch:u32 source:x32/8 sent_ticks:i64 payload:bytes
"""

#: Layouts that older logs have instead, up to the version named. `place` and `points` are several values behind slashes.
OLDER = """
ACT+ 9: place:place class:class targetable:bool radius:f32/3 owner:actor=00000000 points:points=0/0 ally:bool=False spawn:i32=-1
NAME 9: place:place
MOVE 9: place:place
HP   9: instance:actor points:points
WAY+ 9: mark:text position:vector
WAY- 9: mark:text
CST+ 16: instance:actor action:action target:actor location:vector time:until interruptible:bool=False rotation:angle=0.000
CLDA 19: slots:2*(action:action)
CLDA 24: slots:2*(action:action,charges:u8,most:u8)
DDMP 22: rooms:bytes
DDMP 28: rooms:25*x8/2
"""

#: What records of old logs are called now.
ALIASES = {"TET+": "TETH", "TET-": "TETH", "STA!": "STA+", "PAR+": "PAR ", "PAR!": "PAR ", "PAR-": "PAR "}

#: Names that stand for numbers in old text, and in the text of every version.
ENTITY_TYPES = {
    "None": 0, "Player": 0x104, "Part": 0x201, "Unknown": 0x201, "Pet": 0x202, "Chocobo": 0x203, "Enemy": 0x205, "Buddy": 0x209, "Helper": 0x20B, "EventNpc": 0x300, "Treasure": 0x400,
    "Aetheryte": 0x500, "GatheringPoint": 0x600, "EventObj": 0x700, "MountType": 0x800, "Companion": 0x900, "Retainer": 0xA00, "Area": 0xB00, "Housing": 0xC00, "Cutscene": 0xD00, "CardStand": 0xE00,
}
MARKS = "A B C D N1 N2 N3 N4".split()
CLASSES = (
    "None GLA PGL MRD LNC ARC CNJ THM CRP BSM ARM GSM LTW WVR ALC CUL MIN BTN FSH PLD MNK WAR DRG BRD WHM BLM ACN SMN SCH ROG NIN MCH DRK AST SAM RDM BLU GNB DNC RPR SGE VPR PCT BST"
).split()
ACTION_KINDS = {
    "None": 0, "Spell": 1, "Item": 2, "KeyItem": 3, "Ability": 4, "General": 5, "Buddy": 6, "MainCommand": 7, "Companion": 8, "CraftAction": 9, "PetAction": 11, "Mount": 13, "PvPAction": 14, "Waymark": 15,
    "ChocoboRaceAbility": 16, "ChocoboRaceItem": 17, "SquadronAction": 19, "Ornament": 20, "BozjaHolsterSlot0": 0xE0, "BozjaHolsterSlot1": 0xE1, "Pomander": 0xE2, "Magicite": 0xE3,
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    #: Of a list: the type of its count, or how many items there are; and the fields of an item, one without a name where it has no more.
    count: str | None = None
    item: tuple[Field, ...] = ()
    first: int = 0
    last: int = LATEST
    default: str | None = None

    @property
    def width(self) -> int:
        """Fields of text."""
        return {"status": 4}.get(self.kind, 1)


def _field(text: str) -> Field:
    text, _, default = text.partition("=")
    text, _, versions = text.partition("@")
    name, _, kind = text.partition(":")
    first, _, last = versions.partition("-")
    count, star, item = kind.partition("*")
    inner = item.strip("()").split(",") if item.startswith("(") else [f":{item}"] if star else []
    return Field("" if name == "-" else name, "list" if star else kind, count if star else None, tuple(_field(i) for i in inner), int(first or 0), int(last or LATEST), default or None)


def _read_layouts() -> tuple[dict[str, tuple[Field, ...]], dict[str, list[tuple[int, tuple[Field, ...]]]]]:
    now, older = {}, {}
    for line in LAYOUTS.strip("\n").split("\n"):
        now[line[:4]] = tuple(_field(f) for f in line[5:].split())
    for line in OLDER.strip("\n").split("\n"):
        last, _, fields = line[4:].partition(":")
        older.setdefault(line[:4], []).append((int(last), tuple(_field(f) for f in fields.split())))
    return now, older


_NOW, _OLDER = _read_layouts()
#: Every tag of the latest version.
TAGS = tuple(_NOW)
KNOWN = (*TAGS, *ALIASES)


def layout(tag: str, version: int = LATEST) -> tuple[Field, ...]:
    """The fields that records of one version have."""
    for last, fields in _OLDER.get(tag, ()):
        if version <= last:
            return fields
    return tuple(f for f in _NOW[tag] if f.first <= version <= f.last)


# Typed payloads


def _hex(c: Column) -> Column:
    return F.conv(c, 16, 10).try_cast("decimal(20,0)")


def _actor(c: Column) -> Column:
    """The id; verbose logs write more about the actor behind a slash."""
    return _hex(F.split_part(c, F.lit("/"), F.lit(1)))


def _part(c: Column, i: int, by: str = "/") -> Column:
    return F.get(F.split(c, by), F.lit(i))


def _parts(c: Column, names: str) -> Column:
    return F.when(c.isNotNull(), F.struct(*(_part(c, i).try_cast("double").alias(n) for i, n in enumerate(names.split()))))


def _action(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.split_part(c, F.lit(" "), F.lit(1)).alias("kind"), F.split_part(c, F.lit(" "), F.lit(2)).try_cast("long").alias("id")))


def _target(c: Column) -> Column:
    return F.struct(_actor(F.split_part(c, F.lit("!"), F.lit(1))).alias("target"), F.transform(F.slice(F.split(c, "!"), 2, 8), _hex).alias("effects"))


def _value(kind: str, c: Column) -> Column:
    if kind[0] in "ui" and kind[1:].isdigit():
        return c.try_cast("long")
    if kind[0] == "x":
        return _hex(c)
    if kind[0] == "f":
        return c.try_cast("double")
    return {"text": lambda c: c, "class": lambda c: c, "bool": lambda c: F.lower(c) == "true", "actor": _actor, "angle": lambda c: F.radians(c.try_cast("double")), "vector": lambda c: _parts(c, "x y z"), "pair": lambda c: _parts(c, "elapsed total"), "action": _action, "bytes": F.unhex}[kind](c)


def _list(f: Field, every: Column, at: int) -> Column:
    """The items of a list whose count, or first item, is field `at`."""
    fixed = f.count.isdigit()
    n = F.lit(int(f.count)) if fixed else F.get(every, F.lit(at)).try_cast("int")
    first = at if fixed else at + 1

    def item(i: Column) -> Column:
        values = [_value(p.kind, F.get(every, F.lit(first + k) + i * len(f.item))).alias(p.name or "value") for k, p in enumerate(f.item)]
        return F.struct(*values) if f.item[0].name else values[0]

    # A sequence would go down where its end is below its start.
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), item)


def payload(tag: str, fields: str = "fields") -> list[Column]:
    """The typed fields of a record with this tag, in the latest layout; NULL where a record has fewer or what is no such value."""
    out, at = [], 0
    every = F.col(fields)
    get = lambda i: F.get(every, F.lit(i) if isinstance(i, int) else i)
    rest = lambda n: F.slice(every, n + 1, F.greatest(F.size(every) - n, F.lit(0)))
    for f in layout(tag):
        if f.kind == "status":
            own = get(at)
            out += [F.split_part(own, F.lit(" "), F.lit(1)).try_cast("long").alias(f.name), _hex(get(at + 1)).cast("long").alias("extra"), get(at + 2).try_cast("double").alias("remaining_s"), _actor(get(at + 3)).alias("source")]
        elif f.kind == "targets":
            out.append(F.transform(rest(at), _target).alias(f.name))
        elif f.kind == "list":
            out.append(_list(f, every, at).alias(f.name))
        elif f.name:
            raw = get(at) if f.default is None else F.coalesce(get(at), F.lit(f.default))
            out.append(_value(f.kind, raw).alias(f.name))
        at += f.width
    return out


def typed(records: DataFrame, tag: str) -> DataFrame:
    """The records of one tag, with its typed fields in place of `fields`; see `oplog.parse`.

    Records with a column `version` are of that version's layout; others are of the latest.
    """
    old = [t for t, now in ALIASES.items() if now == tag]
    rest = [c for c in records.columns if c not in ("fields", "tag", "line")]
    own = records.where(F.col("tag").isin(tag, *old))
    return (upgraded(own, (tag,)) if "version" in records.columns else own).select(*rest, *payload(tag))


# Older versions


def with_version(records: DataFrame) -> DataFrame:
    """`records` with the version of their log; NULL where it doesn't tell."""
    own = records.where("tag = 'VER '").groupBy("replay_id").agg(F.min_by(F.get("fields", F.lit(0)).try_cast("int"), "op_seq").alias("version"))
    return records.drop("version").join(own, "replay_id", "left")


def _now_from(tag: str, last: int, first: int) -> Column:
    """`fields` in the latest layout, from the layout that versions `first` to `last` share, but for fields that a version adds."""
    place = F.get("fields", F.lit(0))
    number = lambda names, c: F.coalesce(F.element_at(F.create_map(*(x for n, v in names.items() for x in (F.lit(n), F.lit(v)))), c), F.lit("0"))
    if tag in ("ACT+", "NAME", "MOVE") and last < 10:
        position, rotation = F.concat_ws("/", *(_part(place, i) for i in (4, 5, 6))), _part(place, 7)
        if tag == "NAME":
            return F.array(_part(place, 0), _part(place, 2), F.lit("0"))
        if tag == "MOVE":
            return F.array(_part(place, 0), position, rotation)
        old = lambda i, default=None: F.get("fields", F.lit(i)) if default is None else F.coalesce(F.get("fields", F.lit(i)), F.lit(default))
        points = old(5, "0/0")
        kind = number({n: f"{v:04X}" for n, v in ENTITY_TYPES.items()}, _part(place, 3))
        numbers = [F.coalesce(_part(points, i), F.lit("0")) for i in range(4)]
        return F.array(_part(place, 0), _part(place, 1), old(7, "-1"), F.lit("0"), _part(place, 2), F.lit("0"), kind, old(1), F.lit("0"), position, rotation, old(3), *numbers, F.lit("10000"), old(2), old(6, "False"), old(4, "00000000"), F.lit("0"), F.lit("0"))
    if tag == "HP  " and last < 10:
        points = F.get("fields", F.lit(1))
        return F.array(place, *(F.coalesce(_part(points, i), F.lit("0")) for i in range(4)), F.lit("10000"))
    if tag in ("WAY+", "WAY-") and last < 10:
        return F.concat(F.array(number({n: str(i) for i, n in enumerate(MARKS)}, place)), F.slice("fields", 2, 1))
    if tag == "CST+" and last < 17:
        told = F.get("fields", F.lit(4))
        # What is left; when a cast's record is of its frame's time, as frames write them.
        gone = F.format_string("%.3f", _part(told, 1).try_cast("double") - _part(told, 0).try_cast("double"))
        return F.concat(F.slice("fields", 1, 4), F.array(F.concat_ws("/", gone, _part(told, 1))), F.slice("fields", 6, 2))
    if tag == "CLDA" and last < 20:
        return F.concat(F.array(F.lit("2")), *(F.array(F.get("fields", F.lit(i)), F.lit("1"), F.lit("1")) for i in range(2)))
    if tag == "CLDA" and last < 25:
        return F.concat(F.array(F.lit("2")), F.slice("fields", 1, 6))
    if tag == "DDMP" and last < 23:
        return F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.lpad(F.coalesce(F.nullif(F.substr(place, i * 2 + 1, F.lit(2)), F.lit("")), F.lit("0")), 4, "0"))
    if tag == "DDMP" and last < 29:
        return F.transform(F.slice("fields", 1, 25), lambda c: F.lpad(c, 4, "0"))
    # Fields have come and gone: what a version lacks is its default, what it has too many is left out.
    out, at = [], F.lit(0)
    version = F.col("version")
    for f in _NOW[tag]:
        there = version.between(f.first, f.last)
        if f.kind in ("list", "targets"):
            out.append(F.slice("fields", at + 1, F.greatest(F.size("fields") - at, F.lit(0))))
        elif f.last == LATEST:
            for k in range(f.width):
                raw = F.get("fields", at + k)
                out.append(F.array(F.when(there, raw if f.default is None else F.coalesce(raw, F.lit(f.default))).otherwise(F.lit(f.default))))
        at = at + F.when(there, F.lit(f.width)).otherwise(F.lit(0)) if (f.first, f.last) != (0, LATEST) else at + f.width
    found = F.concat(*out) if out else F.array().cast("array<string>")
    if tag == "CLCD":
        # Up to 18 the first number was what is left.
        left = F.transform(found, lambda c, i: F.when((i >= 2) & (i % 3 == 0), F.format_string("%s", F.get(found, i + 1).try_cast("double") - c.try_cast("double"))).otherwise(c))
        found = F.when(version < 19, left).otherwise(found)
    return found


def _changed(tag: str) -> bool:
    return tag in _OLDER or tag in ("CLCD", "TETH", "PAR ") or any((f.first, f.last) != (0, LATEST) for f in _NOW[tag])


def upgraded(records: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """`records` of known tags with the tags and fields of the latest version; `version` stays that of the log."""
    tag = F.col("tag")
    for old, now in ALIASES.items():
        tag = F.when(F.col("tag") == old, F.lit(now)).otherwise(tag)
    fields = F.col("fields")
    for t in tags:
        if _changed(t):
            first, new = 0, _now_from(t, LATEST, 0)
            for last, _ in reversed(_OLDER.get(t, [])):
                new = F.when(F.col("version") <= last, _now_from(t, last, first)).otherwise(new)
            fields = F.when(tag == t, new).otherwise(fields)
    # A log without a version is taken to be of the latest.
    old_tag = F.col("tag").isin(*ALIASES)
    if "ACT+" in tags:
        # With a higher-order function Spark makes a method of each part of these expressions, and of all of them together where
        # there is none. That one would be too long for Java to compile (8,000 bytes).
        old_tag = F.exists(F.array(*(F.lit(t) for t in ALIASES)), lambda old: old == F.col("tag"))
    fields = F.when((F.col("version") < LATEST) | old_tag, fields).otherwise(F.col("fields"))
    return records.withColumns({"fields": fields, "tag": tag})


# What a record's text must look like

_REAL = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|NaN|[-+]?(?:Infinity|∞)"
_HEX = "[0-9A-Fa-f]+"


def _grammar(f: Field) -> str:
    real, actor = f"(?:{_REAL})", rf"{_HEX}(?:/[^|]*)?"
    if f.kind == "list":
        items = r"\|".join(_grammar(p) for p in f.item)
        n = int(f.count) if f.count.isdigit() else None
        return rf"{items}(?:\|{items}){{{n - 1}}}" if n else rf"[0-9]+(?:\|{items})*"
    if f.kind[0] in "uix" and f.kind[1:2].isdigit():
        return {"u": "[0-9]+", "i": "-?[0-9]+", "x": _HEX}[f.kind[0]]
    if f.kind[0] == "f":
        return real
    known = {"text": "[^|]*", "void": "[^|]*", "class": r"\w+", "bool": "[Tt]rue|[Ff]alse", "actor": actor, "angle": real, "vector": f"{real}/{real}/{real}", "pair": f"{real}/{real}", "until": f"{real}/{real}"}
    known |= {"action": r"\w+(?: [0-9]+[^|]*)?", "bytes": "(?:[0-9A-Fa-f]{2})*", "status": rf"[0-9]+(?: [^|]*)?\|{_HEX}\|{real}\|{actor}", "targets": rf"{actor}(?:!{_HEX}){{0,8}}"}
    known |= {"place": rf"{_HEX}/{_HEX}/[^/|]*/\w+/{real}/{real}/{real}/{real}", "points": "[0-9]+/[0-9]+(?:/[0-9]+){0,2}"}
    return f"(?:{known[f.kind]})"


def grammar(tag: str, version: int = LATEST) -> str:
    """An expression for the fields of a record, joined by bars; more fields may follow, those with a default may be missing at the end."""
    out = ""
    of_now = ALIASES.get(tag, tag)
    fields = layout(of_now, version)
    if tag in ("TET-", "PAR-"):
        fields = fields[:1]
    for i, f in reversed(list(enumerate(fields))):
        bar = r"\|" if i else ""
        if f.kind == "targets":
            out = rf"(?:{bar}{_grammar(f)})*"
        elif f.default is not None and (f.first, f.last) == (0, LATEST):
            out = rf"(?:{bar}{_grammar(f)}{out})?"
        else:
            out = f"{bar}{_grammar(f)}{out}"
    return rf"^{out}(?:\|.*)?$" if fields else "^.*$"


def grammars() -> list[tuple[str, int, int, str]]:
    """(tag, first version, last version, expression) for all tags and versions."""
    out: list[tuple[str, int, int, str]] = []
    for tag in KNOWN:
        for version in range(OLDEST, LATEST + 1):
            g = grammar(tag, version)
            if out and out[-1][0] == tag and out[-1][3] == g:
                out[-1] = (tag, out[-1][1], version, g)
            else:
                out.append((tag, version, version, g))
    return out
