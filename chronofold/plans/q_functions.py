"""Queries for filters, text and bit functions, and geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import codec as C
from chronofold.functions import geometry as G
from chronofold.functions.time import micros
from chronofold.plans.fixtures import DAY, E, of_type, ops
from chronofold.plans.registry import query
from chronofold.sources.tables import table

# -- filters --------------------------------------------------------------------------------------


@query("op_filter", f"WITH {E} SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'always' WHEN event_type = 'error' THEN 'conditional' ELSE 'other' END AS class FROM e WHERE event_type <> 'signup' AND (event_type <> 'error' OR k % 2 = 0)")
def op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that are hidden, shown always, and shown on a condition."""
    t = F.col("event_type")
    shown = (t != "signup") & ((t != "error") | (F.col("k") % 2 == 0))
    return ops(spark, sf_dir).where(shown).select("event_id", "event_type", F.when(t == "purchase", "always").when(t == "error", "conditional").otherwise("other").alias("class"))


@query("status_filter", f"WITH {E} SELECT event_id, k FROM e WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND event_type IN ('view', 'click')")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without what a list of ids denies."""
    denied = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k"))
    return of_type(ops(spark, sf_dir), "view", "click").join(denied, "k", "left_anti").select("event_id", "k")


@query("mask_filter", f"WITH {E} SELECT event_id, k FROM e WHERE k BETWEEN 0 AND 62 AND ((1234567890123 >> k::INT) & 1) = 1")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a set of bits; other ids are no members."""
    bit = F.call_function("shiftright", F.lit(1234567890123).cast("long"), F.col("k").cast("int")).bitwiseAND(1) == 1
    return ops(spark, sf_dir).where(F.col("k").between(0, 62) & bit).select("event_id", "k")


@query("party_select", f"WITH {E} SELECT event_id, k, CASE WHEN k BETWEEN 0 AND 7 THEN 'party' WHEN k BETWEEN 8 AND 23 THEN 'alliance' ELSE 'npc' END AS part FROM e WHERE k BETWEEN 0 AND 63 AND (event_type <> 'error' OR k < 8)")
def party_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return ops(spark, sf_dir).where(k.between(0, 63) & ((F.col("event_type") != "error") | (k < 8))).select("event_id", "k", F.when(k.between(0, 7), "party").when(k.between(8, 23), "alliance").otherwise("npc").alias("part"))


@query("text_match", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND NOT contains(lower(p_name), 'e')")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("p_name")
    return table(spark, sf_dir, "part").where(F.contains(low, F.lit("a")) & ~F.contains(low, F.lit("e"))).select("p_partkey", "p_name")


# -- text, bits, arrays ---------------------------------------------------------------------------


@query("hex_codec", "SELECT o_orderkey, lpad(upper(format('{:x}', o_orderkey)), 8, '0') AS hex8, CAST(o_orderkey * 16 + 15 AS BIGINT) AS back, format('{:.3f}', o_totalprice) AS f3 FROM orders")
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", C.to_hex(F.col("o_orderkey")).alias("hex8"))
    return o.select("o_orderkey", "hex8", C.from_hex(F.concat("hex8", F.lit("F"))).cast("long").alias("back"), F.format_string("%.3f", F.col("o_totalprice")).alias("f3"))


@query("ts_parse", "SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS text FROM events")
def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text with seven fractional digits and back; the seventh is dropped."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("text"))
    return e.select("event_id", micros(F.concat("text", F.lit("7")).cast("timestamp_ntz")).alias("us"), "text")


@query("identifier", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(lower(replace(p_name, '''', '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS ident FROM part")
def identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.identifier(F.col("p_name")).alias("ident"))


@query("path_extract", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, 'Brand\\D{0,3}(\\d{1,9})', 1), '') AS INTEGER) AS number, CASE WHEN p_size > 40 THEN 'large ' || p_size WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS shape FROM part")
def path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    shape = F.when(s > 40, F.format_string("large %d", s)).when(s > 20, "medium").otherwise("small")
    return table(spark, sf_dir, "part").select("p_partkey", C.number_after(F.col("p_brand"), "Brand").alias("number"), shape.alias("shape"))


@query("json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS lacks FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("lacks"))


@query("enum_text", "SELECT s_suppkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'even' END, CASE WHEN s_suppkey % 3 = 0 THEN 'three' END, CASE WHEN s_suppkey % 5 = 0 THEN 'five' END], lambda x: x IS NOT NULL), '/'), ''), 'none') AS names FROM supplier")
def enum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.when(F.col("s_suppkey") % n == 0, t) for n, t in ((2, "even"), (3, "three"), (5, "five"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.nullif(F.array_join(names, "/"), F.lit("")), F.lit("none")).alias("names"))


PACKED = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296 AS w FROM lineitem)"


@query("effect_decode", f"WITH {PACKED} SELECT l_orderkey, l_linenumber, l_partkey, w & 255 AS type, (w >> 8) & 15 AS low, (w >> 12) & 15 AS high, ((w >> 8) & 32) <> 0 AS crit, ((w >> 16) & 65535) + CASE WHEN ((w >> 8) & 64) <> 0 THEN (w & 255) * 65536 ELSE 0 END AS value, CASE WHEN (w & 255) = 0 THEN 'none' WHEN (w & 255) < 64 THEN 'damage' WHEN (w & 255) < 128 THEN 'heal' ELSE 'other' END AS kind FROM p")
def effect_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of packed effects."""
    w = F.pmod(F.col("l_orderkey") * F.lit(2654435761) + F.col("l_partkey") * 40503, F.lit(4294967296))
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("w"))
    kind, flags = C.bits(F.col("w"), 0, 8), C.bits(F.col("w"), 8, 8)
    name = F.when(kind == 0, "none").when(kind < 64, "damage").when(kind < 128, "heal").otherwise("other")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("type"), C.bits(F.col("w"), 8, 4).alias("low"), C.bits(F.col("w"), 12, 4).alias("high"), (flags.bitwiseAND(32) != 0).alias("crit"), C.damage(C.bits(F.col("w"), 16, 16), kind, flags).alias("value"), name.alias("kind"))


@query("kv_array", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey * 2 WHEN 2 THEN 7 END AS found FROM orders")
def kv_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value pairs in one flat array, read as a map; a missing key gives NULL."""
    flat = F.array(F.lit(0).cast("long"), F.col("o_custkey"), F.lit(1).cast("long"), F.col("o_orderkey") * 2, F.lit(2).cast("long"), F.lit(7).cast("long"))
    half = lambda odd: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(flat, 2 * i + odd))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(F.map_from_arrays(half(0), half(1)), F.col("o_orderkey") % 4).alias("found"))


@query("array_get", "SELECT vec_id, round(CAST(CASE WHEN label - 2 >= 0 THEN embedding[label - 1] END AS DOUBLE), 6) AS x, round(greatest(-0.1, least(0.1, CAST(embedding[1] AS DOUBLE))), 6) AS clamped FROM embeddings")
def array_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads outside an array give NULL."""
    at = F.get("embedding", F.col("label") - 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(at.cast("double"), 6).alias("x"), F.round(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.get("embedding", F.lit(0)).cast("double"))), 6).alias("clamped"))


@query("array_rotate", "SELECT o_orderkey, array_to_string([[1,2,3,4,5][1 + (i + o_orderkey % 5) % 5] FOR i IN range(5)], ',') AS turned FROM orders")
def array_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = C.rotated(F.array(*(F.lit(i) for i in range(1, 6))), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(turned, lambda x: x.cast("string")), ",").alias("turned"))


@query("array_diff", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 <> o_custkey % 2 THEN '0:' || (o_custkey % 2) END, CASE WHEN o_orderkey % 3 <> o_custkey % 3 THEN '1:' || (o_custkey % 3) END, CASE WHEN o_orderkey % 5 <> o_custkey % 5 THEN '2:' || (o_custkey % 5) END], lambda x: x IS NOT NULL), ',') AS diff, (o_custkey % 2 <> 0)::BIGINT + (o_custkey % 3 <> 0)::BIGINT + (o_custkey % 5 <> 0)::BIGINT AS nonzero FROM orders")
def array_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two arrays, and what is not zero."""
    arr = lambda c: F.array(*(F.col(c) % n for n in (2, 3, 5)))
    diff = F.transform(C.changed(arr("o_orderkey"), arr("o_custkey")), lambda p: F.concat_ws(":", p["i"].cast("string"), p["value"].cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(diff, ",").alias("diff"), F.size(C.compacted(arr("o_custkey"))).cast("long").alias("nonzero"))


@query("dequantize", "SELECT o_orderkey, round((o_orderkey * 7919 % 65536) * 2000.0 / 65535 - 1000, 6) AS x FROM orders")
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(C.dequantise(F.pmod(F.col("o_orderkey") * 7919, F.lit(65536)), -1000.0, 1000.0), 6).alias("x"))


# -- geometry -------------------------------------------------------------------------------------

P = "p AS (SELECT vec_id, label, 10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS z, 10 * CAST(embedding[3] AS DOUBLE) AS u, 10 * CAST(embedding[4] AS DOUBLE) AS v FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions (x, z) and a second pair (u, v)."""
    at = lambda i: 10 * F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("z"), at(2).alias("u"), at(3).alias("v"))


def xz() -> G.Vec:
    return F.col("x"), F.col("z")


def uv() -> G.Vec:
    return F.col("u"), F.col("v")


def zero() -> G.Vec:
    return F.lit(0.0), F.lit(0.0)


def _r(c: Column, name: str) -> Column:
    """Rounded, and never a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


@query("vec_math", f"WITH {P} SELECT vec_id, round(x * u + z * v, 6) + 0.0 AS dot, round(x * v - z * u, 6) + 0.0 AS crs, round(sqrt(x * x + z * z), 6) + 0.0 AS len, round(x / nullif(sqrt(x * x + z * z), 0), 6) + 0.0 AS nx, round(x * cos(0.5) + z * sin(0.5), 6) + 0.0 AS rx, round(z * cos(0.5) - x * sin(0.5), 6) + 0.0 AS rz FROM p")
def vec_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = G.rotate(xz(), F.lit(0.5))
    return points(spark, sf_dir).select("vec_id", _r(G.dot(xz(), uv()), "dot"), _r(G.cross(xz(), uv()), "crs"), _r(G.length(xz()), "len"), _r(G.normalise(xz())[0], "nx"), _r(turned[0], "rx"), _r(turned[1], "rz"))


@query("angle_math", f"WITH {P} SELECT vec_id, round(atan2(x, z), 6) + 0.0 AS a, round(abs(pi() - ((pi() - (atan2(x, z) - atan2(u, v))) - 2 * pi() * floor((pi() - (atan2(x, z) - atan2(u, v))) / (2 * pi())))), 6) + 0.0 AS between_ FROM p")
def angle_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", _r(G.to_angle(xz()), "a"), _r(G.angle_between(G.to_angle(xz()), G.to_angle(uv())), "between_"))


#: Facing 0.7, as (sine, cosine), and the local coordinates of the oracles.
_L = "l AS (SELECT *, x * cos(0.7) - z * sin(0.7) AS side, x * sin(0.7) + z * cos(0.7) AS ahead, sqrt(x * x + z * z) AS r FROM p)"
_SHAPES = {
    "circle": "r - 1.5",
    "donut": "greatest(1 - r, r - 2)",
    "rect": "greatest(ahead - 3, -ahead - 1, abs(side) - 0.8)",
    "crs": "least(greatest(abs(ahead) - 3, abs(side) - 0.5), greatest(abs(side) - 3, abs(ahead) - 0.5))",
    "cone": "greatest(r - 3, side * cos(0.6) - ahead * sin(0.6), -side * cos(0.6) - ahead * sin(0.6))",
    "sector": "greatest(r - 3, side * cos(0.6) - ahead * sin(0.6), -side * cos(0.6) - ahead * sin(0.6), 1 - r)",
    "capsule": "sqrt(side * side + (ahead - greatest(0, least(2, ahead))) * (ahead - greatest(0, least(2, ahead)))) - 0.7",
    "plane": "x * sin(0.7) + z * cos(0.7)",
}


def _shapes() -> dict[str, Column]:
    f, d = F.lit(0.7), lambda x: F.lit(float(x))
    return {
        "circle": G.sd_circle(xz(), zero(), d(1.5)),
        "donut": G.sd_donut(xz(), zero(), d(1), d(2)),
        "rect": G.sd_rect(xz(), zero(), f, d(3), d(1), d(0.8)),
        "crs": G.sd_cross(xz(), zero(), f, d(3), d(0.5)),
        "cone": G.sd_cone(xz(), zero(), f, 0.6, d(3)),
        "sector": G.sd_donut_sector(xz(), zero(), f, 0.6, d(1), d(3)),
        "capsule": G.sd_capsule(xz(), zero(), f, d(2), d(0.7)),
        "plane": G.sd_half_plane(xz(), zero(), G.direction(f)),
    }


@query("sdf", f"WITH {P}, {_L} SELECT vec_id, {', '.join(f'round({s}, 6) + 0.0 AS {n}' for n, s in _SHAPES.items())}, round(least({_SHAPES['circle']}, {_SHAPES['rect']}), 6) + 0.0 AS joined, round(greatest({_SHAPES['circle']}, {_SHAPES['rect']}), 6) + 0.0 AS common FROM l")
def sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances to shapes, their union and intersection."""
    s = _shapes()
    return points(spark, sf_dir).select("vec_id", *(_r(c, n) for n, c in s.items()), _r(G.sd_union(s["circle"], s["rect"]), "joined"), _r(G.sd_intersection(s["circle"], s["rect"]), "common"))


@query("in_shape", f"WITH {P}, {_L} SELECT vec_id, {', '.join(f'({s}) <= 0 AS {n}' for n, s in _SHAPES.items())} FROM l")
def in_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", *(G.inside(c).alias(n) for n, c in _shapes().items()))


_POLYGON = [(-2.0, -1.0), (-1.0, 2.0), (0.5, 0.5), (2.0, 2.0), (1.5, -1.5)]
_EDGES = list(zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]], strict=True))


@query("in_polygon", f"WITH {P} SELECT vec_id, ({' + '.join(f'CASE WHEN ({a[1]} > z) <> ({b[1]} > z) AND x < ({b[0]} - {a[0]}) * (z - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END' for a, b in _EDGES)}) % 2 = 1 AS hit FROM p".replace("- -", "+ "))
def in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", G.in_polygon(xz(), _POLYGON).alias("hit"))


@query(
    "polygon_centroid",
    f"""WITH {P}, o AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(z) OVER w, first_value(z) OVER w) AS z1 FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    s AS (SELECT label, sum(x * z1 - x1 * z) / 2 AS area, sum((x + x1) * (x * z1 - x1 * z)) AS sx FROM o GROUP BY 1)
    SELECT label, round(area, 4) + 0.0 AS area, round(sx / (6 * area), 2) + 0.0 AS cx FROM s""",
)
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centre of the ring of each group's points."""
    w = Window.partitionBy("label").orderBy("vec_id")
    ring = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    o = points(spark, sf_dir).withColumn("x1", ring("x")).withColumn("z1", ring("z"))
    c = F.col("x") * F.col("z1") - F.col("x1") * F.col("z")
    s = o.groupBy("label").agg((F.sum(c) / 2).alias("area"), F.sum((F.col("x") + F.col("x1")) * c).alias("sx"))
    return s.select("label", (F.round("area", 4) + F.lit(0.0)).alias("area"), (F.round(F.col("sx") / (6 * F.col("area")), 2) + F.lit(0.0)).alias("cx"))


@query(
    "ray_intersect",
    f"""WITH {P}, q AS (SELECT *, -(x * sin(0.3) + z * cos(0.3)) AS along, x * x + z * z AS d2 FROM p),
    t AS (SELECT *, sin(0.3) * 3 + cos(0.3) * 2 AS turn FROM q)
    SELECT vec_id, round(CASE WHEN sqrt(d2) <= 1 THEN 0 WHEN d2 - along * along <= 1 AND along > 0 THEN along - sqrt(greatest(1 - (d2 - along * along), 0)) END, 6) + 0.0 AS circle,
    round(CASE WHEN ((1 - x) * 3 - (2 - z) * -2) / turn >= 0 AND ((1 - x) * cos(0.3) - (2 - z) * sin(0.3)) / turn BETWEEN 0 AND 1 THEN ((1 - x) * 3 - (2 - z) * -2) / turn END, 6) + 0.0 AS segment FROM t""",
)
def ray_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from each point along one direction to a circle and to a segment."""
    unit, d = G.direction(F.lit(0.3)), lambda x: F.lit(float(x))
    return points(spark, sf_dir).select("vec_id", _r(G.ray_circle(xz(), unit, zero(), d(1)), "circle"), _r(G.ray_segment(xz(), unit, (d(1), d(2)), (d(-1), d(5))), "segment"))


@query("curve_approx", f"WITH {P} SELECT vec_id, i, round(x + 2 * sin(0.1 + 1.4 * i / 8), 6) + 0.0 AS px, round(z + 2 * cos(0.1 + 1.4 * i / 8), 6) + 0.0 AS pz FROM p, range(9) t(i)")
def curve_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = G.arc_points(xz(), F.lit(2.0), 0.1, 1.5, 8)
    return points(spark, sf_dir).select("vec_id", F.posexplode(pts).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), _r(F.col("p.x"), "px"), _r(F.col("p.z"), "pz"))


@query("radius_filter", f"WITH {P} SELECT vec_id, label, round(x * x + z * z, 6) + 0.0 AS d2 FROM p WHERE x * x + z * z <= 2.25 AND label <> 0")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d2 = G.dot(xz(), xz())
    return points(spark, sf_dir).where((d2 <= 2.25) & (F.col("label") != 0)).select("vec_id", "label", _r(d2, "d2"))


@query("sort_distance", f"WITH {P} SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY x * x + z * z, vec_id) AS place FROM p")
def sort_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(G.dot(xz(), xz()), "vec_id")
    return points(spark, sf_dir).select("label", "vec_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "clock_order",
    f"""WITH {P}, a AS (SELECT *, atan2(x, z) AS ang FROM p), s AS (SELECT label, arg_min(ang, vec_id) AS start FROM a GROUP BY 1)
    SELECT a.label, a.vec_id, row_number() OVER (PARTITION BY a.label ORDER BY round((start - ang) - 2 * pi() * floor((start - ang) / (2 * pi())), 9), a.vec_id) AS place FROM a JOIN s USING (label)""",
)
def clock_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clockwise from the first of each group."""
    a = points(spark, sf_dir).withColumn("ang", G.to_angle(xz()))
    s = a.groupBy("label").agg(F.min_by("ang", "vec_id").alias("start"))
    turn = F.round(F.pmod(F.col("start") - F.col("ang"), F.lit(2 * math.pi)), 9)
    return a.join(s, "label").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(turn, "vec_id")).cast("long").alias("place"))
