"""Queries for profiles and grouped analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.time import micros
from chronofold.operators import analysis
from chronofold.operators import profiles as P
from chronofold.plans.fixtures import DAY, E, HOUR, S, log_bounds, of_type, ops, statuses
from chronofold.plans.registry import query
from chronofold.sources.tables import table

TRANSITIONS = f"""{E}, t AS (SELECT user_id, event_id, event_type AS from_state, lead(event_type) OVER w AS to_state, (lead(us) OVER w - us) / 1e6 AS dur FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    "transition_outliers",
    f"""WITH {TRANSITIONS}, a AS (SELECT from_state, to_state, avg(dur) AS m, stddev_samp(dur) AS sd FROM t WHERE to_state IS NOT NULL GROUP BY 1, 2)
    SELECT t.event_id, t.from_state, t.to_state, round(t.dur, 3) AS dur_s FROM t JOIN a USING (from_state, to_state) WHERE abs(t.dur - a.m) > a.sd""",
)
def transition_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.transition_outliers(_transitions(spark, sf_dir)).select("event_id", "from_state", "to_state", F.round("dur", 3).alias("dur_s"))


@query(
    "transition_exclude",
    f"""WITH {TRANSITIONS} SELECT from_state, CASE WHEN to_state = 'click' THEN 'view' ELSE to_state END AS to_state, count(*) AS n, round(avg(dur), 3) AS avg_s
    FROM t WHERE to_state IS NOT NULL AND from_state <> 'error' AND user_id % 10 <> 3 GROUP BY 1, 2""",
)
def transition_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated anew without some logs and transitions, and with two transitions merged."""
    t = _transitions(spark, sf_dir).where("from_state <> 'error' AND user_id % 10 <> 3")
    t = t.withColumn("to_state", F.when(F.col("to_state") == "click", "view").otherwise(F.col("to_state")))
    return t.groupBy("from_state", "to_state").agg(F.count("*").alias("n"), F.round(F.avg("dur"), 3).alias("avg_s"))


def _join(c: str) -> str:
    return f"coalesce(nullif(array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE {c} IS NOT NULL)), '/'), ''), 'none')"


@query(
    "participant_profile",
    f"""WITH {E}, x AS (SELECT *, us // {30 * DAY} AS encounter FROM e)
    SELECT encounter, k % 8 AS oid, count(*) AS n, {_join("event_type")} AS types, {_join("k % 4")} AS zones, bool_or(event_type = 'purchase') AS ever_targetable, min(value) AS min_radius, max(value) AS max_radius
    FROM x GROUP BY 1, 2""",
)
def participant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir).withColumn("encounter", F.floor(F.col("us") / (30 * DAY))).withColumn("oid", F.col("k") % 8)
    return P.profile(e, ["encounter", "oid"], sets={"types": F.col("event_type"), "zones": F.col("k") % 4}, any_of={"ever_targetable": F.col("event_type") == "purchase"}, low={"min_radius": F.col("value")}, high={"max_radius": F.col("value")})


@query(
    "participant_profile_global",
    f"""WITH {E} SELECT k % 8 AS oid, count(*) AS n, {_join("event_type")} AS types, min(value) AS min_radius, max(value) AS max_radius,
    arg_max(event_type = 'purchase', (us, event_id)) AS seen_targetable FROM e GROUP BY 1""",
)
def participant_profile_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all encounters; the flag is the last one seen, not whether it was ever set."""
    e = ops(spark, sf_dir).withColumn("oid", F.col("k") % 8)
    return P.profile(e, ["oid"], sets={"types": F.col("event_type")}, low={"min_radius": F.col("value")}, high={"max_radius": F.col("value")}, last={"seen_targetable": F.col("event_type") == "purchase"}, order=("us", "event_id"))


@query(
    "ability_profile",
    f"""SELECT l_partkey % 50 AS action, count(*) AS n, {_join("l_suppkey % 7")} AS casters, {_join("l_linenumber")} AS targets, bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_discount > 0.05) AS any_discount,
    arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS cast_time FROM lineitem GROUP BY 1""",
)
def ability_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("action", F.col("l_partkey") % 50)
    return P.profile(l, ["action"], sets={"casters": F.col("l_suppkey") % 7, "targets": F.col("l_linenumber")}, any_of={"any_returned": F.col("l_returnflag") == "R", "any_discount": F.col("l_discount") > 0.05}, last={"cast_time": F.col("l_quantity")}, order=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))


@query("status_profile", f"WITH {E} SELECT event_type AS status, count(*) AS n, {_join('user_id % 5')} AS sources, {_join('k % 6')} AS targets, {_join('k')} AS extras FROM e GROUP BY 1")
def status_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir).withColumn("status", F.col("event_type"))
    return P.profile(e, ["status"], sets={"sources": F.col("user_id") % 5, "targets": F.col("k") % 6, "extras": F.col("k")})


@query("icon_profile", f"WITH {E} SELECT k % 10 AS icon, count(*) AS n, {_join('user_id % 5')} AS sources, bool_or(user_id % 5 <> k % 5) AS other_target FROM e WHERE event_type = 'view' GROUP BY 1")
def icon_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = of_type(ops(spark, sf_dir), "view").withColumn("icon", F.col("k") % 10)
    return P.profile(e, ["icon"], sets={"sources": F.col("user_id") % 5}, any_of={"other_target": F.col("user_id") % 5 != F.col("k") % 5})


@query("tether_profile", f"WITH {E}, {S} SELECT slot AS tether, count(*) AS n, {_join('status')} AS kinds, min(end_us - start_us) AS shortest_us, max(end_us - start_us) AS longest_us FROM s GROUP BY 1")
def tether_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statuses(ops(spark, sf_dir)).withColumn("tether", F.col("slot")).withColumn("d", F.col("end_us") - F.col("start_us"))
    return P.profile(s, ["tether"], sets={"kinds": F.col("status")}, low={"shortest_us": F.col("d")}, high={"longest_us": F.col("d")})


@query("mapeffect", f"WITH {E} SELECT k AS idx, event_type AS state, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY 1, 2")
def mapeffect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by index and state, in one pass for all indices."""
    return ops(spark, sf_dir).groupBy(F.col("k").alias("idx"), F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("director", f"WITH {E} SELECT k % 16 AS update_id, count(*) AS n, array_to_string(list(event_id ORDER BY us, event_id)[1:5], ',') AS first_events FROM e WHERE event_type = 'error' GROUP BY 1")
def director(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by id with the first five: each task ranks its own before the shuffle, so that five of an id travel from it."""
    e = of_type(ops(spark, sf_dir), "error").select((F.col("k") % 16).alias("update_id"), "us", "event_id")
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("update_id").orderBy("us", "event_id"))).where("r <= 5")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("event_id").cast("string").alias("e")))), lambda x: x["e"])
    first = ranked.groupBy(F.col("update_id").alias("own")).agg(F.array_join(texts, ",").alias("first_events"))
    counts = e.groupBy("update_id").agg(F.count("*").alias("n"))
    return counts.join(first, F.col("update_id").eqNullSafe(F.col("own"))).select("update_id", "n", "first_events")


#: An order's lines as the effects of an action on its targets.
EFFECTS = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount, (l_orderkey * 31 + l_linenumber * 7) % 16 AS type FROM lineitem)"


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("type", (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 16)


@query("unknown_effects", f"WITH {EFFECTS} SELECT CASE WHEN type = 0 THEN 'none' WHEN type < 8 THEN 'known' WHEN type < 12 THEN 'new' ELSE 'odd' END AS category, l_partkey % 50 AS action, count(*) AS n FROM x WHERE type >= 8 GROUP BY 1, 2")
def unknown_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("type")
    category = F.when(t == 0, "none").when(t < 8, "known").when(t < 12, "new").otherwise("odd")
    return _effects(spark, sf_dir).where(t >= 8).groupBy(category.alias("category"), (F.col("l_partkey") % 50).alias("action")).agg(F.count("*").alias("n"))


@query("lock_histogram", "SELECT l_suppkey % 10 AS action, CAST(round_even(l_discount * 1000, 0) AS BIGINT) AS bin, count(*) AS n, CAST(round_even(l_discount * 1000, 0) AS BIGINT) <> 50 AS differs FROM lineitem GROUP BY 1, 2")
def lock_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("action", F.col("l_suppkey") % 10)
    return P.histogram(l, ["action"], F.col("l_discount")).withColumn("differs", F.col("bin") != 50)


@query(
    "category_case",
    f"""WITH {E}, m AS (SELECT k, bit_or(CAST(1 AS BIGINT) << (user_id % 16)::INT) AS owners, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'error') AS failed FROM e GROUP BY 1)
    SELECT k, owners, bit_count(owners) AS n_owners, CASE WHEN failed AND bought THEN 'mixed' WHEN bought THEN 'bought' WHEN bit_count(owners) = 1 THEN 'single' ELSE 'shared' END AS category FROM m""",
)
def category_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first category whose condition holds, on a mask of owners."""
    m = ops(spark, sf_dir).groupBy("k").agg(P.mask(F.col("user_id") % 16).alias("owners"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    category = F.when(F.col("failed") & F.col("bought"), "mixed").when(F.col("bought"), "bought").when(F.bit_count("owners") == 1, "single").otherwise("shared")
    return m.select("k", "owners", F.bit_count("owners").alias("n_owners"), category.alias("category"))


@query("inverted_index", f"SELECT l_returnflag AS status, l_suppkey % 5 AS class, {_join('l_partkey % 20')} AS actions, bool_or(l_linestatus = 'O') AS on_source, bool_or(l_linestatus = 'F') AS on_target FROM lineitem GROUP BY 1, 2")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("status", F.col("l_returnflag")).withColumn("class", F.col("l_suppkey") % 5)
    return P.profile(l, ["status", "class"], sets={"actions": F.col("l_partkey") % 20}, any_of={"on_source": F.col("l_linestatus") == "O", "on_target": F.col("l_linestatus") == "F"}).drop("n")


@query("effect_sum", "SELECT l_orderkey, round(sum(CASE WHEN l_quantity > 0 AND l_returnflag <> 'R' THEN l_quantity ELSE 0 END), 2) AS damage, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_effects FROM lineitem GROUP BY 1")
def effect_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each action's array of effects: those not applied at the source."""
    actions = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("effects"))
    kept = F.filter("effects", lambda x: x["l_returnflag"] != "R")
    return actions.select("l_orderkey", F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("damage"), F.size(kept).cast("long").alias("n_effects"))


@query("damage_heal", f"WITH {EFFECTS} SELECT l_suppkey % 20 AS actor, l_partkey % 10 AS action, round(sum(CASE WHEN type < 6 THEN l_quantity ELSE 0 END), 2) AS damage, round(sum(CASE WHEN type BETWEEN 6 AND 9 THEN l_quantity ELSE 0 END), 2) AS heal FROM x GROUP BY 1, 2")
def damage_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("type")
    return _effects(spark, sf_dir).groupBy((F.col("l_suppkey") % 20).alias("actor"), (F.col("l_partkey") % 10).alias("action")).agg(F.round(F.sum(F.when(t < 6, F.col("l_quantity")).otherwise(0)), 2).alias("damage"), F.round(F.sum(F.when(t.between(6, 9), F.col("l_quantity")).otherwise(0)), 2).alias("heal"))


@query("avg_positive", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.03 THEN l_quantity END), 6) AS avg_hit, count(CASE WHEN l_discount > 0.03 THEN 1 END) AS n_hits FROM lineitem GROUP BY 1")
def avg_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_discount") > 0.03
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(hit, F.col("l_quantity"))), 6).alias("avg_hit"), F.count_if(hit).alias("n_hits"))


@query("party_health", "SELECT c_nationkey AS party, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS sd_pop, arg_min(c_custkey, (c_acctbal, c_custkey)) AS lowest FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1")
def party_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").withColumnRenamed("c_nationkey", "party")
    return P.deviations(c, ["party"], "c_acctbal", "c_custkey").select("party", "n", F.round("mean", 6).alias("mean"), F.round("sd_pop", 6).alias("sd_pop"), "lowest")


@query("pending_delta", f"WITH {E}, {S}, t AS (SELECT (min(us) + max(us)) // 2 AS moment FROM e) SELECT user_id, CAST(sum(slot + 1) AS BIGINT) AS pending, count(*) AS n_open FROM s, t WHERE start_us <= moment AND moment < end_us GROUP BY 1")
def pending_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of what is open at one moment."""
    e = ops(spark, sf_dir)
    low, high = e.agg(F.min("us"), F.max("us")).first()
    at = F.lit(((low or 0) + (high or 0)) // 2)
    return statuses(e).where((F.col("start_us") <= at) & (at < F.col("end_us"))).groupBy("user_id").agg(F.sum(F.col("slot") + 1).alias("pending"), F.count("*").alias("n_open"))


@query("count_condition", f"WITH {E} SELECT user_id, count(*) FILTER (WHERE value > 50) AS n_match, count(*) FILTER (WHERE NOT value > 50) AS n_mismatch FROM e GROUP BY 1")
def count_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("value") > 50
    return ops(spark, sf_dir).groupBy("user_id").agg(F.count_if(c).alias("n_match"), F.count_if(~c).alias("n_mismatch"))


@query("cast_count", f"WITH {E} SELECT user_id, k % 5 AS action, count(*) AS n_casts FROM e WHERE event_type = 'click' GROUP BY 1, 2")
def cast_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_type(ops(spark, sf_dir), "click").groupBy("user_id", (F.col("k") % 5).alias("action")).agg(F.count("*").alias("n_casts"))


@query("mask_agg", f"WITH {E}, m AS (SELECT user_id, bit_or(CAST(1 AS BIGINT) << (k % 60)::INT) AS m FROM e GROUP BY 1) SELECT user_id, m, bit_count(m) AS n_set, CAST(log2(m & -m) AS BIGINT) AS lowest, CAST(floor(log2(m)) AS BIGINT) AS highest FROM m")
def mask_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops(spark, sf_dir).groupBy("user_id").agg(P.mask(F.col("k") % 60).alias("m"))
    low = F.bit_count((F.col("m").bitwiseAND(-F.col("m"))) - 1)
    return m.select("user_id", "m", F.bit_count("m").alias("n_set"), low.cast("long").alias("lowest"), (F.length(F.bin("m")) - 1).cast("long").alias("highest"))


@query("bbox", "SELECT label, round(min(embedding[1]) - 1, 5) AS x0, round(max(embedding[1]) + 1, 5) AS x1, round(min(embedding[2]) - 1, 5) AS z0, round(max(embedding[2]) + 1, 5) AS z1 FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) GROUP BY 1")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(*(F.round(c, 5).alias(n) for n, c in (("x0", F.min(x) - 1), ("x1", F.max(x) + 1), ("z0", F.min(z) - 1), ("z1", F.max(z) + 1))))


@query("sorted_distinct", f"WITH {E} SELECT user_id, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks FROM e GROUP BY 1")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("k")), lambda x: x.cast("string")), ",").alias("ks"))


@query("argmin", f"WITH {E} SELECT user_id, arg_min(event_id, (value, event_id)) AS lowest, arg_max(event_id, (value, -event_id)) AS highest FROM e GROUP BY 1")
def argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of equals wins on both ends."""
    return ops(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("lowest"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("highest"))


@query("sort_desc", f"WITH {E} SELECT user_id, max(us) - min(us) AS span_us, row_number() OVER (ORDER BY max(us) - min(us) DESC, user_id) AS place FROM e GROUP BY 1")
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by length. The rank over all is of one row per log, after the aggregation."""
    spans = ops(spark, sf_dir).groupBy("user_id").agg((F.max("us") - F.min("us")).alias("span_us"))
    return spans.withColumn("place", F.row_number().over(Window.orderBy(F.desc("span_us"), "user_id")).cast("long"))


@query("sort_multi", f"WITH {E} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, value, event_id) AS place FROM e")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_type"), "value", "event_id")
    return ops(spark, sf_dir).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("top_ties", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) = 1")
def top_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_ties(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderpriority"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("set_except", f"WITH {E} SELECT DISTINCT user_id, k FROM e WHERE event_type = 'view' EXCEPT SELECT user_id, k FROM e WHERE event_type = 'error'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops(spark, sf_dir)
    return of_type(e, "view").select("user_id", "k").subtract(of_type(e, "error").select("user_id", "k"))


@query("confirm_match", "SELECT o.o_orderkey, l.l_linenumber, (epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 1e6 AS delay_s FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o.o_orderkey, l.l_linenumber ORDER BY l.l_shipdate, l.l_partkey, l.l_suppkey) = 1")
def confirm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations matched to actions by sequence and target; the first one counts."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", micros("o_orderdate").alias("asked"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    first = l.groupBy("o_orderkey", "l_linenumber").agg(F.min(micros("l_shipdate")).alias("got"))
    return o.join(first, "o_orderkey").select("o_orderkey", "l_linenumber", ((F.col("got") - F.col("asked")) / 1e6).alias("delay_s"))


@query("confirm_mispredict", "SELECT l_orderkey, bool_or(l_returnflag = 'A') AS expected, bool_or(l_linestatus = 'F') AS observed FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') <> bool_or(l_linestatus = 'F')")
def confirm_mispredict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected confirmations that are missing, and unexpected ones."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus")).alias("x"))
    expected, observed = F.exists("x", lambda e: e["l_returnflag"] == "A"), F.exists("x", lambda e: e["l_linestatus"] == "F")
    return a.select("l_orderkey", expected.alias("expected"), observed.alias("observed")).where("expected <> observed")


@query("dim_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_regionkey, -1) AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dimension by id, with a stand-in where there is none; the planner broadcasts what is small enough."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0")
    c = table(spark, sf_dir, "customer")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_regionkey", F.lit(-1)).alias("region"))


@query(
    "pending_ttl",
    f"""WITH {E}, p AS (SELECT user_id, event_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us FROM e WHERE event_type = 'click')
    SELECT p.event_id, p.us AS start_us, least(coalesce(c.us, p.us + {12 * HOUR}), p.us + {12 * HOUR}) AS end_us, coalesce(c.us <= p.us + {12 * HOUR}, false) AS confirmed FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us <= c.us""",
)
def pending_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a confirmation ends with it, or after its time to live."""
    from chronofold.operators.temporal import as_of

    e = ops(spark, sf_dir)
    c = of_type(e, "click").select("user_id", "us", F.col("us").alias("c_us"))
    p = as_of(of_type(e, "purchase").select("user_id", "us", "event_id"), c, ["user_id"], "us", ["c_us"], direction="forward")
    limit = F.col("us") + 12 * HOUR
    return p.select("event_id", F.col("us").alias("start_us"), F.least(F.coalesce("c_us", limit), limit).alias("end_us"), F.coalesce(F.col("c_us") <= limit, F.lit(False)).alias("confirmed"))


@query(
    "cooldown_next",
    f"""WITH {E}, t AS (SELECT (min(us) + max(us)) // 2 AS moment FROM e),
    r AS (SELECT user_id, max(us) AS reset_us FROM e, t WHERE event_type = 'signup' AND us <= moment GROUP BY 1),
    u AS (SELECT e.user_id, k % 3 AS ability, max(us) AS used_us FROM e JOIN t ON us <= moment LEFT JOIN r ON e.user_id = r.user_id WHERE event_type = 'click' AND us > coalesce(reset_us, -1) GROUP BY 1, 2)
    SELECT user_id, min(greatest(0, used_us + (CASE WHEN ability = 0 THEN 120 ELSE 30 END) * {HOUR} - moment)) AS remaining_us FROM u, t GROUP BY 1""",
)
def cooldown_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least time until an ability is ready again; a reset forgets earlier uses."""
    at = sum(log_bounds(spark, sf_dir)) // 2
    past = ops(spark, sf_dir, last=at)
    reset = of_type(past, "signup").groupBy("user_id").agg(F.max("us").alias("reset_us"))
    used = of_type(past, "click").join(reset, "user_id", "left").where(F.col("us") > F.coalesce("reset_us", F.lit(-1))).groupBy("user_id", (F.col("k") % 3).alias("ability")).agg(F.max("us").alias("used_us"))
    ready = F.col("used_us") + F.when(F.col("ability") == 0, 120).otherwise(30) * F.lit(HOUR) - at
    return used.groupBy("user_id").agg(F.min(F.greatest(F.lit(0).cast("long"), ready)).alias("remaining_us"))


@query("timer_decay", f"WITH {E} SELECT event_id, round(greatest(100000.0 - sum(d) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0.0), 3) AS left_s FROM (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 1e6, 0) AS d FROM e)")
def timer_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timer that each frame's length counts down, in closed form."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    d = ops(spark, sf_dir).withColumn("d", F.coalesce((F.col("us") - F.lag("us").over(w)) / F.lit(1e6), F.lit(0.0)))
    return d.select("event_id", F.round(F.greatest(F.lit(100000.0) - F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)), 3).alias("left_s"))
