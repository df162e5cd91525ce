"""DuckDB SQL for the folds: one recursion step takes the next row of every log at once."""

from __future__ import annotations

from chronofold.operators import fsm
from chronofold.plans.fixtures import HOUR, E
from chronofold.plans.q_functions import P

#: Each log's rows numbered in order.
_R = f"{E}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e)"
_NEXT = "FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1"
#: The state after the last row of each log.
_END = "SELECT f.* FROM f JOIN (SELECT user_id, max(i) AS i FROM r GROUP BY user_id) USING (user_id, i)"

EMA = f"""WITH RECURSIVE {_R}, f AS (
  SELECT user_id, i, us, event_id, value AS mean FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, r.us, r.event_id, f.mean + (r.value - f.mean) * least(1::DOUBLE, (r.us - f.us) / {24 * HOUR}::DOUBLE) {_NEXT})
SELECT user_id, event_id, round(mean, 6) AS average FROM f"""

CDC = f"""WITH RECURSIVE {_R}, f AS (
  SELECT user_id, i, event_id, value AS sent, true AS passed FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, r.event_id, CASE WHEN abs(r.value - f.sent) > 20 THEN r.value ELSE f.sent END, abs(r.value - f.sent) > 20 {_NEXT})
SELECT user_id, event_id, sent AS value FROM f WHERE passed"""

NAMES = """WITH RECURSIVE r AS MATERIALIZED (SELECT p_brand AS brand, p_partkey, split_part(lower(p_name), ' ', 1) AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
f AS (
  SELECT brand, i, p_partkey, name AS own, [name] AS used FROM r WHERE i = 1
  UNION ALL SELECT brand, i, p_partkey, own, list_append(used, own) FROM (
    SELECT r.brand, r.i, r.p_partkey, f.used, CASE WHEN list_contains(f.used, r.name)
      THEN concat(r.name, list_filter(range(1, len(f.used) + 2), lambda n: NOT list_contains(f.used, concat(r.name, n)))[1]) ELSE r.name END AS own
    FROM f JOIN r ON r.brand = f.brand AND r.i = f.i + 1))
SELECT brand, p_partkey, own AS unique_name FROM f"""

REQUESTS = f"""WITH RECURSIVE {_R}, f AS (
  SELECT user_id, 0::BIGINT AS i, []::STRUCT(id BIGINT, k BIGINT)[] AS asked, NULL::BIGINT AS request, NULL::BIGINT AS response, NULL::VARCHAR AS outcome FROM r WHERE i = 1
  UNION ALL SELECT user_id, i, CASE WHEN event_type = 'click' THEN list_append(asked, {{'id': event_id, 'k': k}}) WHEN hit IS NULL THEN asked ELSE list_filter(asked, lambda q: q.id <> hit) END,
    hit, event_id, CASE event_type WHEN 'purchase' THEN 'confirmed' ELSE 'rejected' END
  FROM (SELECT r.user_id, r.i, r.event_id, r.event_type, r.k, f.asked, CASE
      WHEN r.event_type = 'purchase' OR r.event_type = 'error' AND r.k % 8 <> 0 THEN list_filter(f.asked, lambda q: q.k % 8 = r.k % 8)[-1].id
      WHEN r.event_type = 'error' THEN list_filter(f.asked, lambda q: q.k = r.k)[-1].id END AS hit {_NEXT}))
SELECT user_id, request, response, outcome FROM f WHERE request IS NOT NULL
UNION ALL SELECT user_id, unnest(asked).id, NULL, 'open' FROM ({_END})"""

PROTOCOL = f"""WITH RECURSIVE {_R}, f AS (
  SELECT user_id, 0::BIGINT AS i, []::STRUCT(id BIGINT, k BIGINT)[] AS queue, []::BIGINT[] AS answered, NULL::BIGINT AS event_id, NULL::VARCHAR AS warning FROM r WHERE i = 1
  UNION ALL SELECT user_id, i,
    CASE WHEN event_type = 'click' THEN list_append(queue, {{'id': event_id, 'k': k}}) WHEN event_type = 'purchase' AND place > 0 THEN list_concat(queue[:place - 1], queue[place + 1:]) ELSE queue END,
    CASE WHEN event_type = 'purchase' AND place > 0 THEN list_append(answered, k % 16) ELSE answered END, event_id,
    CASE WHEN event_type = 'click' AND list_contains(list_transform(queue, lambda q: q.k), k) THEN 'repeated request'
      WHEN event_type = 'purchase' AND place > 1 THEN concat('overtakes ', place - 1)
      WHEN event_type = 'purchase' AND place = 0 THEN CASE WHEN list_contains(answered, k % 16) THEN 'answered twice' ELSE 'unexpected answer' END END
  FROM (SELECT r.user_id, r.i, r.event_id, r.event_type, r.k, f.queue, f.answered, coalesce(list_position(list_transform(f.queue, lambda q: q.k % 16), r.k % 16), 0) AS place {_NEXT}))
SELECT user_id, event_id, warning FROM f WHERE warning IS NOT NULL
UNION ALL SELECT user_id, unnest(queue).id, 'never answered' FROM ({_END})"""

CHARGES = f"""WITH RECURSIVE {E}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e WHERE event_type = 'click'),
f AS (
  SELECT user_id, i, us, event_id, 2::DOUBLE AS charges, 0::DOUBLE AS missing FROM r WHERE i = 1
  UNION ALL SELECT user_id, i, us, event_id, greatest(0::DOUBLE, has - 1), greatest(0::DOUBLE, 1 - has)
  FROM (SELECT r.user_id, r.i, r.us, r.event_id, least(3::DOUBLE, f.charges + (r.us - f.us) / {8 * HOUR}::DOUBLE) AS has {_NEXT}))
SELECT user_id, event_id, round(charges, 6) AS charges, round(missing * {8 * HOUR} / 1000000, 3) AS deficit_s FROM f"""

_MOVES = ", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in fsm.MACHINE.items())
_ENDS = ", ".join(f"('{a}', {h * HOUR}::BIGINT, '{b}')" for a, (h, b) in fsm.TIMEOUTS.items())
#: A step is a timeout before the next row, or else that row.
MACHINE = f"""WITH RECURSIVE {_R}, m AS MATERIALIZED (SELECT * FROM (VALUES {_MOVES}) v(state, event, following)), t AS MATERIALIZED (SELECT * FROM (VALUES {_ENDS}) v(state, after_us, following)),
f AS (
  SELECT user_id, 0::BIGINT AS i, 'idle' AS state, NULL::BIGINT AS since, NULL::VARCHAR AS from_state, NULL::VARCHAR AS cause FROM r WHERE i = 1
  UNION ALL SELECT user_id, CASE WHEN late THEN i - 1 ELSE i END, CASE WHEN late THEN ends_in ELSE coalesce(following, state) END,
    CASE WHEN late THEN since + after_us WHEN following IS NOT NULL THEN us ELSE since END,
    CASE WHEN late OR following IS NOT NULL THEN state END, CASE WHEN late THEN 'timeout' ELSE event_type END
  FROM (SELECT r.user_id, r.i, r.us, r.event_type, f.state, f.since, m.following, t.after_us, t.following AS ends_in, coalesce(r.us >= f.since + t.after_us, false) AS late
    {_NEXT} LEFT JOIN t ON t.state = f.state LEFT JOIN m ON m.state = f.state AND m.event = r.event_type))
SELECT user_id, since AS us, from_state, state AS to_state, cause FROM f WHERE from_state IS NOT NULL"""

SESSIONS = f"""WITH RECURSIVE {_R}, f AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS session, NULL::BIGINT AS start_us, NULL::BIGINT AS us, 0::BIGINT AS phases, []::BIGINT[] AS members, false AS ended FROM r WHERE i = 1
  UNION ALL SELECT user_id, i, session + fresh::BIGINT, CASE WHEN fresh THEN us ELSE since END, us,
    CASE WHEN fresh THEN 0 ELSE phases END + (event_type = 'click')::BIGINT, list_append(CASE WHEN fresh THEN [] ELSE members END, k), event_type = 'error' AND since IS NOT NULL
  FROM (SELECT r.*, f.session, f.phases, f.members, CASE WHEN NOT f.ended THEN f.start_us END AS since, (f.start_us IS NULL OR f.ended) AND r.event_type = 'signup' AS fresh {_NEXT}))
SELECT user_id, session, start_us, us AS end_us, phases AS n_phases, len(list_distinct(members))::BIGINT AS n_members FROM f WHERE ended
UNION ALL SELECT user_id, session, start_us, us, phases, len(list_distinct(members))::BIGINT FROM ({_END}) WHERE start_us IS NOT NULL AND NOT ended"""

#: Greedy thinning, then from corner to corner with all points to the left.
HULL = f"""WITH RECURSIVE {P}, r AS MATERIALIZED (SELECT label, x, z, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM p),
f AS (
  SELECT label, i, [{{'x': x, 'z': z}}] AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.label, r.i, CASE WHEN len(list_filter(f.kept, lambda q: sqrt((q.x - r.x) ** 2 + (q.z - r.z) ** 2) < 0.1)) = 0 THEN list_append(f.kept, {{'x': r.x, 'z': r.z}}) ELSE f.kept END
  FROM f JOIN r ON r.label = f.label AND r.i = f.i + 1),
thin AS MATERIALIZED (SELECT f.label, f.kept FROM f JOIN (SELECT label, max(i) AS i FROM r GROUP BY label) USING (label, i)),
h AS (
  SELECT label, 0::BIGINT AS place, list_sort(kept)[1] AS first, list_sort(kept)[1] AS corner FROM thin
  UNION ALL SELECT label, place, first, corner FROM (
    SELECT h.label, h.place + 1 AS place, h.first, list_filter(thin.kept, lambda c: c <> h.corner AND len(list_filter(thin.kept, lambda d: d <> h.corner AND (
      (c.x - h.corner.x) * (d.z - h.corner.z) - (c.z - h.corner.z) * (d.x - h.corner.x) < 0
      OR (c.x - h.corner.x) * (d.z - h.corner.z) - (c.z - h.corner.z) * (d.x - h.corner.x) = 0 AND (d.x - h.corner.x) ** 2 + (d.z - h.corner.z) ** 2 > (c.x - h.corner.x) ** 2 + (c.z - h.corner.z) ** 2))) = 0)[1] AS corner
    FROM h JOIN thin USING (label)) WHERE corner IS NOT NULL AND corner <> first)
SELECT label, place, round(corner.x, 6) AS x, round(corner.z, 6) AS z FROM h"""

PICK = """WITH RECURSIVE r AS MATERIALIZED (
  SELECT l_orderkey AS queue, l_partkey AS entry, l_quantity - 5 AS priority, l_discount AS delay, l_tax AS duration, l_extendedprice AS cast_s, l_returnflag <> 'R' AS usable,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_shipdate, l_partkey, l_suppkey) AS i FROM lineitem),
f AS (
  SELECT queue, 0::BIGINT AS i, NULL::BIGINT AS entry, NULL::DOUBLE AS start_s, false AS usable, 'infinity'::DOUBLE AS deadline, false AS done FROM r WHERE i = 1
  UNION ALL SELECT queue, i, CASE WHEN later OR taken THEN entry ELSE best END, CASE WHEN later OR taken THEN delay ELSE start_s END, CASE WHEN later OR taken THEN usable ELSE best_usable END,
    CASE WHEN later THEN delay ELSE deadline END, taken OR priority < 0
  FROM (SELECT r.*, f.entry AS best, f.start_s, f.usable AS best_usable, f.deadline, r.priority >= 0 AND r.cast_s <= 60000 AND r.delay + r.duration <= f.deadline AS fits,
      fits AND r.delay > 0.05::DOUBLE AS later, fits AND NOT later AND r.usable AS taken
    FROM f JOIN r ON r.queue = f.queue AND r.i = f.i + 1 WHERE NOT f.done))
SELECT queue, arg_max(entry, i) AS entry, arg_max(start_s, i) AS start_s FROM (SELECT *, max(i) OVER (PARTITION BY queue) AS top FROM f) WHERE i = top AND entry IS NOT NULL AND usable GROUP BY queue"""

AUDIT = f"""WITH RECURSIVE {E}, o AS (
  SELECT user_id, event_id, us, k % 8 AS seq, (k // 8) % 4 AS action,
    CASE event_type WHEN 'click' THEN 'ask' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'reset' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'start' ELSE 'stop' END END AS kind FROM e),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM o WHERE kind <> 'answer' OR seq <> 0),
f AS (
  SELECT user_id, 0::BIGINT AS i, []::STRUCT(seq BIGINT, action BIGINT, us BIGINT)[] AS queue, NULL::BIGINT AS casting, NULL::BIGINT AS event_id, NULL::VARCHAR AS warning FROM r WHERE i = 1
  UNION ALL SELECT user_id, i,
    CASE WHEN kind = 'reset' THEN [] WHEN kind = 'ask' THEN list_append(queue, {{'seq': seq, 'action': action, 'us': us}}) WHEN NOT settles THEN queue WHEN place = 0 THEN [] ELSE queue[place + 1:] END,
    CASE WHEN kind = 'start' THEN action WHEN kind = 'ask' AND NOT early THEN casting END, event_id,
    CASE
      WHEN settles AND place = 0 THEN concat(kind, ' of none') WHEN settles AND place > 1 THEN concat(kind, ' out of order')
      WHEN kind = 'reject' THEN CASE WHEN queue[1].seq = seq AND queue[1].action = action THEN 'reject' ELSE 'reject of another' END
      WHEN kind = 'answer' AND queue[1].action <> action THEN 'answer to another' WHEN kind = 'answer' AND us - queue[1].us >= {48 * HOUR} THEN 'answer too late'
      WHEN kind = 'ask' AND len(queue) > 0 THEN concat('ask while ', len(queue), ' wait')
      WHEN kind = 'start' THEN nullif(concat_ws(', ', CASE WHEN len(queue) = 0 THEN 'start of none' WHEN queue[1].action <> action THEN 'start of another' END, CASE WHEN casting IS NOT NULL THEN 'start during a cast' END), '') END
  FROM (SELECT r.*, f.casting, coalesce(r.kind = 'ask' AND f.queue[1].action = f.casting, false) AS early, CASE WHEN early THEN f.queue[2:] ELSE f.queue END AS queue,
      r.kind IN ('answer', 'reject') OR r.kind = 'stop' AND f.casting IS NOT NULL AS settles,
      coalesce(CASE WHEN r.kind = 'stop' THEN list_position(list_transform(f.queue, lambda q: q.action), f.casting)
        WHEN r.seq <> 0 THEN list_position(list_transform(f.queue, lambda q: q.seq), r.seq) ELSE list_position(list_transform(f.queue, lambda q: q.action), r.action) END, 0) AS place {_NEXT}))
SELECT user_id, event_id, warning FROM f WHERE warning IS NOT NULL"""
