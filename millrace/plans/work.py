"""Work items: commands with compare-and-set, claims by token, retries and timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as P
from ..operators import work as W
from .base import Tables, query

#: Follows each key's accepted commands: the next one is the first after the last that names the state as it is.
_CHAIN = """, w AS (
  SELECT key, -1::BIGINT AS pos, '{initial}' AS state FROM (SELECT DISTINCT key FROM log)
  UNION ALL SELECT w.key, n.pos, n.new FROM w, LATERAL (SELECT l.pos, l.new FROM log l WHERE l.key = w.key AND l.expected = w.state AND l.pos > w.pos ORDER BY l.pos LIMIT 1) n)
SELECT log.key, log.pos, w.pos IS NOT NULL AS accepted, (SELECT max_by(x.state, x.pos) FROM w x WHERE x.key = log.key AND x.pos <= log.pos) AS state
FROM log LEFT JOIN w ON w.key = log.key AND w.pos = log.pos"""


@query(
    """
WITH RECURSIVE c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS key, event_id AS pos,
  CASE WHEN event_id % 2 = 0 THEN event_id // 8 - (event_id // 2) % 3 ELSE (event_id // 2) % 4 END AS version FROM events),
log AS MATERIALIZED (SELECT key, pos, version::VARCHAR AS expected, (version + 1)::VARCHAR AS new FROM c)"""
    + _CHAIN.format(initial="0")
)
def versioned_commands(t: Tables):
    """Which command won each version of a key's counter, and which were rejected; key 0 has half of the log."""
    even = F.col("event_id") % 2 == 0
    half = F.expr("event_id div 2")
    version = F.when(even, F.expr("event_id div 8") - half % 3).otherwise(half % 4)
    log = t.events.select(F.when(even, 0).otherwise(F.col("user_id")).alias("key"), F.col("event_id").alias("pos"), version.cast("string").alias("expected"), (version + 1).cast("string").alias("new"))
    return P.replayed(log, "0", 16)


@query(
    """
WITH RECURSIVE c AS (SELECT user_id % 20 AS key, event_id AS pos, event_type AS kind, (event_id // 20) % 3 AS token FROM events),
log AS MATERIALIZED (SELECT key, pos,
  CASE kind WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'succeeded' ELSE 'running:' || token END AS expected,
  CASE kind WHEN 'view' THEN 'running:' || token WHEN 'purchase' THEN 'succeeded' ELSE 'queued' END AS new FROM c)"""
    + _CHAIN.format(initial="queued")
)
def claim_commands(t: Tables):
    """Views claim a queued item with a token; clicks and errors give it back, purchases end it and signups queue it again."""
    token = F.concat(F.lit("running:"), F.expr("(event_id div 20) % 3").cast("string"))
    kind = F.col("event_type")
    expected = F.when(kind == "view", "queued").when(kind == "signup", "succeeded").otherwise(token)
    new = F.when(kind == "view", token).when(kind == "purchase", "succeeded").otherwise("queued")
    return P.replayed(t.events.select((F.col("user_id") % 20).alias("key"), F.col("event_id").alias("pos"), expected.alias("expected"), new.alias("new")), "queued", 16)


@query()
def work_items(t: Tables):
    """What became of each item: events as commands, with retries and timers."""
    return W.replayed(W.commands(t.events))
