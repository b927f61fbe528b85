"""Logs of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import reviews
from evidloom.plans.registry import query, table

_DECISION = "CASE WHEN value > 250 THEN 'merged' WHEN value > 120 THEN 'deferred' WHEN event_type = 'view' THEN 'needs_review' WHEN event_type = 'click' THEN 'approved' WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'signup' THEN 'disagreement' WHEN value > 60 THEN 'escalated' ELSE 'resolved' END"
_MOVES = ", ".join(f"('{s}', '{d}', '{to}')" for (s, d), to in sorted(reviews.MAPPING.moves.items()))
_KNOWN = ", ".join(f"'{d}'" for d in reviews.MAPPING.decisions)
_LOG = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, {_DECISION} AS decision, CASE WHEN value >= 5 THEN NULL ELSE 'note too short' END AS guard FROM events),
m(previous, decision, status) AS (VALUES {_MOVES}), t AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 'pending' AS status FROM d UNION ALL SELECT d.user_id, d.rn, CASE WHEN guard IS NULL THEN coalesce(m.status, t.status) ELSE t.status END FROM t JOIN d ON d.user_id = t.user_id AND d.rn = t.rn + 1 LEFT JOIN m ON m.previous = t.status AND m.decision = d.decision),
l AS (SELECT d.event_id, d.user_id, d.rn, t.status AS previous, d.decision, CASE WHEN guard IS NULL THEN coalesce(m.status, t.status) ELSE t.status END AS status, guard IS NULL AND m.status IS NOT NULL AS accepted,
  CASE WHEN guard IS NOT NULL THEN guard WHEN d.decision NOT IN ({_KNOWN}) THEN 'unsupported decision ' || d.decision WHEN m.status IS NULL THEN d.decision || ' is not allowed from ' || t.status END AS reason
  FROM d JOIN t ON d.user_id = t.user_id AND d.rn = t.rn + 1 LEFT JOIN m ON m.previous = t.status AND m.decision = d.decision)"""


def _log(spark, sf):
    e = table(spark, sf, "events")
    return reviews.reviewed(e, "user_id", ["ts", "event_id"], F.expr(_DECISION), reviews.MAPPING, [("note too short", "value >= 5")])


@query("review_log", f"{_LOG} SELECT event_id, previous, decision, status, accepted, reason FROM l")
def review_log(spark, sf):
    """What became of each decision on a user's case, and why those that were refused were."""
    return _log(spark, sf).select("event_id", "previous", "decision", "status", "accepted", "reason")


@query("review_outcomes", f"{_LOG} SELECT user_id, arg_max(status, rn) AS status, count(*) FILTER (WHERE accepted) AS decided, count(*) FILTER (WHERE NOT accepted) AS refused FROM l GROUP BY 1")
def review_outcomes(spark, sf):
    return reviews.final_states(_log(spark, sf), "user_id", ["ts", "event_id"])
