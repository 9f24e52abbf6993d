"""The streaming aggregates, on the events table as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import session_totals, sliding_counts, tumbling_totals
from .registry import query


def _plain(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    return _plain(tumbling_totals(t.events), "start")


@query("SELECT d + INTERVAL (-s) DAY AS start, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d, unnest([0, 1]) AS s FROM events) t GROUP BY ALL")
def sliding_window(t):
    return _plain(sliding_counts(t.events), "start")


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, k")
def session_window(t):
    return _plain(session_totals(t.events), "start", "end")
