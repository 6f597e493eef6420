"""Event flow control over the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans.fixtures import table
from cadenza.plans.registry import query
from cadenza.streaming import flow

EVENT = "event_id, ts, user_id, event_type, value, props"
HOUR = 3600


def events(spark, sf):
    return table(spark, sf, "events")


@query(
    "ev_parse",
    "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, CAST(props->>'$.k' AS INT) AS k, "
    "date_trunc('millisecond', ts) AS ts, '1' AS v FROM events",
)
def _(spark, sf):
    text = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("name"),
            F.col("props").alias("data"),
            F.floor(flow.micros(F.col("ts")) / 1000).alias("ts"),
            F.lit("1").alias("v"),
        )
    )
    parsed = flow.parse_envelope(events(spark, sf).select(text.alias("body")), "body", "k INT")
    return parsed.select("id", "name", F.col("data.k").alias("k"), "ts", "v")


@query(
    "ev_trigger",
    f"SELECT {EVENT} FROM events WHERE event_type = 'purchase' AND value > 50 AND CAST(props->>'$.k' AS INT) < 40",
)
def _(spark, sf):
    condition = "value > 50 AND cast(get_json_object(props, '$.k') AS INT) < 40"
    return flow.trigger(events(spark, sf), "purchase", condition)


@query(
    "ev_dedup",
    f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn "
    "FROM events) x WHERE rn = 1",
)
def _(spark, sf):
    return flow.dedup(events(spark, sf), ["user_id", "event_type"])


@query(
    "ev_rate_limit",
    f"SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 "
    "ORDER BY ts, event_id) AS rn FROM events) x WHERE rn <= 2",
)
def _(spark, sf):
    return flow.rate_limit(events(spark, sf), "event_type", 2, HOUR)


@query(
    "ev_debounce",
    f"SELECT {EVENT}, ts + INTERVAL 2 HOUR AS fire_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id) AS nxt FROM events) x WHERE nxt IS NULL OR nxt - ts > INTERVAL 2 HOUR",
)
def _(spark, sf):
    return flow.debounce(events(spark, sf), "user_id", 2 * HOUR)


def _greedy(key: str, ends: str) -> str:
    """CTEs that follow each key's runs: `ends` tells where the next run starts.

    `numbered` has n per key; `follow` the number of the row that would start
    the run after one started at n; `starts` the true starts.
    """
    return f"""WITH RECURSIVE numbered AS (
      SELECT *, row_number() OVER w AS n, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS us_before,
        count(*) OVER (PARTITION BY {key}) AS total
      FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)
    ), follow AS (
      SELECT a.{key} AS k, a.n, min(b.n) AS nxt FROM numbered a LEFT JOIN numbered b
        ON a.{key} = b.{key} AND b.n > a.n AND ({ends}) GROUP BY a.{key}, a.n
    ), starts AS (
      SELECT k, n FROM follow WHERE n = 1
      UNION ALL
      SELECT f.k, f.nxt FROM starts s JOIN follow f ON f.k = s.k AND f.n = s.n WHERE f.nxt IS NOT NULL
    ), members AS (
      SELECT e.*, max(s.n) OVER (PARTITION BY e.{key} ORDER BY e.n ROWS UNBOUNDED PRECEDING) AS run_n
      FROM numbered e LEFT JOIN starts s ON s.k = e.{key} AND s.n = e.n
    )
    """


@query(
    "ev_debounce_cap",
    _greedy("user_id", "b.us - a.us >= 21600000000 OR b.us - b.us_before > 14400000000")
    + f"""SELECT {EVENT}, least(ts + INTERVAL 4 HOUR, first_ts + INTERVAL 6 HOUR) AS fire_at FROM (
      SELECT m.*, row_number() OVER (PARTITION BY user_id, run_n ORDER BY ts DESC, event_id DESC) AS back,
        min(ts) OVER (PARTITION BY user_id, run_n) AS first_ts FROM members m) x WHERE back = 1""",
)
def _(spark, sf):
    return flow.debounce(events(spark, sf), "user_id", 4 * HOUR, timeout=6 * HOUR)


@query(
    "ev_batch",
    _greedy("event_type", "b.us - a.us >= 60000000 OR b.n - a.n >= 3")
    + """SELECT m.event_id, m.event_type, m.ts, s.event_id AS batch_id FROM members m
    JOIN numbered s ON s.event_type = m.event_type AND s.n = m.run_n""",
)
def _(spark, sf):
    batched = flow.batch_events(events(spark, sf), "event_type", 3, 60)
    return batched.select("event_id", "event_type", "ts", "batch_id")


@query(
    "ev_singleton_skip",
    _greedy("user_id", "b.us - a.us >= 28800000000")
    + f"SELECT {EVENT} FROM members WHERE n = run_n",
)
def _(spark, sf):
    return flow.singleton_skip(events(spark, sf), "user_id", 8 * HOUR)


@query(
    "ev_singleton_cancel",
    f"""SELECT {EVENT}, coalesce(nxt < ts + INTERVAL 8 HOUR, false) AS cancelled,
      CASE WHEN nxt < ts + INTERVAL 8 HOUR THEN nxt ELSE ts + INTERVAL 8 HOUR END AS ended_at
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) x""",
)
def _(spark, sf):
    return flow.singleton_cancel(events(spark, sf), "user_id", 8 * HOUR)


@query(
    "ev_throttle",
    f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
    laned AS (SELECT *, n % 2 AS lane, n // 2 AS m FROM placed)
    SELECT {EVENT}, make_timestamp(CAST(max(epoch_us(ts) - m * 1800000000) OVER (PARTITION BY event_type, lane ORDER BY n
      ROWS UNBOUNDED PRECEDING) + m * 1800000000 AS BIGINT)) AS release_at FROM laned""",
)
def _(spark, sf):
    return flow.throttle(events(spark, sf), "event_type", 2, 1800)


@query(
    "ev_cancel",
    f"""SELECT {EVENT} FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b
      WHERE b.user_id = a.user_id AND b.event_type = 'error' AND (b.ts, b.event_id) > (a.ts, a.event_id)
        AND b.ts <= a.ts + INTERVAL 24 HOUR)""",
)
def _(spark, sf):
    return flow.cancel_on(events(spark, sf), "user_id", "signup", "error", 24 * HOUR)


@query(
    "ev_wait_for",
    f"""SELECT {EVENT}, b.b_id AS match_id, b.b_ts AS match_ts FROM (SELECT * FROM events WHERE event_type = 'view') a
    LEFT JOIN (SELECT event_id AS b_id, ts AS b_ts, user_id AS b_user FROM events WHERE event_type = 'purchase') b
      ON b_user = user_id AND (b_ts, b_id) > (ts, event_id) AND b_ts <= ts + INTERVAL 12 HOUR
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b_ts, b_id) = 1""",
)
def _(spark, sf):
    return flow.wait_for(events(spark, sf), "user_id", "view", "purchase", 12 * HOUR)


@query(
    "ev_dead_letter",
    f"""SELECT {EVENT}, CASE WHEN value > 90 THEN 'value too high' ELSE 'reported as error' END AS error
    FROM events WHERE value > 90 OR event_type = 'error'""",
)
def _(spark, sf):
    checks = {"value too high": F.col("value") > 90, "reported as error": F.col("event_type") == "error"}
    return flow.dead_letters(flow.with_outcome(events(spark, sf), checks))


def _plain_times(frame):
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "ev_tumbling",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
      count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return _plain_times(flow.windowed(events(spark, sf), "event_type", "1 hour"))


@query(
    "ev_sliding",
    """SELECT event_type, s AS start, s + INTERVAL 1 HOUR AS "end", count(*) AS n,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM (
      SELECT event_type, value, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS s
      FROM events, range(4) AS r(k)) x GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return _plain_times(flow.windowed(events(spark, sf), "event_type", "1 hour", "15 minutes"))


@query(
    "ev_session",
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    labelled AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM labelled GROUP BY user_id, s""",
)
def _(spark, sf):
    return _plain_times(flow.sessions(events(spark, sf), "user_id", "3 hours"))
