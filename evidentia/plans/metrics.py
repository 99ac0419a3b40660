"""Metric queries and keyed state over events (inventory N1-N12, M1-M16).

Rates are the plain, un-extrapolated form: the increase over the window,
divided by its length.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..engine.metrics import Metrics
from ..operators import series
from ..streaming.keyed import Breaker, Grammar, RateBlock, Suppressor, fold
from ..streaming.streams import progress
from .registry import query

WINDOW = 6 * 3600

_COUNTER = f"""c AS (SELECT event_type, user_id, ts, event_id, (event_id % 700)::DOUBLE AS v FROM events),
d AS (SELECT *, CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE CASE WHEN lag(v) OVER w IS NULL THEN 0 ELSE v END END AS delta FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
r AS (SELECT *, sum(delta) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW}000000 PRECEDING AND CURRENT ROW) AS increase FROM d)"""


def _counter(t):
    """A counter for each kind of event that starts again now and then."""
    rows = t.events.select("event_type", "ts", "event_id", (F.col("event_id") % 700).cast("double").alias("v"))
    return series.increase(rows, ["event_type"], "ts", "event_id", "v", WINDOW)


@query(f"WITH {_COUNTER} SELECT event_id, round(increase / {WINDOW}, 9) AS rate FROM r")
def promql_rate(t):
    return _counter(t).select("event_id", F.round(F.col("increase") / WINDOW, 9).alias("rate"))


@query(f"WITH {_COUNTER}, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(increase, (ts, event_id)) AS i FROM r GROUP BY ALL) SELECT hour, round(sum(i) / {WINDOW}, 9) AS rate, round(1 - avg(i) / {WINDOW}, 9) AS rest FROM h GROUP BY hour")
def promql_rate_by(t):
    """The last rate of each series in each hour, summed and averaged over the series."""
    last = _counter(t).groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max_by("increase", F.struct("ts", "event_id")).alias("i"))
    return last.groupBy("hour").agg(F.round(F.sum("i") / WINDOW, 9).alias("rate"), F.round(1 - F.avg("i") / WINDOW, 9).alias("rest"))


@query("SELECT date_trunc('day', ts) AS day, round(count(*) FILTER (regexp_full_match(event_type, 'err.*')) * 100.0 / count(*), 6) AS percent FROM events WHERE event_type <> 'signup' GROUP BY 1")
def promql_error_ratio(t):
    rows = t.events.where(~series.matches("event_type", "signup"))
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.count_if(series.matches("event_type", "err.*")) * 100 / F.count("*"), 6).alias("percent"))


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query(
    """WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le)::DOUBLE AS cum, count(*) FILTER (value > 50 OR value <= 50)::DOUBLE AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL),
    s AS (SELECT *, coalesce(lag(cum) OVER w, 0) AS c0, coalesce(lag(le) OVER w, 0) AS l0 FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM s WHERE cum >= 0.9 * n)
    SELECT event_type, round(CASE WHEN isinf(le) THEN l0 WHEN cum = c0 THEN le ELSE l0 + (le - l0) * (0.9 * n - c0) / (cum - c0) END, 9) AS p90 FROM f WHERE k = 1"""
)
def promql_histogram_quantile(t):
    from ..operators.statistics import cumulative_buckets

    buckets = cumulative_buckets(t.events, ["event_type"], "value", _BOUNDS)
    return series.histogram_quantile(buckets, ["event_type"], 0.9, "p90").withColumn("p90", F.round("p90", 9))


@query(f"WITH {_COUNTER} SELECT event_id FROM r WHERE increase > 80")
def promql_increase(t):
    return _counter(t).where("increase > 80").select("event_id")


@query(
    f"""WITH g AS (SELECT event_id, user_id, ts, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events)
    SELECT event_id, coalesce(sum(changed::INTEGER) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW}000000 PRECEDING AND CURRENT ROW), 0)::BIGINT AS changes FROM g"""
)
def promql_changes(t):
    return series.changes(t.events, ["user_id"], "ts", "event_id", "event_type", WINDOW).select("event_id", "changes")


@query(
    """WITH x AS (SELECT event_type, epoch_us(ts) / 1e6 - 1704067200 AS s, value FROM events) SELECT event_type,
    round(regr_intercept(value, s) + regr_slope(value, s) * (max(s) + 604800), 4) AS predicted FROM x GROUP BY event_type"""
)
def promql_predict_linear(t):
    return series.predict_linear(t.events, ["event_type"], "ts", "value", 7 * 86400, "predicted").withColumn("predicted", F.round("predicted", 4))


@query("SELECT c_nationkey, round(sum(greatest(c_acctbal, 0)) / sum(CASE WHEN c_custkey % 3 > 0 THEN 1000.0 END), 6) AS ratio FROM customer WHERE c_custkey % 3 > 0 GROUP BY c_nationkey")
def gauge_ratio(t):
    """Used over limit, where there is a limit."""
    rows = t.customer.withColumn("cap", (F.col("c_custkey") % 3).cast("double")).where("cap > 0")
    return rows.groupBy("c_nationkey").agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))) / F.sum(F.lit(1000.0)), 6).alias("ratio"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, value > 5 AS bad FROM events), a AS (SELECT *, CASE WHEN bad = lag(bad) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM b)
    SELECT event_id, CASE WHEN NOT bad THEN 'inactive' WHEN ts - since >= INTERVAL 6 HOUR THEN 'firing' ELSE 'pending' END AS state FROM c"""
)
def alert_for_duration(t):
    rows = t.events.withColumn("bad", F.col("value") > 5)
    return series.alert_states(rows, ["user_id"], ["ts", "event_id"], "ts", "bad", 6 * 3600).select("event_id", "state")


@query("SELECT role, round(count(*) FILTER (regexp_matches(text, '(?i)the ')) / 300.0, 6) AS rate FROM conversations GROUP BY role")
def log_rate(t):
    return t.conversations.groupBy("role").agg(F.round(F.count_if(F.col("text").rlike("(?i)the ")) / 300.0, 6).alias("rate"))


# -- state -----------------------------------------------------------------------


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT event_id, user_id, event_type, k, true AS shown, ts AS last FROM e WHERE k = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.event_type, e.k, e.ts - s.last >= INTERVAL 24 HOUR, CASE WHEN e.ts - s.last >= INTERVAL 24 HOUR THEN e.ts ELSE s.last END FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.k = s.k + 1)
    SELECT event_id, shown FROM s"""
)
def alert_dedup(t):
    """Repeats of an alert within a day of the one shown are hidden."""
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return fold(rows, ["user_id", "event_type"], "ts", ["ts", "event_id"], lambda: Suppressor(86400.0), [], "shown", "boolean").select("event_id", "shown")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, event_type IN ('error', 'signup', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT event_id, user_id, k, CASE WHEN failed THEN 1 ELSE 0 END AS failures, 0.0::DOUBLE AS opened, false AS is_open, 'closed' AS state FROM e WHERE k = 1 UNION ALL
    SELECT event_id, user_id, k, CASE WHEN rejected THEN failures WHEN failed THEN f + 1 ELSE 0 END, CASE WHEN NOT rejected AND failed AND f >= 4 THEN sec ELSE opened END, rejected OR failed AND f >= 4,
      CASE WHEN rejected THEN 'rejected' WHEN failed AND f >= 4 THEN 'open' ELSE 'closed' END FROM (
      SELECT e.*, s.failures, s.opened, s.is_open AND e.sec - s.opened < 259200 AS rejected, CASE WHEN s.is_open THEN 4 ELSE s.failures END AS f FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
    SELECT event_id, state FROM s"""
)
def circuit_state(t):
    """A breaker for each user, failing on errors; five failures open it for three days here."""
    rows = t.events.select("event_id", "user_id", "ts", F.col("event_type").isin("error", "signup", "view").alias("failed"))
    return fold(rows, ["user_id"], "ts", ["ts", "event_id"], lambda: Breaker(pause=259200.0), ["failed"], "state", "string").select("event_id", "state")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS limited, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 1000 END AS retry FROM events),
    u AS (SELECT *, CASE WHEN limited THEN epoch_us(ts) / 1e6 + CASE WHEN retry > 0 THEN retry ELSE 60.0 END END AS until FROM e),
    l AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM u)
    SELECT event_id, coalesce(epoch_us(ts) / 1e6 < held, false) AS blocked FROM l"""
)
def rate_blocked(t):
    """Calls held back after a limit was hit, for as long as its answer says, or a minute."""
    retry = F.when(F.col("event_id") % 3 != 0, F.col("value") * 1000)
    rows = t.events.select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("limited"), retry.alias("retry"))
    return fold(rows, ["user_id"], "ts", ["ts", "event_id"], RateBlock, ["limited", "retry"], "blocked", "boolean").select("event_id", "blocked")


@query(
    """WITH r AS (SELECT conv_id, turn, conv_id % 5 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
    SELECT conv_id, turn, CASE WHEN c = 1 AND k > 0 THEN CASE WHEN k = 2 THEN 'retrieval.completed' ELSE 'answer.delta' END || '_after_message.accepted' WHEN c = 2 AND k >= 4 THEN 'seq_gap' WHEN c = 3 AND k >= 3 THEN 'after_end'
    WHEN c = 4 AND k = 0 THEN 'unknown_kind' WHEN c = 4 THEN CASE k WHEN 1 THEN 'retrieval.started' WHEN 2 THEN 'retrieval.completed' ELSE 'answer.delta' END || '_after_start' END AS wrong FROM r"""
)
def answer_grammar(t):
    """Conversations as the events of an answer, four of five with a slip of their own: what is wrong with each event."""
    c = F.col("conv_id") % 5
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1  # a few turns a conversation
    rows = t.conversations.select("conv_id", "turn", c.alias("c"), k.alias("k"))
    kind = F.when((F.col("k") == 0) & (F.col("c") == 4), "ping").when(F.col("k") == 0, "message.accepted").when((F.col("k") == 1) & (F.col("c") != 1), "retrieval.started")
    kind = kind.when((F.col("k") == 2) & (F.col("c") == 3), "error").when(F.col("k") == 2, "retrieval.completed").otherwise("answer.delta")
    seq = F.col("k") - 3 + F.when((F.col("c") == 2) & (F.col("k") == 4), 7).otherwise(0)
    events = rows.select("conv_id", "turn", F.timestamp_seconds("turn").alias("at"), kind.alias("kind"), seq.cast("int").alias("seq"))
    return fold(events, ["conv_id"], "at", ["turn"], Grammar, ["kind", "seq"], "wrong", "string").select("conv_id", "turn", "wrong")


@query(
    """WITH e AS (SELECT count(*) AS n, sum(value) AS s, count(value) AS k, max(event_id) AS m FROM events), b AS (SELECT unnest([1, 5, 10, 50, 100, 500]) AS le)
    SELECT 'event_id_max' AS name, '' AS labels, round(m::DOUBLE, 6) AS value FROM e UNION ALL SELECT 'events_total', '', n FROM e UNION ALL SELECT 'value_count', '', k FROM e UNION ALL SELECT 'value_sum', '', round(s, 6) FROM e
    UNION ALL SELECT 'value_bucket', 'le=' || le, count(*) FILTER (value <= le) FROM events, b GROUP BY le UNION ALL SELECT 'value_bucket', 'le=+Inf', k FROM e"""
)
def metrics_observed(t):
    """A counter, a gauge and a histogram told by a job that does something else."""
    told = Metrics()
    events = told.watch(t.events, counters={"events_total": F.count("*")}, gauges={"event_id_max": F.max("event_id")}, histograms={"value": (F.col("value"), _BOUNDS)})
    events.groupBy("event_type").agg(F.max("ts")).write.format("noop").mode("overwrite").save()
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return told.samples(t.spark).select("name", F.array_join(pairs, ",").alias("labels"), F.round("value", 6).alias("value"))


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'snapshot,job.completed' ELSE 'snapshot' END AS frames FROM events GROUP BY user_id"""
)
def job_progress(t):
    return progress(t.events, "user_id", ["ts", "event_id"], "event_type", "purchase").withColumn("frames", F.array_join("frames", ","))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'RATE_LIMITED' WHEN 'click' THEN 'TIMEOUT' WHEN 'view' THEN 'UNAVAILABLE' ELSE 'INTERNAL' END AS code, event_type IN ('error', 'click', 'view') AS retryable FROM events"""
)
def failure_classes(t):
    """Failures by cause: a code, and whether trying again may help."""
    kind = F.col("event_type")
    code = F.when(kind == "error", "RATE_LIMITED").when(kind == "click", "TIMEOUT").when(kind == "view", "UNAVAILABLE").otherwise("INTERNAL")
    return t.events.select("event_id", code.alias("code"), (code != "INTERNAL").alias("retryable"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(t):
    got = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
