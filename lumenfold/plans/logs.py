"""Request-log queries over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import loadlog as ll
from ..operators.split import sample_bucket
from ..streaming import jobs
from .registry import QUERIES, SQL, L, R, h60, query

DAY = "date_trunc('day', ts)"


def day(c="ts"):
    return F.date_format(c, "yyyy-MM-dd")


@query("latency_percentiles", """
SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std_pop, round(stddev_samp(value), 6) AS std_samp, count(value) < 100 AS low_confidence FROM events GROUP BY event_type""")
def latency_percentiles(t):
    return ll.distribution(t("events"), "value", ["event_type"])


@query("latency_linear_vs_rank", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear, round(quantile_disc(value, 0.95), 6) AS nearest FROM events GROUP BY event_type")
def latency_linear_vs_rank(t):
    return t("events").groupBy("event_type").agg(R(ll.linear_percentile("value", 0.95)).alias("linear"), R(ll.rank_percentile("value", 0.95)).alias("nearest"))


ACCOUNT = """
WITH s AS (SELECT {by}, count(*)::BIGINT AS offered, count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS answered, count(*) FILTER (WHERE event_type IN ('purchase', 'click', 'view'))::BIGINT AS useful,
  greatest(86400.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6) AS s FROM events GROUP BY 1)
SELECT {name}, offered, answered, useful, round(offered / s, 6) AS offered_rate, round(useful / s, 6) AS goodput, useful * 20 < offered * 19 AS saturated FROM s"""
USEFUL = ("purchase", "click", "view")


def accounted(rows, by):
    return ll.accounting(rows, by, F.col("event_type").isin(*USEFUL), F.col("event_type") != "error", "ts", 86400)


@query("client_accounting", ACCOUNT.format(by="user_id", name="user_id"))
def client_accounting(t):
    return accounted(t("events"), ["user_id"])


@query("saturation_ladder", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1),
i AS (SELECT *, 5 * e <= n AS good, sum((NOT (5 * e > n))::INT) OVER (ORDER BY day) AS island FROM d)
SELECT island::BIGINT AS island, min(day) AS first_day, count(*)::BIGINT AS days FROM i WHERE NOT good GROUP BY island HAVING count(*) >= 2""")
def saturation_ladder(t):
    """Streaks of two days or more in which over a fifth of the events are errors."""
    d = t("events").groupBy(day().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    runs = ll.islands(d, [], ["day"], 5 * F.col("e") > F.col("n")).where("good").groupBy("island").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"))
    return runs.where("days >= 2").withColumn("island", L("island"))


@query("recovery_streak", """
WITH i AS (SELECT *, event_type <> 'error' AS good, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) AS n, min(ts) AS start FROM i WHERE good GROUP BY ALL)
SELECT u.user_id, strftime(min(r.start), '%Y-%m-%d %H:%M:%S') AS recovered_at FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id AND r.n >= 10 GROUP BY u.user_id""")
def recovery_streak(t):
    out = ll.first_streak(t("events"), ["user_id"], "ts", ["ts", "event_id"], F.col("event_type") != "error", 10)
    return out.withColumn("recovered_at", F.date_format("recovered_at", "yyyy-MM-dd HH:mm:ss"))


@query("drift_thirds", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, count(*)::BIGINT AS n, quantile_cont(value, 0.5) FILTER (WHERE r <= n // 3) AS a, quantile_cont(value, 0.5) FILTER (WHERE r > n - n // 3) AS b FROM r GROUP BY user_id)
SELECT user_id, n, round(a, 6) AS first_median, round(b, 6) AS last_median, round(b / a, 6) AS drift FROM g""")
def drift_thirds(t):
    return ll.drift_thirds(t("events"), ["user_id"], ["ts", "event_id"], "value")


PHASES = [("baseline", "2024-01-01", "2024-01-08"), ("fault", "2024-01-08", "2024-01-15"), ("recovery", "2024-01-15", "2024-02-15")]


@query("phase_accounting", "WITH p(phase, b, e) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in PHASES) + """)
SELECT phase, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events JOIN p ON ts >= b AND ts < e GROUP BY ALL""")
def phase_accounting(t):
    e = t("events")
    spans = e.sparkSession.createDataFrame(PHASES, "phase string, b string, e string").select("phase", F.expr("cast(b as timestamp_ntz)").alias("begin"), F.expr("cast(e as timestamp_ntz)").alias("end"))
    return ll.phases(e, "ts", spans).groupBy("phase", "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean"))


@query("multiset_reconcile", f"""
WITH a AS (SELECT props AS key, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1), b AS (SELECT props AS key, count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0)::BIGINT AS sent, coalesce(b.n, 0)::BIGINT AS received FROM a FULL JOIN b ON a.key = b.key)
SELECT *, greatest(sent - received, 0)::BIGINT AS lost, greatest(received - sent, 0)::BIGINT AS unknown, least(sent, received)::BIGINT AS matched FROM j""")
def multiset_reconcile(t):
    e = t("events").select("event_id", F.col("props").alias("key"))
    return ll.reconcile(e.where("event_id % 11 <> 0"), e.where("event_id % 13 <> 0"), "key")


@query("sample_deltas", "SELECT event_id, user_id, round(delta, 6) AS delta FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events) WHERE delta >= 0")
def sample_deltas(t):
    return ll.deltas(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", R("delta").alias("delta"))


EDGES = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query("latency_histogram_le", " UNION ALL ".join(f"SELECT event_type, '{e}' AS le, count(*) FILTER (WHERE value <= {e})::BIGINT AS n FROM events GROUP BY event_type" for e in EDGES) + " UNION ALL SELECT event_type, '+Inf', count(value)::BIGINT FROM events GROUP BY event_type")
def latency_histogram_le(t):
    return ll.cumulative_histogram(t("events"), ["event_type"], "value", EDGES)


@query("run_spread", """
WITH w AS (SELECT event_type, (datediff('day', DATE '2024-01-01', ts::DATE) // 7)::BIGINT AS week, avg(value) AS m FROM events GROUP BY ALL)
SELECT event_type, count(m)::BIGINT AS runs, round(min(m), 6) AS min, round(max(m), 6) AS max, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(100 * (max(m) - min(m)) / avg(m), 6) AS spread_pct FROM w GROUP BY event_type""")
def run_spread(t):
    weeks = t("events").groupBy("event_type", F.expr("datediff(ts, date'2024-01-01') div 7").alias("week")).agg(F.avg("value").alias("m"))
    return ll.spread(weeks, ["event_type"], "m")


@query("metric_delta", """
WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS x, b.v AS y FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT user_id, round(x, 6) AS before, round(y, 6) AS after, round(100 * (y - x) / nullif(x, 0), 6) AS change_pct,
  CASE WHEN x IS NULL THEN 'baseline_missing' WHEN y IS NULL THEN 'candidate_missing' WHEN x = 0 THEN 'baseline_zero' WHEN 100 * (y - x) / x > 5 THEN 'regressed' WHEN 100 * (y - x) / x < -5 THEN 'improved' ELSE 'unchanged' END AS status FROM j""")
def metric_delta(t):
    e = t("events")
    a, b = (e.where(w).groupBy("user_id").agg(F.avg("value").alias("v")) for w in ("ts < timestamp_ntz'2024-01-03'", "ts >= timestamp_ntz'2024-01-28'"))
    return ll.compare(a, b, "user_id", "v", 5.0)


STAGES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("unpivot_stages", "SELECT stage, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(quantile_disc(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, {s} AS v FROM lineitem" for s in STAGES) + ") GROUP BY stage")
def unpivot_stages(t):
    long = t("lineitem").select("l_orderkey", *STAGES).unpivot(["l_orderkey"], STAGES, "stage", "v")
    return long.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), R(F.avg("v")).alias("mean"), R(ll.rank_percentile("v", 0.95)).alias("p95"), R(F.max("v")).alias("max"))


@query("audit_sample", f"SELECT event_id, user_id FROM events WHERE {h60("'audit|' || event_id::VARCHAR")} < {int(0.05 * (1 << 60))}")
def audit_sample(t):
    return t("events").where(sample_bucket(F.col("event_id"), "audit", 0.05)).select("event_id", "user_id")


@query("tumbling_counts", "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(t):
    w = t("events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@query("sliding_counts", """
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL '6 hours']) AS s FROM events) GROUP BY s""")
def sliding_counts(t):
    w = t("events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("session_gap", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_gap(t):
    w = t("events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("token_bucket", None)
def token_bucket(t):
    """Batch twin of the stateful token bucket: tests hold it to a plain loop and to the stream."""
    return jobs.token_bucket_batch(t("events"), rate_per_s=1 / 14400, burst=3.0)


@query("late_events", """
WITH m AS (SELECT event_id, ts, user_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events)
SELECT event_id, user_id, (ts < seen - INTERVAL '6 hours') AS expired FROM m""")
def late_events(t):
    """A late event is recorded as expired, not dropped: event time against the largest seen so far from that user, less a delay."""
    seen = F.max("ts").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return t("events").withColumn("seen", seen).select("event_id", "user_id", F.expr("ts < seen - interval '6' hour").alias("expired"))


@query("generation_counter", """
WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS ch FROM events)
SELECT event_id, user_id, (sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS generation FROM c""")
def generation_counter(t):
    """A counter that goes up when a user's state (event type) changes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | F.lag("event_id").over(w).isNull()).cast("int")
    rows = t("events").withColumn("_c", changed)
    return rows.select("event_id", "user_id", L(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("generation"))


@query("admission_control", None)
def admission_control(t):
    """Slots and bounded waiting, simulated by arrival: served, queued or refused. Tests hold it to a plain loop."""
    return jobs.admission_batch(t("events"), slots=2, waiting=3, service_s=7200.0)


STREAMED = "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"


def _stream_available_now(spark, sf_dir):
    """Totals by type from a stream that is run to its end (complete mode: one row a type)."""
    return jobs.run_available(jobs.type_totals(jobs.events_stream(spark, sf_dir)), "totals", "complete")


QUERIES["stream_available_now"] = _stream_available_now
SQL["stream_available_now"] = STREAMED
