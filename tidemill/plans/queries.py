"""Every operator family as a query over the test tables, with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import aggregates, leads, merge, relations, windows
from .proxy import EFFECTIVE, NOW, TTL_HOURS, table
from .proxy import leads as lead_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- review queue -----------------------------------------------------------

BEFORE = "sales_stage IN ('new', 'reviewing')"
OPEN_EYES = "(user_mark IS NULL OR user_mark <> 'dismissed') AND sales_stage <> 'ignored'"
FRESH = f"""effective_recommendation IN ('recommended', 'needs_review') AND {OPEN_EYES} AND {BEFORE} AND demand_intent IN ('buyer_project', 'buyer_ongoing')
  AND engagement_type = 'project' AND effective_status = 'open' AND access_status = 'accessible' AND last_checked_at >= TIMESTAMP '{NOW}' - INTERVAL {TTL_HOURS} HOUR
  AND published_precision = 'exact' AND record_published_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}'"""


@query(f"""WITH {EFFECTIVE} SELECT
  count(*) FILTER (WHERE {FRESH}) AS fresh,
  count(*) FILTER (WHERE effective_recommendation = 'recommended' AND {OPEN_EYES} AND {BEFORE}) AS recommended,
  count(*) FILTER (WHERE effective_recommendation = 'needs_review' AND {OPEN_EYES} AND {BEFORE}) AS needs_review,
  count(*) FILTER (WHERE user_mark = 'interested' AND {BEFORE}) AS interested,
  count(*) FILTER (WHERE sales_stage IN ('contacted', 'negotiating', 'won', 'on_hold')) AS active,
  count(*) FILTER (WHERE coalesce(user_mark = 'dismissed', false) OR sales_stage = 'ignored') AS dismissed,
  count(*) FILTER (WHERE effective_recommendation = 'excluded' AND {OPEN_EYES} AND {BEFORE}) AS auto_excluded,
  count(*) AS "all" FROM leads""")
def queue_counts(spark, sf_dir):
    """Eight overlapping queues in one scan."""
    return leads.queue_counts(lead_rows(spark, sf_dir), NOW, TTL_HOURS)


@query(f"WITH {EFFECTIVE} SELECT id, expired, effective_status, recheck_due, effective_recommendation FROM leads")
def effective_columns(spark, sf_dir):
    return leads.with_effective(lead_rows(spark, sf_dir), NOW, TTL_HOURS).select("id", "expired", "effective_status", "recheck_due", "effective_recommendation")


@query(f"""WITH {EFFECTIVE} SELECT id, coalesce(priority_total, -1) AS sort_key FROM leads
  WHERE effective_recommendation = 'recommended' AND {OPEN_EYES} AND {BEFORE} AND (coalesce(priority_total, -1) < 80 OR (coalesce(priority_total, -1) = 80 AND id < 900))
  ORDER BY sort_key DESC, id DESC LIMIT 51""")
def queue_page(spark, sf_dir):
    """A keyset page of the recommended queue."""
    return leads.page(lead_rows(spark, sf_dir), "recommended", NOW, TTL_HOURS, after=(80, 900)).select("id", "sort_key")


@query(f"""WITH {EFFECTIVE} SELECT id, published_at AS sort_key FROM leads ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 21""")
def published_page(spark, sf_dir):
    return leads.page(lead_rows(spark, sf_dir), "all", NOW, TTL_HOURS, sort="published", limit=20).select("id", "sort_key")


@query(f"""WITH {EFFECTIVE} SELECT id FROM leads WHERE contains(search_text, 'customer') AND contains(search_text, 'building') AND work_mode = 'fully_remote'
  AND effective_status NOT IN ('closed', 'deleted') AND demand_intent IN ('buyer_project', 'buyer_ongoing') AND sales_stage IN ('new', 'contacted')""")
def filtered_leads(spark, sf_dir):
    f = leads.LeadFilter(keyword="Customer BUILDING", remote="confirmed_or_inferred", recruit="not_closed", intent="buyer", sales_stage=("new", "contacted"))
    rows = leads.with_effective(lead_rows(spark, sf_dir), NOW, TTL_HOURS)
    return rows.where(leads.filters(f, NOW, TTL_HOURS)).select("id")


@query(f"""WITH {EFFECTIVE} SELECT id, CASE WHEN effective_status = 'closed' THEN 'closed' WHEN effective_status = 'deleted' THEN 'deleted'
  WHEN access_status <> 'accessible' THEN 'access_issue' WHEN effective_status = 'open' AND NOT recheck_due THEN 'open' WHEN effective_status = 'open' THEN 'recheck' ELSE 'unknown' END AS recruit FROM leads""")
def recruit_class(spark, sf_dir):
    return leads.with_effective(lead_rows(spark, sf_dir), NOW, TTL_HOURS).select("id", leads.recruit_class().alias("recruit"))


@query(f"""WITH {EFFECTIVE} SELECT id, CASE WHEN published_precision = 'exact' AND id % 7 <> 0 AND record_published_at <= TIMESTAMP '{NOW}' THEN epoch_us(first_seen_at) / 1e6 - epoch_us(record_published_at) / 1e6 END AS discovery_seconds,
  CASE WHEN expired THEN 'deadline passed' WHEN recheck_due THEN 'recheck due' ELSE '' END AS reasons FROM leads""")
def lead_summary(spark, sf_dir):
    rows = lead_rows(spark, sf_dir).withColumn("reasons", F.array().cast("array<string>"))
    rows = rows.withColumn("first_seen_at", F.when(F.col("id") % 7 == 0, F.col("first_seen_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("first_seen_at")))  # seen before it was published
    return leads.summary(rows, NOW, TTL_HOURS).select("id", "discovery_seconds", F.array_join("reasons", ",").alias("reasons"))


# --- aggregates -------------------------------------------------------------

OUTCOMES = "SELECT l_returnflag AS currency, l_linestatus AS kind, CASE WHEN l_returnflag = 'R' AND l_orderkey % 97 = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount FROM lineitem"


@query(f"WITH o AS ({OUTCOMES}) SELECT currency, " + ", ".join(
    f"""CASE WHEN count(*) FILTER (WHERE kind = '{k}' AND amount IS NULL) = 0 THEN CAST(coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0) AS VARCHAR) END AS "{k}_amount",
    CAST(coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0) AS VARCHAR) AS "{k}_known_amount", count(*) FILTER (WHERE kind = '{k}') AS "{k}_records",
    count(*) FILTER (WHERE kind = '{k}' AND amount IS NULL) AS "{k}_missing_amounts" """ for k in "OF") + " FROM o GROUP BY currency")
def money_totals(spark, sf_dir):
    """Exact sums as decimal text; a missing amount makes the total unknown."""
    amount = F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 97 == 0), None).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("currency"), F.col("l_linestatus").alias("kind"), amount.alias("amount"))
    out = aggregates.money_by(rows, "currency", "OF")
    return out.withColumns({f"{k}_{n}": F.col(f"{k}_{n}").cast("string") for k in "OF" for n in ("amount", "known_amount")})


@query("""WITH r AS (SELECT o_orderpriority AS source_id, CASE WHEN l_shipdate >= o_orderdate AND l_linenumber <> 7 THEN epoch_us(l_shipdate) / 1e6 - epoch_us(o_orderdate) / 1e6 END AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN TIMESTAMP '1997-12-31' - INTERVAL 2500 DAY AND TIMESTAMP '1997-12-31')
SELECT source_id, CAST(count(*) AS BIGINT) AS records, count(delay) AS samples, count(*) - count(delay) AS unavailable, median(delay) AS median_seconds, quantile_disc(delay, 0.95) AS p95_seconds,
  count(*) FILTER (WHERE delay <= 900) AS within_15_minutes, count(*) FILTER (WHERE delay <= 3600) AS within_1_hour FROM r GROUP BY source_id""")
def discovery_delays(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    precision = F.when(F.col("l_linenumber") == 7, "day").otherwise("exact")
    return aggregates.discovery_delays(rows.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("published_at"), F.col("l_shipdate").alias("first_seen_at"), precision.alias("published_precision")), clock.at("1997-12-31 00:00:00"), 2500)


@query("""SELECT l_suppkey AS unit, l_linenumber AS line, l_orderkey % 20 AS part, CASE WHEN bool_or(l_returnflag = 'R' AND l_discount > 0.09) THEN 'blocked' WHEN bool_or(l_returnflag = 'A' AND l_tax > 0.07) THEN 'failed' WHEN bool_and(l_quantity > 1) THEN 'done' ELSE 'pending' END AS unit_state, count(*) AS tasks
FROM lineitem GROUP BY l_suppkey, l_linenumber, l_orderkey % 20""")
def unit_states(spark, sf_dir):
    state = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), "blocked").when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07), "failed").when(F.col("l_quantity") > 1, "done").otherwise("pending")
    unit = [F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 20).alias("part")]
    return aggregates.unit_states(table(spark, sf_dir, "lineitem").select(*unit, state.alias("state")), ["unit", "line", "part"])


ATTEMPTS = "SELECT CAST(ts AS DATE) AS day, CASE user_id % 3 WHEN 0 THEN 'settled' WHEN 1 THEN 'reserved' ELSE 'uncertain' END AS state, CAST(round(value * 100) AS BIGINT) AS cost FROM events"


@query(f"""WITH a AS (SELECT *, strftime(day, '%Y-%m') AS month FROM ({ATTEMPTS}))
SELECT day, month, CAST(coalesce(sum(cost) FILTER (WHERE state = 'settled'), 0) AS BIGINT) AS estimated, CAST(coalesce(sum(cost) FILTER (WHERE state = 'reserved'), 0) AS BIGINT) AS reserved,
  CAST(coalesce(sum(cost) FILTER (WHERE state = 'uncertain'), 0) AS BIGINT) AS uncertain, count(*) AS attempts FROM a GROUP BY GROUPING SETS ((day), (month))""")
def ledger_periods(spark, sf_dir):
    state = F.when(F.col("user_id") % 3 == 0, "settled").when(F.col("user_id") % 3 == 1, "reserved").otherwise("uncertain")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), state.alias("state"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return aggregates.ledger_periods(rows)


@query("""SELECT CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS k, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END), 0) AS BIGINT) AS views, CAST(0 AS BIGINT) AS missing FROM events""")
def counter_sums(spark, sf_dir):
    """Counters by key; most rows lack some, and no row has one of them."""
    counts = F.from_json("props", "map<string,bigint>")
    views = F.when(F.col("event_type") == "view", F.create_map(F.lit("views"), F.try_element_at(counts, F.lit("k")))).otherwise(F.create_map().cast("map<string,bigint>"))
    rows = table(spark, sf_dir, "events").select(F.map_concat(counts, views).alias("counts"))
    return aggregates.counter_sums(rows, ["k", "views", "missing"]).select(*[F.col(c).cast("long").alias(c) for c in ("k", "views", "missing")])


@query("""SELECT event_type, CASE WHEN value < 10 THEN '<10' WHEN value < 100 THEN '<100' WHEN value < 1000 THEN '<1000' ELSE '>=1000' END AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def log_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", aggregates.latency_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT user_id AS lead_id, event_type AS kind, max_by(CASE WHEN value > 15 THEN 'clear' ELSE 'v' || CAST(event_id % 5 AS VARCHAR) END, event_id) AS value FROM events GROUP BY ALL) SELECT * FROM l WHERE value <> 'clear'""")
def latest_feedback(spark, sf_dir):
    value = F.when(F.col("value") > 15, "clear").otherwise(F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lead_id"), F.col("event_type").alias("kind"), value.alias("value"), F.lit(0).alias("created_at"), F.col("event_id").alias("id"))
    return aggregates.latest_feedback(rows)


@query("""SELECT o_custkey AS custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_custkey""")
def group_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").cast("string").alias("k"))
    return rows.groupBy("custkey").agg(aggregates.ordered_digest("k").alias("digest"))


# --- joins ------------------------------------------------------------------


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR c_acctbal > 9000 AS picked FROM customer")
def mark_join(spark, sf_dir):
    """EXISTS under OR as a marked left join."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    marked = relations.mark(table(spark, sf_dir, "customer"), pending, ["c_custkey"], "pending")
    return marked.select("c_custkey", (F.col("pending") | (F.col("c_acctbal") > 9000)).alias("picked"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND (l_partkey = p_partkey OR l_orderkey = p_size))")
def without_any(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").cast("int").alias("p_size"))
    return relations.without_any(table(spark, sf_dir, "part").select("p_partkey", "p_size"), seen, "p_partkey", "p_size").select("p_partkey")


@query("""SELECT b.event_id, b.ts AS since, (SELECT min(e.ts) FROM events e WHERE e.user_id = b.user_id AND e.ts >= b.ts AND e.event_type = 'click' AND e.ts <= TIMESTAMP '2024-01-20') AS first_at
FROM events b WHERE b.event_type IN ('view', 'click')""")
def first_after(spark, sf_dir):
    """Forward as-of join with many bounds a key, some of them at an event's own time."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type IN ('view', 'click')").select("user_id", "event_id", F.col("ts").alias("since"))
    clicks = events.where("event_type = 'click'").select("user_id", "ts")
    return relations.first_after(left, clicks, "user_id", "since", "ts", clock.at("2024-01-20 00:00:00")).select("event_id", "since", "first_at")


@query("""WITH e AS (SELECT l_orderkey % 50 AS a, l_suppkey % 50 AS b, l_linenumber AS revision, l_returnflag = 'R' AS dismissed, l_returnflag = 'A' AS confirmed, l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS id, l_quantity FROM lineitem),
p AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high FROM e WHERE a <> b),
d AS (SELECT DISTINCT low, high, first_value(CASE WHEN dismissed THEN 'dismissed' WHEN confirmed THEN 'confirmed' ELSE 'candidate' END) OVER (PARTITION BY low, high ORDER BY revision DESC, dismissed DESC, confirmed DESC, created_at DESC, id DESC) AS decision,
  first_value(id) OVER (PARTITION BY low, high ORDER BY created_at, id) AS primary_id FROM p)
SELECT low, high, count(*) AS edges, any_value(primary_id) AS primary_id, any_value(decision) AS decision FROM p JOIN d USING (low, high) GROUP BY low, high""")
def edge_decision(spark, sf_dir):
    flag = F.col("l_returnflag")
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.col("l_linenumber").alias("revision"), (flag == "R").alias("dismissed"),
        (flag == "A").alias("confirmed"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return relations.edge_decision(relations.pair_key(edges, "a", "b"))


@query("""SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderstatus = 'F' AND r.o_orderdate > TIMESTAMP '1997-06-01')""")
def uncooled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    queued = orders.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    runs = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("retry_after"))
    return relations.uncooled(queued, runs, clock.at("1997-06-01 00:00:00")).select("o_orderkey")


@query("""SELECT n_name AS region, g.query_group, k.keyword FROM nation, (VALUES ('web', 'site'), ('web', 'shop'), ('app', 'mobile')) k(query_group, keyword), (VALUES ('web'), ('app')) g(query_group) WHERE g.query_group = k.query_group""")
def expand_plan(spark, sf_dir):
    groups = spark.createDataFrame([("web", True, ["site", "shop", " "]), ("app", True, ["mobile"]), ("off", False, ["x"])], "query_group string, enabled boolean, keywords array<string>")
    return relations.expand_plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("region")), groups)


# --- windows ----------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    return windows.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_custkey", "o_orderkey", "o_totalprice"])


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 5")
def top_per_key(spark, sf_dir):
    return windows.top_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "rank")


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size < 30 THEN 'core' ELSE 'explore' END AS kind, p_size FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p_size, p_partkey) - 1 AS i FROM r) SELECT p_partkey, CAST(CASE WHEN kind = 'core' THEN i // 3 * 4 + i % 3 ELSE i * 4 + 3 END AS BIGINT) AS slot FROM i""")
def interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") < 30, "core").otherwise("explore"))
    return windows.interleave(rows, "kind", [F.col("p_size"), F.col("p_partkey")], "core").select("p_partkey", "slot")


@query("""WITH r AS (SELECT event_id, user_id, ts AS started_at, ts + INTERVAL 40 MINUTE + (CAST(floor(value) AS INT) || ' minutes')::INTERVAL AS finished_at FROM events)
SELECT event_id, greatest(0.0, (epoch_us(started_at) - epoch_us(lag(finished_at) OVER w)) / 1e6) + CASE WHEN lag(finished_at) OVER w IS NULL THEN NULL ELSE 0 END AS gap_seconds FROM r WINDOW w AS (PARTITION BY user_id ORDER BY started_at, event_id)""")
def run_gaps(spark, sf_dir):
    """From the end of a source's previous run to the start; overlapping runs have no gap."""
    ended = F.col("ts") + F.make_dt_interval(mins=F.lit(40) + F.floor("value").cast("int"))
    runs = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("started_at"), ended.alias("finished_at"))
    return windows.gap_since(runs, ["user_id"], "started_at", "finished_at", ["started_at", "event_id"]).select("event_id", "gap_seconds")


@query("SELECT event_id, value, before AS previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value > before")
def increases(spark, sf_dir):
    return windows.increases(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "previous")


@query("SELECT event_id, event_type, before AS previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type <> before")
def state_changes(spark, sf_dir):
    return windows.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous")


@query("""WITH v AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN n = 1 THEN '' ELSE concat_ws(',', CASE WHEN o_orderstatus IS DISTINCT FROM s THEN 'o_orderstatus' END, CASE WHEN o_orderpriority IS DISTINCT FROM p THEN 'o_orderpriority' END) END AS changed FROM v""")
def version_diff(spark, sf_dir):
    out = windows.diff_fields(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", F.array_join("changed", ",").alias("changed"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600).select("event_id", "session")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS last_known FROM events""")
def last_known(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return windows.last_known(rows, ["user_id"], "at", "v").select("event_id", "last_known")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2")
def daily_allowance(spark, sf_dir):
    """At most two requests a host and UTC day."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return windows.top_per(rows, ["user_id", "day"], [F.col("ts"), F.col("event_id")], 2).select("event_id")


# --- sets, upserts, folds ---------------------------------------------------

HALVES = "WITH o AS (SELECT c_custkey AS k, c_acctbal AS v, c_name AS first_name FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, c_mktsegment AS first_name FROM customer WHERE c_custkey % 3 <> 1)"


def _halves(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(key % 3 != 0).select(key.alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("first_name"))
    return old, c.where(key % 3 != 1).select(key.alias("k"), (F.col("c_acctbal") + 1).alias("v"), F.col("c_mktsegment").alias("first_name"))


@query(f"{HALVES} SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, coalesce(o.first_name, n.first_name) AS first_name FROM o FULL JOIN n ON o.k = n.k")
def upsert(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.upsert(old, new.withColumn("batch_order", F.lit(1)), ["k"], ["first_name"])


@query(f"{HALVES} SELECT n.k, CASE WHEN o.k IS NULL THEN 'created' WHEN o.v = n.v THEN 'unchanged' ELSE 'updated' END AS change FROM n LEFT JOIN o ON o.k = n.k")
def change_types(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.change_types(old, new, "k", "v")


@query(f"{HALVES} SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def insert_absent(spark, sf_dir):
    return merge.insert_absent(*_halves(spark, sf_dir), "k")


@query(f"{HALVES} SELECT coalesce(o.k, n.k) AS k, greatest(o.v, n.v) AS v FROM o FULL JOIN n ON o.k = n.k")
def restore_merge(spark, sf_dir):
    return merge.keyed_max(*_halves(spark, sf_dir), "k", ["v"])


@query(f"""{HALVES} SELECT o.k, f.field, CASE f.field WHEN 'v' THEN CAST(CAST(o.v AS DECIMAL(18, 2)) AS VARCHAR) ELSE o.first_name END AS old, CASE f.field WHEN 'v' THEN CAST(CAST(n.v AS DECIMAL(18, 2)) AS VARCHAR) ELSE n.first_name END AS new
FROM o JOIN n ON o.k = n.k, (VALUES ('v'), ('first_name')) f(field)""")
def patch_activity(spark, sf_dir):
    old, new = (df.withColumn("v", F.col("v").cast("decimal(18,2)")) for df in _halves(spark, sf_dir))
    return merge.patch_activity(old, new, "k", ["v", "first_name"])


@query("SELECT l_suppkey, l_returnflag, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at, count(*) AS times_seen FROM lineitem GROUP BY ALL")
def discovery_paths(spark, sf_dir):
    return merge.paths(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_shipdate")


@query("SELECT event_id AS seq FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500 OR event_type = 'purchase'")
def trim_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("dedupe_key"))
    return merge.trim_events(rows, 500).select("seq")


@query("SELECT count(*) AS open_units, count(*) = 0 AS complete FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))")
def cycle_state(spark, sf_dir):
    due = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"))
    return merge.cycle_state(due, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("unit")), ["unit"])


# --- text -------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(source, '') || chr(0)) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text"), F.col("source")).alias("digest"))


@query("""WITH t AS (SELECT doc_id, lang, source, string_split(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), '') AS s FROM documents),
g AS (SELECT doc_id, lang, source, CASE WHEN len(s) < 3 THEN [] ELSE list_distinct([s[i] || s[i + 1] || s[i + 2] FOR i IN range(1, len(s) - 1)]) END AS b FROM t),
p AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY lang, source ORDER BY doc_id) AS a FROM g)
SELECT doc_id, CASE WHEN a IS NULL THEN NULL WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 9) END AS similarity FROM p""")
def trigram_similarity(spark, sf_dir):
    """Whole texts of all documents, each beside the one before it of its language and source."""
    before = F.lag("grams").over(windows.Window.partitionBy("lang", "source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.trigrams(F.col("text")).alias("grams")).withColumn("before", before)
    return rows.select("doc_id", F.when(F.col("before").isNotNull(), F.round(text.jaccard(F.col("before"), F.col("grams")), 9)).alias("similarity"))


@query(r"""WITH u AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'HTTPS://WWW.' || upper(regexp_extract(url, '^https?://([^/]+)', 1)) || '/A?q=B#c' WHEN 1 THEN url || '#part' ELSE 'ftp://x.example/' END AS given FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.' || lower(regexp_extract(url, '^https?://([^/]+)', 1)) || '/A?q=B' WHEN 1 THEN regexp_replace(url, '#.*$', '') ELSE given END AS canonical, CASE WHEN page_id % 3 < 2 THEN given END AS safe FROM u""")
def page_urls(spark, sf_dir):
    """Addresses in upper case, with fragments, and of another scheme."""
    host = F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1))
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("HTTPS://WWW."), host, F.lit("/A?q=B#c"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("#part"))).otherwise("ftp://x.example/")
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(given).alias("canonical"), text.safe_url(given).alias("safe"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[=+@\t\r-]') THEN '''' || text ELSE text END AS cell FROM conversations")
def export_cells(spark, sf_dir):
    """Cells of an export, guarded against formulas."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.csv_safe(F.col("text")).alias("cell"))


@query()
def masked_documents(spark, sf_dir):
    """Personal data and secrets masked; the patterns look behind, which the oracle's dialect lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_personal(F.col("text")).alias("masked"))


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%H:%M') >= '22:00' OR strftime(ts + INTERVAL 9 HOUR, '%H:%M') < '08:00' AS quiet, CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) AS bucket FROM events""")
def quiet_hours(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", clock.in_quiet_hours(ts, "22:00", "08:00").alias("quiet"), clock.bucket(ts, 15).alias("bucket"))
