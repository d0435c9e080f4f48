"""Review tables derived from the driver's test tables, in DataFrame and in SQL form.

Orders stand in for leads, their lines for outcomes and tasks, events for the
activity log.  Both forms spell out the same rules, so that a query and its
oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import settled

NOW = "1998-07-01 12:00:00"
TTL_HOURS = 24 * 60

#: A lead for each order; plain SQL that Spark and other engines read alike.
LEADS = """
SELECT o_orderkey AS id,
  CASE WHEN o_custkey % 3 = 0 THEN 'iboss' ELSE 'market' END AS source_id,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS source_status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS last_checked_at,
  o_orderdate + INTERVAL 30 DAY AS deadline_at,
  CASE WHEN o_custkey % 2 = 0 THEN 'day' ELSE 'unknown' END AS deadline_precision,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'recommended' WHEN o_orderpriority = '5-LOW' THEN 'excluded' ELSE 'needs_review' END AS recommendation,
  CASE o_custkey % 7 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'interested' END AS user_mark,
  CASE o_orderkey % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'reviewing' WHEN 2 THEN 'contacted' WHEN 3 THEN 'won' WHEN 4 THEN 'ignored' ELSE 'new' END AS sales_stage,
  CASE o_custkey % 4 WHEN 0 THEN 'buyer_project' WHEN 1 THEN 'buyer_ongoing' WHEN 2 THEN 'employee_hiring' ELSE 'unknown' END AS demand_intent,
  CASE WHEN o_orderkey % 2 = 0 THEN 'project' ELSE 'full_time' END AS engagement_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'blocked' ELSE 'accessible' END AS access_status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'day' ELSE 'exact' END AS published_precision,
  o_orderdate AS record_published_at, o_orderdate AS published_at,
  o_orderdate + INTERVAL 5 HOUR AS first_seen_at,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) % 101 END AS priority_total,
  CASE o_orderkey % 4 WHEN 0 THEN 'fully_remote' WHEN 1 THEN 'onsite' ELSE 'unknown' END AS work_mode,
  CASE WHEN o_orderkey % 8 = 0 THEN 'explicit' ELSE 'inferred' END AS work_mode_basis,
  CASE WHEN o_orderkey % 10 = 0 THEN 'onsite_required' ELSE 'unknown' END AS collaboration_mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 'month' ELSE 'project' END AS pay_unit,
  lower(c_name || ' ' || n_name || ' ' || c_mktsegment) AS search_text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

#: As-of-now columns, for oracles.
EFFECTIVE = f"""
leads0 AS ({LEADS}), leads1 AS (
  SELECT *, coalesce(source_id = 'iboss' AND source_status IN ('open', 'unknown') AND deadline_precision = 'day'
    AND deadline_at < date_trunc('day', TIMESTAMP '{NOW}' + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, false) AS expired
  FROM leads0
), leads2 AS (
  SELECT *, source_status = 'open' AND NOT expired AND (last_checked_at IS NULL OR last_checked_at < TIMESTAMP '{NOW}' - INTERVAL {TTL_HOURS} HOUR) AS recheck_due,
    CASE WHEN expired THEN 'closed' ELSE source_status END AS effective_status
  FROM leads1
), leads AS (
  SELECT *, CASE WHEN expired THEN 'excluded' WHEN recommendation = 'recommended' AND recheck_due THEN 'needs_review' ELSE recommendation END AS effective_recommendation
  FROM leads2
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str], DataFrame] = {}


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads, joined from their tables and stored once a session, as a review store holds them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
        sql = LEADS
        for n in frames:
            sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
        _stored[key] = settled(spark.sql(sql, **frames))
    return _stored[key]
