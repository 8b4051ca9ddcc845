"""Queries over stored maps, indexed regions and cohorts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkomics.operators import cohorts, maps
from sparkomics.operators.storage import shared_dir
from sparkomics.plans.queries import query, t
from sparkomics.sources import regions

# Indexed regions: the items of an order as intervals, by their return flag

_REGIONS = "r AS (SELECT l_returnflag AS seqid, l_orderkey * 40 + 1 AS start, l_orderkey * 40 + CAST(l_quantity AS BIGINT) AS \"end\", l_partkey FROM lineitem)"


@query(f"""WITH {_REGIONS} SELECT seqid, start, "end", CAST(l_partkey AS VARCHAR) AS part FROM r WHERE (seqid = 'A' AND start <= 200000 AND "end" >= 100000) OR (seqid = 'R' AND start <= 410 AND "end" >= 400)""")
def region_scan(spark, d):
    rows = t(spark, d, "lineitem").selectExpr("l_returnflag AS seqid", "l_orderkey * 40 + 1 AS start", "l_orderkey * 40 + CAST(l_quantity AS BIGINT) AS `end`", "l_partkey")
    path = f"{shared_dir(spark)}/sparkomics-{spark.sparkContext.applicationId}/regions-{uuid.uuid4().hex[:12]}"
    regions.write_indexed(rows, path, "seqid", "start", "end", files=4)
    found = regions.read_indexed(spark, path, [("A", 100_000, 200_000), ("R", 400, 410)])
    return found.select("seqid", "start", "end", F.col("cells")[3].alias("part"))


# A stored map of orders and customers, looked up both ways


def _orders_map(spark, d):
    return maps.store_map(t(spark, d, "orders"), "o_orderkey", "o_custkey", ["o_orderkey"])


@query("WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) SELECT DISTINCT l_orderkey, CAST(o_custkey AS VARCHAR) AS value, row FROM lineitem LEFT JOIN m ON l_orderkey = o_orderkey")
def map_forward(spark, d):
    return maps.look_up(spark, _orders_map(spark, d), t(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey")


@query("WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS value, row FROM customer LEFT JOIN m ON c_custkey = o_custkey")
def map_inverse(spark, d):
    return maps.look_up(spark, _orders_map(spark, d), t(spark, d, "customer").select("c_custkey"), "c_custkey", inverse=True)


@query("WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) SELECT c_custkey, CAST(arg_min(o_orderkey, row) AS VARCHAR) AS value, min(row) AS row FROM customer LEFT JOIN m ON c_custkey = o_custkey GROUP BY 1")
def map_first_entry(spark, d):
    return maps.first_entry(spark, _orders_map(spark, d).swapped(), t(spark, d, "customer").select("c_custkey"), "c_custkey")


# Cohorts

_RULES = {"no balance": "c_acctbal < 0", "segment": "c_mktsegment = 'BUILDING'", "few orders": "coalesce(n, 0) < 5", "low": "total < 500000"}


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1), v AS (SELECT * FROM customer LEFT JOIN o ON o_custkey = c_custkey), w AS (SELECT *, CASE "
    + " ".join(f"WHEN {r} THEN {k + 1}" for k, r in enumerate(_RULES.values()))
    + " END AS took FROM v) "
    + " UNION ALL ".join(f"SELECT c_nationkey, CAST({k + 1} AS INTEGER) AS step, '{n}' AS rule, count(*) FILTER (WHERE {r}) AS matching, count(*) FILTER (WHERE took = {k + 1}) AS removed, count(*) FILTER (WHERE coalesce(took, 9) > {k + 1}) AS \"left\" FROM w GROUP BY 1" for k, (n, r) in enumerate(_RULES.items()))
)
def cohort_attrition(spark, d):
    orders = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    people = t(spark, d, "customer").join(orders, "c_custkey", "left")
    return cohorts.attrition(people, [(n, F.expr(r)) for n, r in _RULES.items()], ["c_nationkey"])


@query("""WITH v AS (SELECT o_orderkey, o_custkey AS k, o_orderdate AS at FROM orders WHERE o_orderstatus = 'O'), m AS (SELECT o_custkey AS k, o_orderdate AS at, min({'p': o_totalprice}).p AS price FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL),
b AS (SELECT o_orderkey, arg_max(price, m.at) AS price, max(m.at) AS at FROM v JOIN m USING (k) WHERE m.at <= v.at AND m.at >= v.at - INTERVAL 90 DAY GROUP BY 1),
a AS (SELECT o_orderkey, arg_min(price, m.at) AS price, min(m.at) AS at FROM v JOIN m USING (k) WHERE m.at >= v.at AND m.at <= v.at + INTERVAL 400 DAY GROUP BY 1)
SELECT o_orderkey, k AS o_custkey, b.price AS last_o_totalprice, epoch(b.at - v.at) / 86400 AS last_days, a.price AS next_o_totalprice, epoch(a.at - v.at) / 86400 AS next_days, c_mktsegment FROM v LEFT JOIN b USING (o_orderkey) LEFT JOIN a USING (o_orderkey) LEFT JOIN customer ON c_custkey = k""")
def visit_covariates(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    visits = orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    measures = orders.filter("o_orderstatus <> 'O'").select("o_custkey", F.col("o_orderdate").alias("at"), "o_totalprice")
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = cohorts.covariates(visits, ["o_custkey"], "o_orderdate", [
        {"table": measures, "values": ["o_totalprice"], "measured_at": "at", "days": 90, "side": "before", "prefix": "last_"},
        {"table": measures, "values": ["o_totalprice"], "measured_at": "at", "days": 400, "side": "after", "prefix": "next_"},
        {"table": people, "values": ["c_mktsegment"], "on": ["o_custkey"]},
    ])
    return out.drop("o_orderdate")
