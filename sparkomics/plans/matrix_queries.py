"""Queries over matrices in long form: correlations of many columns, single linkage, dendrograms, cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkomics.operators import hierarchy, matrices
from sparkomics.operators.storage import stored
from sparkomics.plans.queries import query, t

# Monthly quantities of each supplier, and their correlations

_CELLS = "cells AS (SELECT l_suppkey AS c, date_trunc('month', o_orderdate) AS m, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_OTHER = "other AS (SELECT n_name AS c, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _tests(pairs: str) -> str:
    """SQL from a, b, r, n to p: Student's t by its finite series for whole degrees of freedom, with |r| as its sine."""
    even = "list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - r * r, k) FOR k IN range(0, (n - 2) // 2)])"
    odd = "coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k) - lgamma(k + 0.5)) * pow(1 - r * r, k - 0.5) FOR k IN range(1, (n - 3) // 2 + 1)]), 0)"
    return f"""SELECT a, b, round(r, 8) AS r, n, round(CASE WHEN abs(r) > 1 - 1e-14 THEN 0 WHEN n % 2 = 0 THEN 1 - abs(r) * {even} ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * {odd}) END, 8) AS p
FROM (SELECT a, b, n, CASE WHEN n >= 3 AND NOT isnan(r) THEN r END AS r FROM ({pairs}))"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    sold = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy(F.col("l_suppkey").alias("c"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("l_quantity").alias("v"))


def nation_cells(spark: SparkSession, d: str) -> DataFrame:
    bought = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return bought.groupBy(F.col("n_name").alias("c"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))


def _rounded(table: DataFrame) -> DataFrame:
    return table.select("a", "b", F.round("r", 8).alias("r"), "n", F.round("p", 8).alias("p"))


_PAIRS = "SELECT x.c AS a, y.c AS b, corr(x.v, y.v) AS r, count(*) AS n FROM {0} x JOIN {1} y USING (m) {2} GROUP BY ALL"


@query(f"WITH {_CELLS} {_tests(_PAIRS.format('cells', 'cells', 'WHERE x.c <= y.c'))}")
def column_correlations(spark, d):
    return _rounded(matrices.correlation_table(cells(spark, d), "m", "c", "v"))


@query(f"""WITH {_OTHER}, ranks AS (SELECT c, m, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2 AS v FROM other) {_tests(_PAIRS.format('ranks', 'ranks', 'WHERE x.c <= y.c'))}""")
def column_rank_correlations(spark, d):
    return _rounded(matrices.correlation_table(nation_cells(spark, d), "m", "c", "v", "spearman"))


@query(f"WITH {_CELLS}, {_OTHER}, names AS (SELECT CAST(c AS VARCHAR) AS c, m, v FROM cells) {_tests(_PAIRS.format('names', 'other', ''))}")
def column_cross_correlations(spark, d):
    return _rounded(matrices.correlation_table(cells(spark, d).withColumn("c", F.col("c").cast("string")), "m", "c", "v", other=nation_cells(spark, d)))


# Single linkage of the suppliers by 1 - r

_R = f"{_CELLS}, corrs AS ({_PAIRS.format('cells', 'cells', 'WHERE x.c <= y.c')})"
_LINKAGE = f"""{_R}, items AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS leaf FROM (SELECT DISTINCT c FROM cells)), size AS (SELECT count(*) AS n FROM items),
dist AS (SELECT x.leaf AS a, y.leaf AS b, round(CASE WHEN isnan(r) OR n < 3 THEN -1 ELSE 1 - r END, 8) AS d FROM corrs JOIN items x ON x.c = corrs.a JOIN items y ON y.c = corrs.b WHERE corrs.a <> corrs.b),
state AS (
  SELECT CAST(-1 AS BIGINT) AS step, n, (SELECT list(leaf ORDER BY leaf) FROM items) AS label, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS height FROM size
  UNION ALL SELECT step, n, [CASE WHEN x IN (l, r) THEN step + n ELSE x END FOR x IN label], l, r, height FROM (
    SELECT step, n, label, least(label[e.a + 1], label[e.b + 1]) AS l, greatest(label[e.a + 1], label[e.b + 1]) AS r, e.d AS height FROM (
      SELECT state.step + 1 AS step, any_value(state.n) AS n, any_value(state.label) AS label, min({{'d': dist.d, 'a': dist.a, 'b': dist.b}}) AS e FROM state JOIN dist ON state.label[dist.a + 1] <> state.label[dist.b + 1] GROUP BY state.step)))"""
_NODES = f"""{_LINKAGE}, merges AS (SELECT step + (SELECT n FROM size) AS node, l, r, height FROM state WHERE step >= 0),
up AS (SELECT l AS node, node AS parent FROM merges UNION ALL SELECT r, node FROM merges),
within AS (SELECT leaf, leaf AS node FROM items UNION ALL SELECT leaf, parent FROM within JOIN up USING (node)), sizes AS (SELECT node, count(*) AS leaves FROM within GROUP BY node),
spans AS (SELECT node, CAST(0 AS BIGINT) AS first_leaf, CAST(0 AS BIGINT) AS depth FROM sizes WHERE node NOT IN (SELECT node FROM up)
  UNION ALL SELECT s.node, CAST(spans.first_leaf + CASE WHEN s.node = m.r THEN (SELECT leaves FROM sizes z WHERE z.node = m.l) ELSE 0 END AS BIGINT), spans.depth + 1
  FROM spans JOIN merges m ON m.node = spans.node JOIN sizes s ON s.node IN (m.l, m.r)),
nodes AS (SELECT node, parent, coalesce(height, 0) AS height, leaves, first_leaf, first_leaf + leaves - 1 AS last_leaf, depth FROM sizes JOIN spans USING (node) LEFT JOIN up USING (node) LEFT JOIN merges USING (node))"""


_LINKED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The items and the nodes; stored tables that the queries of an application share."""
    key = spark.sparkContext.applicationId, d
    if key not in _LINKED:
        _LINKED[key] = hierarchy.linkage(stored(matrices.nearest_edges(cells(spark, d), "m", "c", "v"), "nearest-edges"))
    return _LINKED[key]


@query(f"WITH RECURSIVE {_NODES} SELECT node, parent, height, depth, leaves, first_leaf, last_leaf FROM nodes")
def single_linkage(spark, d):
    return _linked(spark, d)[1].select("node", "parent", "height", "depth", "leaves", "first_leaf", "last_leaf")


@query(f'WITH RECURSIVE {_NODES} SELECT m.node, m.l AS "left", m.r AS "right", m.height, leaves FROM merges m JOIN sizes USING (node)')
def merge_table(spark, d):
    return hierarchy.merge_table(_linked(spark, d)[1])


@query(f"WITH RECURSIVE {_NODES}, o AS (SELECT c, first_leaf AS place FROM items JOIN nodes ON leaf = node) SELECT a, b, r.place AS row_place, c.place AS column_place, round(corrs.r, 8) AS r FROM corrs JOIN o r ON r.c = a JOIN o c ON c.c = b")
def seriated_correlations(spark, d):
    placed = hierarchy.reordered(cells(spark, d), hierarchy.leaf_order(*_linked(spark, d)), "c")
    table = matrices.correlation_table(placed.withColumn("c", F.struct("c", F.col("row_place").alias("place"))), "m", "c", "v", tests=False)
    return table.select("a.c", "b.c", "a.place", "b.place", F.round("r", 8).alias("r")).toDF("a", "b", "row_place", "column_place", "r")


@query(f"WITH RECURSIVE {_NODES} SELECT w.node, leaf FROM within w JOIN sizes USING (node) WHERE leaves BETWEEN 2 AND 12")
def leaves_below_nodes(spark, d):
    nodes = _linked(spark, d)[1]
    return hierarchy.leaves_below(nodes, nodes.filter("leaves BETWEEN 2 AND 12"))


_SCORES = f"""{_NODES}, w AS (SELECT x.leaf AS i, y.leaf AS j, exp(abs(CASE WHEN isnan(r) OR n < 3 THEN 0 ELSE r END) - 1) AS w FROM corrs JOIN items x ON x.c = corrs.a JOIN items y ON y.c = corrs.b),
total AS (SELECT sum(w) AS y FROM w), inside AS (SELECT p.node, sum(w) AS x FROM w JOIN within p ON p.leaf = w.i JOIN within q ON q.leaf = w.j AND q.node = p.node GROUP BY p.node),
every AS (SELECT node, sum(s) AS z FROM within JOIN (SELECT i, sum(w) AS s FROM (SELECT i, w FROM w UNION ALL SELECT j, w FROM w WHERE i <> j) GROUP BY i) ON leaf = i GROUP BY node),
base AS (SELECT nodes.*, x, y, z, x / y - pow(z / (2 * y), 2) AS ayroles FROM nodes JOIN inside USING (node) JOIN every USING (node), total),
scores AS (SELECT *, ayroles * CASE WHEN leaves > 1 THEN 1 + 2 * x / (exp(1) * leaves * (leaves - 1)) ELSE 1 END AS haq FROM base)"""


def _scored(spark: SparkSession, d: str, method: str) -> DataFrame:
    items, nodes = _linked(spark, d)
    placed = cells(spark, d).join(items.withColumnRenamed("item", "c"), "c").join(hierarchy.leaf_gaps(nodes), "leaf")
    own = stored(matrices.weights_below(placed.select("m", "v", F.struct("place", "leaf", "gap").alias("at")), "m", "at", "v"), "weights")
    return hierarchy.modularity(own, own.agg(F.sum("inside").alias("total")), nodes, method=method)


@query(f"WITH RECURSIVE {_SCORES} SELECT node, leaves, round(ayroles, 7) AS ayroles FROM scores")
def node_modularity(spark, d):
    return _scored(spark, d, "ayroles").select("node", "leaves", F.round("modularity", 7).alias("ayroles"))


@query(f"""WITH RECURSIVE {_SCORES}, bar AS (SELECT quantile_cont(haq, 0.3) AS bar FROM scores WHERE leaves > 1), fit AS (SELECT s.*, haq >= bar AND leaves > 3 AS fits FROM scores s, bar),
reached AS (SELECT node, parent FROM fit WHERE parent IS NULL UNION ALL SELECT f.node, f.parent FROM reached r JOIN fit f ON f.parent = r.node WHERE f.fits),
cut AS (SELECT node FROM reached WHERE node NOT IN (SELECT parent FROM reached WHERE parent IS NOT NULL)), ranks AS (SELECT node, row_number() OVER (ORDER BY first_leaf) AS rank FROM cut JOIN nodes USING (node))
SELECT leaf, coalesce(node, 0) AS cluster, coalesce(rank, 0) AS rank FROM items LEFT JOIN (SELECT leaf, node, rank FROM within JOIN ranks USING (node)) USING (leaf)""")
def modularity_partition(spark, d):
    scored = stored(_scored(spark, d, "haq"), "scored-nodes")
    return hierarchy.partition(scored, hierarchy.modularity_cut(scored, minsize=3, percentile=30))
