"""Hierarchies and networks as edge tables: descendants, neighbourhoods, identifier maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.operators.storage import stored


def descendants(edges: DataFrame, roots: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """root, node, depth of everything below each root (column `node`), down to `depth` steps; each node at its smallest.

    Every step is a join with the edges and is stored, so that the next one starts from it. Cycles are walked once.
    """
    level = roots.select(F.col("node").alias("root"), F.col("node"), F.lit(0).alias("depth"))
    found = level
    for d in range(1, depth + 1):
        step = level.join(edges.select(F.col(parent).alias("node"), F.col(child).alias("__next")), "node")
        level = step.select("root", F.col("__next").alias("node"), F.lit(d).alias("depth")).distinct().join(found.select("root", "node"), ["root", "node"], "left_anti")
        level = stored(level, "descendants")
        found = found.unionByName(level)
    return found.filter("depth > 0")


def neighbourhood(edges: DataFrame, chosen: DataFrame, hops: int, threshold: float, weight: str = "weight", a: str = "a", b: str = "b", self_links: bool = False) -> DataFrame:
    """The edges at the threshold or more within `hops` steps of the chosen nodes (column `node`): the induced subgraph.

    Edges are taken both ways. Self links, with weight 1000, are added on demand.
    """
    strong = edges.filter(F.col(weight) >= threshold).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("weight"))
    both = strong.select("a", "b").union(strong.select("b", "a")).distinct()
    nodes = chosen.select("node").distinct()
    for _ in range(hops):
        further = both.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
        nodes = stored(nodes.union(further).distinct(), "neighbourhood")
    out = strong.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "weight")
    loops = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1000).cast(out.schema["weight"].dataType).alias("weight"))
    return out.unionByName(loops) if self_links else out


def annotate(edges: DataFrame, sets: DataFrame, term: str, element: str, set_name: str) -> DataFrame:
    """term, set, n, members (sorted): the elements of each set under each term."""
    met = edges.select(term, element).distinct().join(sets.select(element, set_name).distinct(), element)
    return met.groupBy(term, set_name).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(element)).alias("members"))


def two_hop(first: DataFrame, second: DataFrame, source: str, via: str, target: str) -> DataFrame:
    """source, target: distinct pairs that meet over `via`."""
    return first.select(source, via).join(second.select(via, target), via).select(source, target).distinct()


def lookup(keys: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """All entries of each key; a key without any gives one row of nulls."""
    return keys.join(mapping, key, "left")


def lookup_values(keys: DataFrame, mapping: DataFrame, key: str, field: str) -> DataFrame:
    """key, first (the smallest), values (sorted, distinct, without nulls)."""
    return lookup(keys, mapping, key).groupBy(key).agg(F.min(field).alias("first"), F.sort_array(F.collect_set(field)).alias("values"))


def full_map(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The full outer join of two identifier tables: the left one with what it finds, and the rest of the right one.

    Spark's own holds all pairs of a key in memory before it hands on the first one; a left join those of one row.
    """
    rest = right.join(left.select(key), key, "left_anti")
    lacking = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != key]
    return left.join(right, key, "left").unionAll(rest.select(key, *lacking, *[c for c in right.columns if c != key]))


def linked_to(edges: DataFrame, keys: DataFrame, key: str, other: str) -> DataFrame:
    """The distinct edges of the keys: terms of objects, or objects of terms, by which column is the key."""
    return edges.select(key, other).distinct().join(keys.select(key).distinct(), key, "left_semi")


def distinct_nodes(edges: DataFrame, column: str) -> DataFrame:
    """The column's different values, without nulls."""
    return edges.filter(F.col(column).isNotNull()).select(column).distinct()


def children(edges: DataFrame, node, parent: str = "parent", child: str = "child") -> DataFrame:
    return edges.filter(F.col(parent) == node).select(child)


def parents(edges: DataFrame, node, parent: str = "parent", child: str = "child") -> DataFrame:
    return edges.filter(F.col(child) == node).select(parent)


def leaf_totals(edges: DataFrame, roots: DataFrame, values: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """root, n: the sum of `values` (node, n) of the leaves below each root (column `node`), as often as paths lead there."""
    inner = edges.select(F.col(parent).alias("node")).distinct()
    level = roots.select(F.col("node").alias("root"), "node").withColumn("paths", F.lit(1).cast("long"))
    found = level
    for _ in range(depth):
        step = level.join(edges.select(F.col(parent).alias("node"), F.col(child).alias("__next")), "node")
        level = stored(step.groupBy("root", F.col("__next").alias("node")).agg(F.sum("paths").alias("paths")), "paths")
        found = found.unionByName(level)
    leaves = found.join(inner, "node", "left_anti").join(values.withColumnRenamed("n", "__n"), "node")
    sums = leaves.groupBy("root").agg(F.sum(F.col("paths") * F.col("__n")).alias("n"))
    return roots.select(F.col("node").alias("root")).join(sums, "root", "left").fillna(0, ["n"])


def feature_counts(features: DataFrame, feature: str = "feature") -> DataFrame:
    """feature, n: how many rows there are of each kind."""
    return features.groupBy(feature).agg(F.count("*").alias("n"))


def last_of_id(features: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each id: of several the last one."""
    return features.groupBy(key).agg(F.max_by(F.struct(*[c for c in features.columns if c != key]), order).alias("__row")).select(key, "__row.*")
