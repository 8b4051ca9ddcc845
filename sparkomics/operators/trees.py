"""Edits and walks of trees given as node tables (tree, node_id, parent_id, name, length, ord, depth), as read_newick makes
them. A tree of any size is spread over tasks: walks come from `tree_numbers`, what holds of all nodes above a node from sums
along a walk, and chains of nodes from pointer doubling. Siblings are in the order of `ord`, then node_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.operators.ordered import along, places, tree_numbers
from sparkomics.operators.storage import dropped, stored

COLUMNS = ["tree", "node_id", "parent_id", "name", "length", "ord", "depth"]


def _numbers(trees: DataFrame) -> DataFrame:
    return tree_numbers(trees, ["tree"], "node_id", "parent_id", ["ord"])


def _with_depth(trees: DataFrame) -> DataFrame:
    trees = stored(trees, "edited-trees")
    return trees.drop("depth").join(_numbers(trees).select("tree", "node_id", F.col("depth").cast("int").alias("depth")), ["tree", "node_id"]).select(*COLUMNS)


def walks(trees: DataFrame) -> DataFrame:
    """The nodes with their places, from 0, in pre-order and post-order, and their depth."""
    numbers = _numbers(trees).select("tree", "node_id", "pre", "post", F.col("depth").cast("int").alias("depth"))
    return trees.drop("depth").join(numbers, ["tree", "node_id"]).select(*COLUMNS, "pre", "post")


def leaves(trees: DataFrame) -> DataFrame:
    """tree, node_id, name, place of the leaves, in the order of a walk."""
    numbers = _numbers(trees).filter("size = 1").select("tree", "node_id", F.col("first_leaf").alias("place"))
    return trees.select("tree", "node_id", "name").join(numbers, ["tree", "node_id"])


def node_by_name(trees: DataFrame, name: str) -> DataFrame:
    """The first node of each tree, in pre-order, that has the name."""
    found = walks(trees).filter(F.col("name") == name)
    return found.groupBy("tree").agg(F.min_by(F.struct(*[c for c in found.columns if c != "tree"]), "pre").alias("n")).select("tree", "n.*").select(*COLUMNS)


def children(trees: DataFrame, node: int) -> DataFrame:
    return trees.filter(F.col("parent_id") == node)


def child_counts(trees: DataFrame) -> DataFrame:
    """tree, node_id, n: how many children each node has."""
    n = trees.filter("parent_id IS NOT NULL").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    return trees.select("tree", "node_id").join(n, ["tree", "node_id"], "left").fillna(0, ["n"])


def is_binary(trees: DataFrame) -> DataFrame:
    """tree, binary: whether all nodes have two children or none."""
    return child_counts(trees).groupBy("tree").agg(F.bool_and(F.col("n").isin(0, 2)).alias("binary"))


def _with_kind(trees: DataFrame) -> DataFrame:
    return trees.join(child_counts(trees), ["tree", "node_id"])


def without_names(trees: DataFrame, leaves: bool = True, internal: bool = True) -> DataFrame:
    """The trees without the names of leaves, of inner nodes, or of both."""
    gone = F.when(F.col("n") == 0, F.lit(leaves)).otherwise(F.lit(internal))
    return _with_kind(trees).withColumn("name", F.when(~gone, F.col("name"))).select(*trees.columns)


def without_lengths(trees: DataFrame) -> DataFrame:
    return trees.withColumn("length", F.lit(None).cast("double"))


def name_internal(trees: DataFrame) -> DataFrame:
    """Inner nodes without a name are internal_1 and so on, in pre-order."""
    told = trees.join(_numbers(trees).select("tree", "node_id", "pre", "size"), ["tree", "node_id"])
    unnamed = (F.col("size") > 1) & F.col("name").isNull()
    counted = along(told, ["tree", "pre"], sums={"__k": unnamed.cast("long")})
    based = along(counted, ["tree", "pre"], last={"__base": F.when(F.col("pre") == 0, F.col("__k") - unnamed.cast("long"))})
    number = F.concat(F.lit("internal_"), (F.col("__k") - F.col("__base")).cast("string"))
    return based.withColumn("name", F.when(unnamed, number).otherwise(F.col("name"))).select(*trees.columns)


def below(trees: DataFrame, numbers: DataFrame, marked: DataFrame) -> DataFrame:
    """tree, node_id of all marked nodes and what is below them: a running sum of the marked nodes that a walk is within."""
    spans = numbers.join(marked.select("tree", "node_id").distinct(), ["tree", "node_id"], "left_semi")
    opened = spans.select("tree", F.col("pre").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("node_id"), "pre", F.lit(1).cast("long").alias("open"))
    closed = spans.select("tree", (F.col("pre") + F.col("size")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node_id"), "pre", F.lit(-1).cast("long").alias("open"))
    nodes = numbers.select("tree", F.col("pre").alias("at"), F.lit(2).alias("kind"), F.col("node_id").cast("long").alias("node_id"), "pre", F.lit(0).cast("long").alias("open"))
    inside = along(opened.unionByName(closed).unionByName(nodes), ["tree", "at", "kind", "pre"], sums={"within": F.col("open")})
    return inside.filter("kind = 2 AND within > 0").select("tree", F.col("node_id").cast(trees.schema["node_id"].dataType).alias("node_id"))


def prune(trees: DataFrame, names: list[str] | DataFrame, inverse: bool = False) -> DataFrame:
    """The trees without the nodes of these names (a list, or a table with a column `name`), or without all leaves of other
    names, and without what is below them; roots stay, and so do inner nodes that lose all their children."""
    named = trees.sparkSession.createDataFrame([(n,) for n in names], "name string") if isinstance(names, list) else names.select("name")
    wanted = named.distinct().withColumn("__wanted", F.lit(True))
    numbers = stored(_numbers(trees), "tree-numbers")
    told = trees.select("tree", "node_id", "parent_id", "name").join(numbers.select("tree", "node_id", "size"), ["tree", "node_id"]).join(wanted, "name", "left")
    has, leaf = F.col("__wanted").isNotNull(), F.col("size") == 1
    gone = told.filter(leaf & ~has if inverse else has).filter("parent_id IS NOT NULL")
    return trees.join(below(trees, numbers, gone), ["tree", "node_id"], "left_anti").select(*trees.columns)


def collapse(trees: DataFrame) -> DataFrame:
    """The trees without nodes of a single child, whose length goes to the child. Chains of such nodes are walked by pointer
    doubling: a node looks up what the one above it has found so far."""
    told = _with_kind(trees).withColumn("lone", F.col("n") == 1).drop("n")
    now = stored(told.withColumn("up", F.col("parent_id")), "lone-chains")
    while True:
        lone = now.filter("lone").select("tree", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("length").alias("__length"), F.col("ord").alias("__ord"), F.lit(True).alias("__lone"))
        joined = now.join(lone, ["tree", "up"], "left")
        if joined.filter("__lone").isEmpty():
            break
        hop = F.col("__lone").isNotNull()
        length = F.when(hop, F.coalesce(F.col("length") + F.col("__length"), "length", "__length")).otherwise(F.col("length"))
        further = joined.select("tree", "node_id", "parent_id", "name", length.alias("length"), F.when(hop, F.col("__ord")).otherwise(F.col("ord")).alias("ord"), "depth", "lone", F.when(hop, F.col("__up")).otherwise(F.col("up")).alias("up"))
        further = stored(further, "lone-chains")
        dropped(now)
        now = further
    return _with_depth(now.filter("NOT lone").withColumn("parent_id", F.col("up")).select(*COLUMNS))


def resolve_polytomies(trees: DataFrame) -> DataFrame:
    """Nodes of more than two children keep the first; the others go, the last one first, to new nodes of length 0.

    So of k children the first stays, the last goes to the first new node, the second to the next, and so on from both
    ends, and the last new node has two. A new node's number is behind all others'.
    """
    below_root = places(trees.filter("parent_id IS NOT NULL"), ["tree", "parent_id"], ["ord", "node_id"])
    k = F.col("place") + F.col("place_from_end") + 1
    turn = F.when(F.col("place") * 2 < k, F.col("place") * 2).otherwise(F.col("place_from_end") * 2 + 1)
    told = below_root.withColumn("__k", k).withColumn("__turn", turn).drop("place", "place_from_end")
    new = (F.col("__k") > 2) & (F.col("__turn") > 0) & (F.col("__turn") < F.col("__k") - 1)
    told = along(told, ["tree", "parent_id", "__turn"], sums={"__new": new.cast("long")})
    most = trees.agg(F.max("node_id").alias("__most"))
    told = stored(told.join(F.broadcast(most)).withColumn("__new", F.col("__most") + F.col("__new")), "polytomies")  # one row
    kind = trees.schema["node_id"].dataType
    number = F.col("__new").cast(kind)
    moved = (F.col("__k") > 2) & (F.col("__turn") > 0)
    kept = told.withColumn("parent_id", F.when(moved, number).otherwise(F.col("parent_id")))
    kept = kept.withColumn("ord", F.when(F.col("__k") > 2, F.when(F.col("__turn") == F.col("__k") - 1, 1).otherwise(0)).otherwise(F.col("ord")))
    above = F.when(F.col("__turn") == 1, F.col("parent_id")).otherwise((F.col("__new") - 1).cast(kind))
    made = told.filter(new).select(
        "tree", number.alias("node_id"), above.alias("parent_id"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("length"), F.lit(1).alias("ord"), "depth"
    )
    return _with_depth(trees.filter("parent_id IS NULL").select(*COLUMNS).unionByName(kept.select(*COLUMNS)).unionByName(made))


def to_newick(trees: DataFrame) -> DataFrame:
    """tree, newick: each tree as text, put together from what a walk writes where it enters and leaves a node."""
    told = trees.join(_numbers(trees).select("tree", "node_id", "pre", "post", F.col("depth").alias("level"), "size"), ["tree", "node_id"])
    siblings = places(told.select("tree", "parent_id", "ord", "node_id"), ["tree", "parent_id"], ["ord", "node_id"]).select("tree", "node_id", "place")
    told = told.join(siblings, ["tree", "node_id"])
    whole = F.col("length") == F.floor("length")
    shown = F.when(whole & (F.abs("length") < 1e15), F.col("length").cast("long").cast("string")).otherwise(F.col("length").cast("string"))
    length = F.when(F.col("length").isNull(), "").otherwise(F.concat(F.lit(":"), shown))
    comma = F.when((F.col("place") > 0) & F.col("parent_id").isNotNull(), ",").otherwise("")
    inner = F.col("size") > 1
    # A walk enters a node after pre nodes, and has left pre - depth of them; it leaves one after pre + size nodes.
    begin = F.struct((F.col("pre") * 2 - F.col("level")).alias("at"), F.concat(comma, F.when(inner, "(").otherwise("")).alias("text"))
    end = F.struct((F.col("pre") + F.col("size") + F.col("post")).alias("at"), F.concat(F.when(inner, ")").otherwise(""), F.coalesce("name", F.lit("")), length).alias("text"))
    tokens = told.select("tree", F.explode(F.array(begin, end)).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "")
    return tokens.groupBy("tree").agg(F.concat(text, F.lit(";")).alias("newick"))


def write_newick(trees: DataFrame, path: str) -> None:
    to_newick(trees).select("newick").write.text(path)
