"""Single-linkage hierarchies: spanning trees, merges, leaf orders, dendrogram tables, modularity cuts and partitions.

Items are what a distance table pairs; leaves are their numbers, from 0, in ascending order. A merge of step k makes node
n + k of n leaves. Nothing here holds a tree in one task: the spanning tree grows by rounds of least edges and contraction,
merges are found by halving the sorted edges, and numbers of nodes come from `tree_numbers`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.operators.matrices import NO_NODE
from sparkomics.operators.ordered import along, numbered, tree_numbers
from sparkomics.operators.storage import dropped, stored

#: Merges that one task finds at once.
BLOCK = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge: the first two columns, of any one ordered type.

    Alternating stars: each larger neighbour is linked to the smallest of a node and its neighbours, then each node and its
    smaller neighbours to the smallest of them, until nothing changes."""
    a, b = edges.columns[:2]
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        large = both.join(least, "a").filter("b > a AND b != to").select(F.col("b").alias("a"), F.col("to").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("to"))
        small = large.join(least, "a").filter("b != to").select(F.col("b").alias("a"), F.col("to").alias("b")).union(least.select("a", F.col("to").alias("b")))
        further = stored(small.distinct(), "edges")
        dropped(now)
        now, before = further, seen
        if (seen := mark(now)) == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def leaves(distances: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """leaf, item: the numbers of the items of a distance table, in ascending order; null items are none."""
    items = distances.select(F.col(a).alias("item")).union(distances.select(b)).filter("item IS NOT NULL").distinct()
    return numbered(items, ["item"], "leaf").select("leaf", "item")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """a, b, d: a minimum spanning tree of each connected part; of equal distances the smaller pair comes first.

    Each round takes the least edge out of every part, joins the parts that they connect, and keeps the least edge between
    any two of the new ones; so there are half as many parts at most after each round.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").filter("a != b")
    now = stored(ends.groupBy("a", "b").agg(F.min("d").alias("d")).select("a", "b", F.struct("d", "a", "b").alias("edge")), "parts")
    taken = now.limit(0).select("edge")
    while not now.isEmpty():
        both = now.union(now.select("b", "a", "edge"))
        least = stored(both.groupBy("a").agg(F.min(F.struct("edge", "b")).alias("m")).select("a", "m.b", "m.edge"), "least-edges")
        taken = taken.union(least.select("edge").distinct())
        part = components(least.select("a", "b"))
        joined = now.join(part.select(F.col("node").alias("a"), F.col("component").alias("p")), "a").join(part.select(F.col("node").alias("b"), F.col("component").alias("q")), "b")
        between = joined.filter("p != q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("edge").alias("edge"))
        further = stored(between, "parts")
        dropped(now)
        now = further
    return taken.select("edge.*")


def _first_merges(steps: list[int], u: list[int], v: list[int]) -> list[tuple[int, int]]:
    """The smallest leaves of both parts that each edge joins, in the order of steps."""
    least: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := least.get(top, top)) != top:
            top = up
        while x != top:
            least[x], x = top, least.get(x, x)
        return top

    out: list[tuple[int, int]] = [(0, 0)] * len(steps)
    for i in sorted(range(len(steps)), key=steps.__getitem__):
        out[i] = find(u[i]), find(v[i])
        least[max(out[i])] = min(out[i])
    return out


def merges(tree: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """step, left, right, height: the merges of single linkage over a spanning tree of leaves 0 to n - 1, left < right.

    The sorted edges are halved again and again: what the lower half connects is one leaf, the smallest, to the upper
    half. So blocks of edges become independent, and each is merged by one task. A leaf's last merge before tells which
    node stands for it.
    """
    now = stored(numbered(tree, ["d", "a", "b"], "step").select("step", "d", F.col("a").alias("u"), F.col("b").alias("v")), "merges")
    size = 1 << max(0, now.count() - 1).bit_length()
    while size > block:
        at = F.floor(F.col("step") / size)
        upper = F.floor(F.col("step") / (size // 2)) % 2 == 1
        ends = lambda c: F.struct(at.alias("at"), F.col(c).alias("x"))
        part = components(now.filter(~upper).select(ends("u").alias("a"), ends("v").alias("b")))
        high = now.filter(upper)
        for c in ("u", "v"):
            found = part.select(F.col("node").alias("__node"), F.col("component")["x"].alias("__to"))
            high = high.join(found, ends(c) == F.col("__node"), "left").withColumn(c, F.coalesce("__to", c)).drop("__node", "__to")
        further = stored(now.filter(~upper).unionByName(high), "merges")
        dropped(now)
        now, size = further, size // 2

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _first_merges(pdf["step"].tolist(), pdf["u"].tolist(), pdf["v"].tolist())
        return pdf[["step", "d"]].assign(u=[x[0] for x in found], v=[x[1] for x in found])

    blocks = now.groupBy(F.floor(F.col("step") / block).alias("at")).applyInPandas(within, "step long, d double, u long, v long")
    uses = stored(blocks, "merge-leaves").select("step", "d", F.explode(F.array("u", "v")).alias("leaf"))
    told = along(uses, ["leaf", "step"], before={"__used": F.struct("leaf", "step")})
    child = F.when(F.col("__used")["leaf"] == F.col("leaf"), F.col("__used")["step"] + n).otherwise(F.col("leaf"))
    return told.withColumn("__child", child).groupBy("step").agg(F.min("__child").alias("left"), F.max("__child").alias("right"), F.first("d").alias("height"))


def dendrogram(merged: DataFrame, n: int) -> DataFrame:
    """node, parent, height, depth, pre, size, leaves, first_leaf, last_leaf of all leaves and merges.

    first_leaf and last_leaf are places in the order of the leaves, so that what lies below a node is an interval; a leaf's
    place is its own first_leaf. Left parts come first.
    """
    children = merged.select(F.col("left").alias("node"), (F.col("step") + n).alias("parent")).union(merged.select("right", F.col("step") + n))
    every = merged.sparkSession.range(n).select(F.col("id").alias("node"), F.lit(0.0).alias("height")).unionByName(merged.select((F.col("step") + n).alias("node"), F.col("height").cast("double").alias("height")))
    nodes = stored(every.join(children, "node", "left"), "dendrogram")
    numbers = tree_numbers(nodes, [], "node", "parent", ["node"])
    return nodes.join(numbers, "node").select("node", "parent", "height", "depth", "pre", "size", "leaves", "first_leaf", (F.col("first_leaf") + F.col("leaves") - 1).alias("last_leaf"))


def merge_table(nodes: DataFrame) -> DataFrame:
    """left, right, height, leaves of each inner node, named `node`: what `dendrogram` was made from, if each has two children;
    else no rows."""
    inner = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("left"), F.max("node").alias("right"), F.count("*").alias("__n"))
    told = inner.join(nodes.select("node", "height", "leaves"), "node")
    binary = told.agg(F.coalesce(F.max(F.col("__n") != 2), F.lit(False)).alias("__odd"))
    return told.join(F.broadcast(binary)).filter("NOT __odd").select("node", "left", "right", "height", "leaves")  # one row


def linkage(distances: DataFrame, a: str = "a", b: str = "b", d: str = "distance") -> tuple[DataFrame, DataFrame]:
    """The items (leaf, item), and the nodes of their single-linkage dendrogram. Null and NaN distances are -1; pairs may come
    either way round, and of several the smallest distance holds; pairs that are missing are never merged directly."""
    items = stored(leaves(distances, a, b), "leaves")
    number = lambda c: items.select(F.col("item").alias(c), F.col("leaf").alias(f"__{c}"))
    value = F.coalesce(F.nanvl(F.col(d).cast("double"), F.lit(-1.0)), F.lit(-1.0))
    edges = distances.select(F.col(a).alias("__from"), F.col(b).alias("__to"), value.alias("d"))
    edges = edges.join(number("__from"), "__from").join(number("__to"), "__to").select(F.col("____from").alias("a"), F.col("____to").alias("b"), "d")
    n = items.count()
    return items, stored(dendrogram(merges(spanning_tree(edges), n), n), "nodes")


def leaf_order(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """item, place: the order of the items that the dendrogram implies."""
    return items.join(nodes.select(F.col("node").alias("leaf"), F.col("first_leaf").alias("place")), "leaf").select("item", "place")


def reordered(cells: DataFrame, order: DataFrame, row: str, column: str | None = None) -> DataFrame:
    """The cells (long form) with `row_place` and, of a symmetric matrix, `column_place`, by an order (item, place)."""
    out = cells.join(order.select(F.col("item").alias(row), F.col("place").alias("row_place")), row)
    return out if column is None else out.join(order.select(F.col("item").alias(column), F.col("place").alias("column_place")), column)


def leaves_below(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, leaf for each node of `chosen` (column node) and each leaf below it: by places within its interval."""
    spans = nodes.join(chosen.select("node").distinct(), "node", "left_semi").select("node", F.explode(F.sequence("first_leaf", "last_leaf")).alias("place"))
    return spans.join(nodes.filter("size = 1").select(F.col("node").alias("leaf"), F.col("first_leaf").alias("place")), "place").select("node", "leaf")


def _gaps(nodes: DataFrame) -> DataFrame:
    """at, top: the lowest node (leaves, node) above the leaf of place `at` and the next one."""
    parents = nodes.select(F.col("node").alias("__p"), F.struct("leaves", "node").alias("top"), F.col("first_leaf").alias("__from"))
    return nodes.join(parents, F.col("parent") == F.col("__p")).filter("first_leaf != __from").select((F.col("first_leaf") - 1).alias("at"), "top")


def leaf_gaps(nodes: DataFrame) -> DataFrame:
    """leaf, place, gap of each leaf, as `matrices.weights_below` takes them."""
    gap = F.coalesce(F.shiftleft(F.col("top")["leaves"].cast("long"), 32) + F.col("top")["node"], F.lit(NO_NODE))
    leaves_ = nodes.filter("size = 1").select(F.col("node").alias("leaf"), F.col("first_leaf").alias("place"))
    return leaves_.join(_gaps(nodes), F.col("place") == F.col("at"), "left").select("leaf", "place", gap.alias("gap"))


def _lowest_common(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of places (lo < hi) with `node`, the lowest above both: the largest node between any two leaves next to each
    other on the way, looked up in a table of the largest over 2^k of them."""
    level = stored(_gaps(nodes).select(F.lit(0).alias("level"), "at", "top"), "gaps")
    table, k, n = level, 0, level.count()
    while 2 << k <= n:
        right = level.select((F.col("at") - (1 << k)).alias("at"), F.col("top").alias("__right"))
        level = stored(level.join(right, "at").select(F.lit(k + 1).alias("level"), "at", F.greatest("top", "__right").alias("top")), "gaps")
        table, k = table.unionByName(level), k + 1
    width = F.col("hi") - F.col("lo")
    asked = pairs.withColumn("__level", F.floor(F.log2(width.cast("double"))).cast("int"))
    asked = asked.withColumn("__level", F.when(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), F.col("__level")) > width, F.col("__level") - 1).otherwise(F.col("__level")))
    look = lambda name: table.select(F.col("level").alias("__level"), F.col("at").alias(f"__at_{name}"), F.col("top").alias(f"__top_{name}"))
    asked = asked.withColumn("__at_a", F.col("lo")).withColumn("__at_b", (F.col("hi") - F.pow(F.lit(2.0), F.col("__level"))).cast("long"))
    both = asked.join(look("a"), ["__level", "__at_a"]).join(look("b"), ["__level", "__at_b"])
    return both.select(*pairs.columns, F.greatest("__top_a", "__top_b")["node"].alias("node"))


def node_modularity(matrix: DataFrame, nodes: DataFrame, sigma: float = 1.0, method: str = "ayroles") -> DataFrame:
    """The nodes with `modularity`: the part of all weights that lies within a node's leaves, less the squared part of all that
    its leaves have. Weights are exp((|r| - 1) / sigma^2) of a symmetric matrix in rows of leaves i, j and r, both ways round.
    By method haq it is multiplied by 1 + twice the weight within, by exp(1 / sigma^2) n (n - 1).

    A pair of leaves counts where the lowest node above both is; running sums over the walk carry that up the tree.
    """
    weights = matrix.select("i", "j", F.exp((F.abs("r") - 1) / (sigma * sigma)).alias("w"))
    place = nodes.filter("size = 1").select(F.col("node").alias("leaf"), F.col("first_leaf").alias("at"))
    upper = weights.filter("i <= j").join(place.select(F.col("leaf").alias("i"), F.col("at").alias("p")), "i").join(place.select(F.col("leaf").alias("j"), F.col("at").alias("q")), "j")
    upper = upper.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "w")
    at_leaf = upper.filter("lo = hi").join(place, F.col("lo") == F.col("at")).select(F.col("leaf").alias("node"), F.col("w").alias("inside"), F.lit(0.0).alias("every"))
    between = _lowest_common(upper.filter("lo < hi"), nodes).select("node", F.col("w").alias("inside"), F.lit(0.0).alias("every"))
    rows = weights.select(F.col("i").alias("node"), F.lit(0.0).alias("inside"), F.col("w").alias("every"))
    own = at_leaf.unionByName(between).unionByName(rows)
    return modularity(own, weights.filter("i <= j").agg(F.sum("w").alias("total")), nodes, sigma, method)


def modularity(own: DataFrame, total: DataFrame, nodes: DataFrame, sigma: float = 1.0, method: str = "ayroles") -> DataFrame:
    """The same from the sums of weights: node, inside (of pairs whose lowest node it is), every (of all pairs of a leaf), and
    the total of all pairs in a row; as `matrices.weights_below` finds them without a table of pairs."""
    own = own.groupBy("node").agg(F.sum("inside").alias("inside"), F.sum("every").alias("every"))
    walked = nodes.select("node", "pre", "size").join(own, "node", "left").fillna(0.0, ["inside", "every"])
    walked = stored(along(walked, ["pre"], sums={"inside_so_far": F.col("inside"), "every_so_far": F.col("every")}), "node-sums")
    ends = walked.select(F.col("pre").alias("__end"), F.col("inside_so_far").alias("__inside"), F.col("every_so_far").alias("__every"))
    summed = walked.join(ends, F.col("pre") + F.col("size") - 1 == F.col("__end")).select(
        "node", (F.col("__inside") - F.col("inside_so_far") + F.col("inside")).alias("inside"), (F.col("__every") - F.col("every_so_far") + F.col("every")).alias("every")
    )
    n, share = F.col("leaves"), F.col("every") / (2 * F.col("total"))
    value = F.col("inside") / F.col("total") - share * share
    if method.lower() == "haq":
        value = F.when(n > 1, 1 + 2 * F.col("inside") / (math.exp(1 / sigma**2) * n * (n - 1))).otherwise(1.0) * value
    return nodes.join(summed.join(F.broadcast(total)), "node").select(*nodes.columns, value.alias("modularity"))  # one row


def modularity_cut(scored: DataFrame, minsize: int = 20, percentile: float = 95) -> DataFrame:
    """Those nodes at which opening the tree from its roots ends: a node is opened while any child has a modularity at the
    percentile of inner nodes or above, and more than `minsize` leaves; only such children stay.

    A node is reached if all nodes from the root's children down to it are such; their number without is a running sum.
    """
    bar = scored.filter("size > 1").agg(F.percentile("modularity", percentile / 100).alias("__bar"))
    told = scored.join(F.broadcast(bar))  # one row
    closed = (F.col("parent").isNotNull() & ~F.coalesce((F.col("modularity") >= F.col("__bar")) & (F.col("leaves") > minsize), F.lit(False))).cast("long")
    told = stored(told.withColumn("__closed", closed).drop("__bar"), "closed-nodes")
    opens = told.select("node", F.col("pre").alias("__at"), F.lit(1).alias("__kind"), "__closed")
    ends = told.select("node", (F.col("pre") + F.col("size")).alias("__at"), F.lit(0).alias("__kind"), (-F.col("__closed")).alias("__closed"))
    above = along(opens.unionByName(ends), ["__at", "__kind", "node"], sums={"__above": F.col("__closed")}).filter("__kind = 1 AND __above = 0").select("node")
    reached = stored(told.drop("__closed").join(above, "node", "left_semi"), "reached-nodes")
    return reached.join(reached.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def partition(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """leaf, cluster, rank of every leaf: the node of `cut` above it (0: none), and that node's number, from 1, by the
    first leaf in the dendrogram's order. Nodes of a cut don't lie below each other."""
    starts = cut.select(F.col("first_leaf").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("leaf"), F.struct("node", "last_leaf").alias("span"))
    members = nodes.filter("size = 1").select(F.col("first_leaf").alias("at"), F.lit(1).alias("kind"), F.col("node").alias("leaf"), F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    told = along(starts.unionByName(members), ["at", "kind"], last={"__in": F.col("span")}, sums={"__rank": (1 - F.col("kind")).cast("long")})
    inside = F.coalesce(F.col("__in")["last_leaf"] >= F.col("at"), F.lit(False))
    return told.filter("kind = 1").select("leaf", F.when(inside, F.col("__in")["node"]).otherwise(F.lit(0)).alias("cluster"), F.when(inside, F.col("__rank")).otherwise(F.lit(0)).alias("rank"))
