"""Running values along the order of a whole table, and numbers of tree nodes, without a task that holds all rows.

A table is dealt over ranges of its order. Within a range a window does the work; what a range hands on to the next ones,
one row for each range, is joined back. So one large group is spread like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.operators.storage import dropped, stored


def along(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """The rows with running `sums` up to and with the row, the `last` values up to it and the `first` from it on that aren't
    null, and the values of the row `before` or `after`; each argument maps names to columns. The order must tell all rows
    apart."""
    sums, last, first, before, after = sums or {}, last or {}, first or {}, before or {}, after or {}
    rows = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    key, own = F.struct(*order), Window.partitionBy("__part").orderBy(*order)
    parts = rows.groupBy("__part").agg(
        *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), key)).alias(f"__last_{n}") for n, c in last.items()],
        *[F.min_by(c, F.when(c.isNotNull(), key)).alias(f"__first_{n}") for n, c in first.items()],
        *[F.max_by(F.struct(c.alias("v")), key).alias(f"__before_{n}") for n, c in before.items()],
        *[F.min_by(F.struct(c.alias("v")), key).alias(f"__after_{n}") for n, c in after.items()],
        F.count("*").alias("__rows"),
    )
    earlier, later = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    carried = parts.select(
        "__part",
        *[F.sum(f"__sum_{n}").over(earlier).alias(f"__sum_{n}") for n in sums],
        *[F.last(f"__last_{n}", True).over(earlier).alias(f"__last_{n}") for n in last],
        *[F.first(f"__first_{n}", True).over(later).alias(f"__first_{n}") for n in first],
        *[F.last(f"__before_{n}", True).over(earlier).alias(f"__before_{n}") for n in before],
        *[F.first(f"__after_{n}", True).over(later).alias(f"__after_{n}") for n in after],
    )
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    # What follows is what came before, from the end: a frame up to the end is gone through anew for each of its rows.
    from_end = Window.partitionBy("__part").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(carried), "__part")  # a row for each partition
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.coalesce(f"__sum_{n}", F.lit(0))).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.last(c, True).over(so_far), f"__last_{n}").alias(n) for n, c in last.items()],
        *[F.coalesce(F.last(c, True).over(from_end), f"__first_{n}").alias(n) for n, c in first.items()],
        *[F.coalesce(F.lag(F.struct(c.alias("v"))).over(own), f"__before_{n}")["v"].alias(n) for n, c in before.items()],
        *[F.coalesce(F.lead(F.struct(c.alias("v"))).over(own), f"__after_{n}")["v"].alias(n) for n, c in after.items()],
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number, from 0, in an order that tells all of them apart."""
    return along(df, order, sums={name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def places(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with `place` and `place_from_end` within `by`, from 0; `by` and `order` must tell all rows apart."""
    family = F.struct(*by) if by else F.lit(0)
    told = along(df, [*by, *order], sums={"__k": F.lit(1).cast("long")}, before={"__before": family}, after={"__after": family})
    opens, ends = ~F.coalesce(F.col("__before").eqNullSafe(family), F.lit(False)), ~F.coalesce(F.col("__after").eqNullSafe(family), F.lit(False))
    edges = along(told, ["__k"], last={"__from": F.when(opens, F.col("__k"))}, first={"__to": F.when(ends, F.col("__k"))})
    return edges.select(*df.columns, (F.col("__k") - F.col("__from")).alias("place"), (F.col("__to") - F.col("__k")).alias("place_from_end"))


def tree_numbers(nodes: DataFrame, by: list[str], node: str, parent: str, order: list[str]) -> DataFrame:
    """by, node, pre, post, depth, size, first_leaf, leaves: a node's numbers, from 0, in pre-order and post-order, its depth,
    the nodes from it downwards, and the interval of leaves below it, in the order of a walk.

    `nodes` has a row for each node of one or many trees, told apart by `by`; parent is null at roots, of which there may be
    several, `order` sorts siblings, and ties go by node. A walk enters and leaves each node once; those steps form a list,
    which pointer doubling ranks in as many rounds as its length has bits. No task holds a tree, a path or the children of a
    node. Nodes whose parents form a circle have no numbers and are left out.
    """
    rows = nodes.select(*by, F.col(node).alias("__n"), F.col(parent).alias("__p"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    family = F.struct(*by, "__p")
    rows = along(rows, [*by, "__p", *[f"__o{i}" for i in range(len(order))], "__n"], sums={"__k": F.lit(1).cast("long")}, before={"__family": family})
    rows = stored(rows.select(*by, "__n", "__p", "__k", F.coalesce(~F.col("__family").eqNullSafe(family), F.lit(True)).alias("__first")), "tree-rows")
    lasts = rows.filter("__p IS NOT NULL").groupBy(*by, F.col("__p").alias("__n")).agg(F.max("__k").alias("__child"))
    rows = rows.join(lasts, [*by, "__n"], "left")
    ups = rows.select(*by, F.col("__n").alias("__p"), F.col("__k").alias("__up")).join(rows.filter("__first AND __p IS NOT NULL").select(*by, "__p", "__k"), [*by, "__p"]).select("__k", "__up")
    rows = stored(rows.join(ups, "__k", "left"), "tree-rows")
    enter, leave, leaf = F.col("__k") * 2, F.col("__k") * 2 + 1, F.col("__child").isNull()
    entered = rows.select(enter.alias("at"), F.when(~F.col("__first"), leave - 2).otherwise(F.col("__up") * 2).alias("to"), F.lit(1).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs"), leaf.cast("long").alias("ends"))
    left = rows.select(leave.alias("at"), F.coalesce(F.col("__child") * 2 + 1, enter).alias("to"), F.lit(0).cast("long").alias("ins"), F.lit(1).cast("long").alias("outs"), F.lit(0).cast("long").alias("ends"))
    walk = stored(entered.unionByName(left), "tree-walk")
    n = walk.count()
    for _ in range(max(1, n).bit_length()):
        if walk.filter("to IS NOT NULL").isEmpty():
            break
        on = walk.select(F.col("at").alias("to"), F.col("to").alias("__to"), *[F.col(c).alias(f"__{c}") for c in ("ins", "outs", "ends")])
        more = walk.join(on, "to", "left").select("at", F.col("__to").alias("to"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("ins", "outs", "ends")])
        further = stored(more, "tree-walk")
        dropped(walk)
        walk = further
    walk = walk.filter("to IS NULL")
    first = walk.filter("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("__k"), F.col("ins").alias("__in"), F.col("outs").alias("__out"), F.col("ends").alias("__ends"))
    second = walk.filter("at % 2 = 1").select(((F.col("at") - 1) / 2).cast("long").alias("__k"), "ins", "outs", "ends")
    own = F.col("__ends") - leaf.cast("long")
    return rows.join(first, "__k").join(second, "__k").select(
        *by,
        F.col("__n").alias(node),
        (F.col("__in") - 1).alias("pre"),
        (F.col("outs") - 1).alias("post"),
        (F.col("__in") - F.col("__out") - 1).alias("depth"),
        (F.col("ins") - F.col("__in") + 1).alias("size"),
        own.alias("first_leaf"),
        (F.col("ends") - own).alias("leaves"),
    )
