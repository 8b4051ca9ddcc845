"""Running values over whole tables, and node numbers, against plain loops."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from sparkomics.operators import cohorts, ordered, trees


@pytest.fixture(params=[5])
def ranges(spark, request):
    """The number of ranges that a table is dealt over."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(request.param), "false")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_along_and_places(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice("abc" if rng.random() < 0.7 else "a"), i, rng.choice([None, rng.randrange(100)])) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    v = F.col("v")
    got = {(r["g"], r["i"]): tuple(r)[3:] for r in ordered.along(df, ["g", "i"], sums={"s": v}, last={"l": v}, first={"f": v}, before={"b": v}, after={"a": v}).collect()}
    sorted_rows = sorted(rows, key=lambda r: r[:2])
    total, last = 0, None
    for k, (g, i, x) in enumerate(sorted_rows):
        total, last = total + (x or 0), last if x is None else x
        ahead = next((y for *_, y in sorted_rows[k:] if y is not None), None)
        assert got[g, i] == (total, last, ahead, sorted_rows[k - 1][2] if k else None, sorted_rows[k + 1][2] if k + 1 < len(rows) else None)
    placed = {(r["g"], r["i"]): (r["place"], r["place_from_end"]) for r in ordered.places(df, ["g"], ["i"]).collect()}
    for g in "abc":
        members = [i for h, i, _ in sorted_rows if h == g]
        assert [placed[g, i] for i in members] == [(k, len(members) - 1 - k) for k in range(len(members))]


def plans(make):
    """The plans of all queries that are executed while make runs, and of what it returns."""
    seen, inner = [], ordered.stored

    def watched(df, label):
        seen.append(df._jdf.queryExecution().toString())
        return inner(df, label)

    with pytest.MonkeyPatch.context() as patch:
        for name, other in list(sys.modules.items()):
            if name.startswith("sparkomics.") and getattr(other, "stored", None) is inner:
                patch.setattr(other, "stored", watched)
        seen.append(make()._jdf.queryExecution().toString())
    return seen


def test_no_frame_up_to_the_end_of_a_range(spark):
    """Spark goes through such a frame anew for each row: the square of a range's rows."""
    df = spark.range(100).select((F.col("id") % 3).alias("p"), F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").alias("v"))
    told = plans(lambda: cohorts.nearest_measurement(df, df.withColumnRenamed("at", "when"), ["p"], "at", "when", ["v"], 9, "after"))
    assert told and not [x for x in told if "(RowFrame, currentrow$(), unboundedfollowing$())" in x]


def plain_numbers(children, roots):
    """pre, post, depth, size, first_leaf, leaves by a walk."""
    out, pre, post, leaf = {}, 0, 0, 0
    stack = [(r, 0, False) for r in reversed(roots)]
    opened = {}
    while stack:
        node, depth, done = stack.pop()
        if done:
            p, first = opened[node]
            out[node] = (p, post, depth, pre - p, first, leaf - first)
            post += 1
            continue
        opened[node] = pre, leaf
        pre += 1
        leaf += not children.get(node)
        stack.append((node, depth, True))
        stack += [(c, depth + 1, False) for c in reversed(children.get(node, []))]
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "forest"])
def test_tree_numbers(spark, shape):
    rng = random.Random(len(shape))
    n = 60
    parent = {i: {"chain": i - 1 if i else None, "star": 0 if i else None, "forest": rng.choice([None, rng.randrange(i)]) if i else None}[shape] for i in range(n)}
    order = {i: rng.randrange(5) for i in range(n)}
    children, key = {}, lambda i: (order[i], i)
    for i in sorted(range(n), key=key):
        children.setdefault(parent[i], []).append(i)
    want = plain_numbers(children, children[None])
    rows = [(t, i, parent[i], order[i]) for t in ("x", "y") for i in range(n)] + [("z", 1, 2, 0), ("z", 2, 1, 0), ("one", 7, None, 0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, o int")
    got = {(r[0], r[1]): tuple(r)[2:] for r in ordered.tree_numbers(df, ["tree"], "node", "parent", ["o"]).collect()}
    assert got == {(t, i): want[i] for t in ("x", "y") for i in range(n)} | {("one", 7): (0, 0, 0, 1, 0, 1)}


def test_tree_edits_on_random_trees(spark):
    """Edits against plain loops over nested lists."""
    rng = random.Random(9)
    rows, plain = [], {}
    for t in range(12):
        n, kids, name, length, nodes = rng.randrange(1, 25), {}, {}, {}, []
        for i in range(n):
            p = rng.randrange(i) if i else None
            kids.setdefault(p, []).append(i)
            name[i], length[i] = rng.choice([None, f"n{rng.randrange(6)}"]), rng.choice([None, float(rng.randrange(9))])
            rows.append((t, i, p, name[i], length[i], len(kids[p]) - 1, 0))
        plain[t] = (kids, name, length)
    df = spark.createDataFrame(rows, "tree long, node_id int, parent_id int, name string, length double, ord int, depth int").cache()

    def text(kids, name, length, node):
        inner = ",".join(text(kids, name, length, c) for c in kids.get(node, []))
        return (f"({inner})" if kids.get(node) else "") + (name[node] or "") + ("" if length[node] is None else f":{length[node]:g}")

    written = lambda out: {r["tree"]: r["newick"] for r in trees.to_newick(out).collect()}
    assert written(df) == {t: text(*p, 0) + ";" for t, p in plain.items()}

    def pruned(kids, name, gone):
        return {p: [c for c in cs if not gone(c, kids, name)] for p, cs in kids.items()}

    by_name = lambda c, kids, name: name[c] in ("n1", "n2")
    others = lambda c, kids, name: not kids.get(c) and name[c] not in ("n1", "n2")
    assert written(trees.prune(df, ["n1", "n2"])) == {t: text(pruned(k, n, by_name), n, x, 0) + ";" for t, (k, n, x) in plain.items()}
    assert written(trees.prune(df, ["n1", "n2"], inverse=True)) == {t: text(pruned(k, n, others), n, x, 0) + ";" for t, (k, n, x) in plain.items()}

    def collapsed(kids, name, length, node):
        known = [length[node]]
        while len(kids.get(node, [])) == 1:
            node = kids[node][0]
            known.append(length[node])
        total = [x for x in known if x is not None]
        inner = ",".join(collapsed(kids, name, length, c) for c in kids.get(node, []))
        return (f"({inner})" if kids.get(node) else "") + (name[node] or "") + (f":{sum(total):g}" if total else "")

    assert written(trees.collapse(df)) == {t: collapsed(*p, 0) + ";" for t, p in plain.items()}

    def resolved(kids, name, length, node):
        def group(nodes):
            if len(nodes) <= 2:
                return ",".join(resolved(kids, name, length, c) for c in nodes)
            return resolved(kids, name, length, nodes[0]) + ",(" + group(nodes[:0:-1]) + "):0"

        inner = group(kids.get(node, []))
        return (f"({inner})" if kids.get(node) else "") + (name[node] or "") + ("" if length[node] is None else f":{length[node]:g}")

    assert written(trees.resolve_polytomies(df)) == {t: resolved(*p, 0) + ";" for t, p in plain.items()}
    first = {r["tree"]: r["node_id"] for r in trees.node_by_name(df, "n3").collect()}
    walk = {t: [n for n, _ in sorted(plain_numbers(k, [0]).items(), key=lambda x: x[1][0])] for t, (k, _, _) in plain.items()}
    assert first == {t: next(n for n in walk[t] if p[1][n] == "n3") for t, p in plain.items() if "n3" in p[1].values()}
