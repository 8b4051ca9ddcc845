"""Single linkage, dendrograms and cuts against plain loops; tiled correlations against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkomics.operators import hierarchy as H
from sparkomics.operators import matrices
from sparkomics.operators.storage import stored


def plain_linkage(n, far):
    """[(left, right, height)] by repeated search for the least distance; far: {(a, b): d}, a < b."""
    label, out = list(range(n)), []
    while True:
        open_pairs = [(d, a, b) for (a, b), d in far.items() if label[a] != label[b]]
        if not open_pairs:
            return out
        d, a, b = min(open_pairs)
        left, right = sorted((label[a], label[b]))
        label = [n + len(out) if x in (left, right) else x for x in label]
        out.append((left, right, d))


def plain_leaves(n, merged):
    below = {i: [i] for i in range(n)}
    for k, (left, right, _) in enumerate(merged):
        below[n + k] = below[left] + below[right]
    return below


def distances(n, seed, whole=True, values=40):
    rng = random.Random(seed)
    return {(a, b): float(rng.randrange(values)) for a in range(n) for b in range(a + 1, n) if whole or rng.random() < 2.2 / n}


@pytest.mark.parametrize("kind, block", [("ties", H.BLOCK), ("chain", 2), ("forest", 4)])
def test_merges(spark, kind, block):
    n = 14
    far = {(i, i + 1): float(i) for i in range(n - 1)} if kind == "chain" else distances(n, block, kind == "ties")
    want = plain_linkage(n, far)
    edges = spark.createDataFrame([(b, a, d) if (a + b) % 2 else (a, b, d) for (a, b), d in far.items()], "a long, b long, d double")
    tree = H.spanning_tree(edges)
    got = [(r["left"], r["right"], r["height"]) for r in H.merges(tree, n, block).orderBy("step").collect()]
    assert got == want
    nodes = {r["node"]: r for r in H.dendrogram(H.merges(tree, n, block), n).collect()}
    below = plain_leaves(n, want)
    order = sorted(range(n), key=lambda i: nodes[i]["first_leaf"])
    assert set(nodes) == set(below)
    for node, members in below.items():
        assert order[nodes[node]["first_leaf"] : nodes[node]["last_leaf"] + 1] == members and nodes[node]["leaves"] == len(members)


def test_linkage_of_named_items(spark):
    far = distances(18, 3)
    name = [f"item {chr(122 - i)}" for i in range(18)]
    rows = [(name[a], name[b], d) for (a, b), d in far.items()] + [(name[0], name[0], 5.0), (None, name[1], 1.0), (name[1], name[0], 99.0)]
    rows[3], rows[9] = (*rows[3][:2], None), (*rows[9][:2], float("nan"))
    items, nodes = H.linkage(spark.createDataFrame(rows, "a string, b string, distance double"))
    leaf = {r["item"]: r["leaf"] for r in items.collect()}
    assert leaf == {x: i for i, x in enumerate(sorted(name))}
    numbered = {}
    for a, b, d in rows:
        if a and a != b:
            pair = tuple(sorted((leaf[a], leaf[b])))
            numbered[pair] = min(numbered.get(pair, math.inf), -1.0 if d is None or math.isnan(d) else d)
    want = plain_linkage(18, numbered)
    back = [(r["left"], r["right"], r["height"], r["leaves"]) for r in H.merge_table(nodes).orderBy("node").collect()]
    below = plain_leaves(18, want)
    assert back == [(*m, len(below[18 + k])) for k, m in enumerate(want)]
    order = [r["item"] for r in H.leaf_order(items, nodes).orderBy("place").collect()]
    assert order == [sorted(name)[i] for i in below[max(below)]]
    got = {}
    for r in H.leaves_below(nodes, nodes.filter("leaves > 1")).collect():
        got.setdefault(r["node"], set()).add(r["leaf"])
    assert got == {k: set(v) for k, v in below.items() if len(v) > 1}
    odd = nodes.filter("node != 0")
    assert H.merge_table(odd).count() == 0


def plain_cut(n, c, below, merged, sigma, minsize, percentile, method):
    """Scores of all nodes, and the nodes of the cut, by the definitions."""
    w = np.exp((np.abs(c) - 1) / sigma**2)
    y, scores = np.triu(w).sum(), {}
    for node, members in below.items():
        x, z, k = np.triu(w[np.ix_(sorted(members), sorted(members))]).sum(), w[members].sum(), len(members)
        scores[node] = x / y - (z / (2 * y)) ** 2
        if method == "haq":
            scores[node] *= 1 + 2 * x / (np.exp(1 / sigma**2) * k * (k - 1)) if k > 1 else 1
    bar = np.percentile([scores[v] for v in below if v >= n], percentile)
    modules, done = {max(below)}, set()
    while modules - done:
        node = min(modules - done)
        fit = [x for x in merged[node - n][:2] if scores[x] >= bar and len(below[x]) > minsize] if node >= n else []
        modules, done = ((modules - {node}) | set(fit) if fit else modules), done | {node}
    return scores, modules


@pytest.mark.parametrize("method, sigma, minsize, percentile", [("ayroles", 1.0, 2, 20), ("haq", 0.7, 1, 50)])
def test_modularity_cut(spark, method, sigma, minsize, percentile):
    rng = np.random.default_rng(minsize)
    n = 28
    groups = rng.integers(0, 4, n)
    c = np.corrcoef(rng.normal(size=(4, 30))[groups] + rng.normal(size=(n, 30)) * 0.7)
    far = {(a, b): round(float(1 - c[a, b]), 9) for a in range(n) for b in range(a + 1, n)}
    merged = plain_linkage(n, far)
    below = plain_leaves(n, merged)
    scores, modules = plain_cut(n, c, below, merged, sigma, minsize, percentile, method)
    _, nodes = H.linkage(spark.createDataFrame([(a, b, d) for (a, b), d in far.items()], "a long, b long, distance double"))
    matrix = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(n) for j in range(n)], "i long, j long, r double")
    scored = stored(H.node_modularity(matrix, nodes, sigma, method), "scored")
    assert {r["node"]: pytest.approx(r["modularity"], abs=1e-9) for r in scored.collect()} == scores
    cut = stored(H.modularity_cut(scored, minsize, percentile), "cut")
    assert {r["node"] for r in cut.collect()} == modules
    order = below[max(below)]
    ranks = {m: k for k, m in enumerate(sorted(modules, key=lambda m: min(order.index(i) for i in below[m])), 1)}
    want = {i: next(((m, ranks[m]) for m in modules if i in below[m]), (0, 0)) for i in range(n)}
    assert {r["leaf"]: (r["cluster"], r["rank"]) for r in H.partition(scored, cut).collect()} == want


@pytest.mark.parametrize("tile, rows, two", [(3, 4, False), (256, 512, False), (3, 4, True)])
def test_correlation_table(spark, tile, rows, two):
    rng = np.random.default_rng(tile)
    m = rng.normal(size=(23, 8)) + 1e6
    m[rng.random(m.shape) < 0.2] = np.nan
    m[:, 2], m[3:, 5] = 7.0, np.nan  # one column doesn't vary, one has few values
    cells = [(int(i), f"c{j}", float(m[i, j])) for i in range(23) for j in range(8) if not np.isnan(m[i, j])]
    schema = "row long, col string, v double"
    first = spark.createDataFrame([x for x in cells if not two or x[1] < "c3"] + [(1, None, 2.0), (None, "c1", 2.0), (2, "c1", None), (99, "c0", float("nan"))], schema)
    other = spark.createDataFrame([x for x in cells if x[1] >= "c3"], schema) if two else None
    got = {(r["a"], r["b"]): (r["n"], r["r"], r["p"]) for r in matrices.correlation_table(first, "row", "col", "v", other=other, tile=tile, rows=rows).collect()}
    want = {}
    for i in range(8):
        for j in range(8):
            both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            if (i < 3 <= j if two else i <= j) and both.any():
                x, y, n = m[both, i], m[both, j], int(both.sum())
                flat = n < 3 or np.ptp(x) == 0 or np.ptp(y) == 0
                want[f"c{i}", f"c{j}"] = (n, None if flat else np.corrcoef(x, y)[0, 1])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, r) in want.items():
        assert got[k][1] == (None if r is None else pytest.approx(r, abs=1e-7)), k
        assert (got[k][2] is None) == (r is None)


def test_two_thousand_columns(spark):
    """A plan doesn't name columns: 2,000 of them, with known r of two."""
    n = 2000
    cells = spark.range(12).selectExpr("id AS row").selectExpr("row", f"explode(sequence(0, {n - 1})) AS col").selectExpr("row", "col", "CAST(pmod(xxhash64(row, col), 1000) AS DOUBLE) AS v")
    table = stored(matrices.correlation_table(cells, "row", "col", "v"), "wide")
    assert table.count() == n * (n + 1) // 2
    values = {(r["row"], r["col"]): r["v"] for r in cells.filter("col IN (3, 1999)").collect()}
    want = np.corrcoef([values[i, 3] for i in range(12)], [values[i, 1999] for i in range(12)])[0, 1]
    assert table.filter("a = 3 AND b = 1999").first()["r"] == pytest.approx(want)


def matrix_of(spark, columns, rows, seed):
    """Cells of a matrix with ties, gaps and two columns without rows in common; and it, with nan where a cell is missing."""
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 4, size=(rows, columns)).astype(float)
    m[rng.random(m.shape) < 0.1] = np.nan
    m[:, 5], m[:, 7] = m[:, 2], 1.0  # a copy, and a column that doesn't vary
    m[: rows // 2, 0], m[rows // 2 :, 1] = np.nan, np.nan
    cells = [(i, f"c{j:02}", float(m[i, j])) for i in range(rows) for j in range(columns) if not np.isnan(m[i, j])]
    return spark.createDataFrame(cells, "row long, col string, v double"), m


def pairs_of(m):
    """(i, j): r of every two columns that share rows, i <= j; None where it isn't known."""
    out = {}
    for i in range(m.shape[1]):
        for j in range(i, m.shape[1]):
            both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            x, y = m[both, i], m[both, j]
            if both.any():
                out[i, j] = None if both.sum() < 3 or np.ptp(x) == 0 or np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1])
    return out


def test_correlations_go_nowhere_from_where_tiles_meet(spark):
    """Names come with the tiles: the pairs, whose number is the square of the columns', are in no join and no shuffle."""
    cells, _ = matrix_of(spark, 20, 12, 1)
    plan = matrices.correlation_table(cells, "row", "col", "v", tile=3)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "FlatMapGroupsInArrow"


def test_p_values_of_all_degrees():
    r = np.array([0.0, 1e-6, 0.2, -0.5, 0.9, -0.999, 1.0, np.nan])
    for n in (3, 4, 5, 6, 9, 80, 81, 402, 403, 5000):
        k = np.full(r.shape, float(n))
        with np.errstate(divide="ignore"):
            want = matrices.t_tails(np.sqrt(r * r * (k - 2) / (1 - r * r)), k - 2)
        assert np.allclose(matrices._p_values(r, k), want, rtol=1e-9, atol=1e-300, equal_nan=True), n


@pytest.mark.parametrize("tile, rows", [(3, 512), (256, 512), (3, 4)])
def test_edges_for_single_linkage(spark, tile, rows, monkeypatch):
    if rows == 4:
        monkeypatch.setattr(matrices, "BAND_BYTES", 0)  # by slices of rows
    n = 40
    cells, m = matrix_of(spark, n, 12, 2)
    far = {p: -1.0 if r is None else math.floor((1 - r) * 1e8 + 0.5) / 1e8 for p, r in pairs_of(m).items() if p[0] != p[1]}
    edges = stored(matrices.nearest_edges(cells, "row", "col", "v", tile=tile, rows=rows), "nearest-edges")
    got = {(int(r["a"][1:]), int(r["b"][1:])): r["distance"] for r in edges.collect()}
    assert all(far[p] == pytest.approx(d, abs=2e-8) for p, d in got.items())
    assert len(got) == n - 1 if tile > n else len(got) < len(far)
    _, nodes = H.linkage(edges)
    heights = [r["height"] for r in H.merge_table(nodes).orderBy("node").collect()]
    assert heights == pytest.approx([d for *_, d in plain_linkage(n, far)], abs=2e-8)


def test_tables_of_single_linkage_grow_with_the_items(spark):
    """merge_table and leaves_below of nodes from those edges: 300 columns, no stored table has a row for each pair."""
    cells = spark.range(9).selectExpr("id AS row", "explode(sequence(0, 299)) AS col").selectExpr("row", "col", "CAST(pmod(xxhash64(row, col), 1000) AS DOUBLE) AS v")
    edges = stored(matrices.nearest_edges(cells, "row", "col", "v", tile=16), "nearest-edges")
    assert edges.count() < 300 * 299 // 8
    items, nodes = H.linkage(edges)
    assert H.merge_table(nodes).count() == 299 and items.count() == 300
    below = H.leaves_below(nodes, nodes.filter("parent IS NULL"))
    assert sorted(r["leaf"] for r in below.collect()) == list(range(300))


@pytest.mark.parametrize("tile, method", [(3, "ayroles"), (256, "haq")])
def test_weights_below_nodes(spark, tile, method):
    n = 30
    cells, m = matrix_of(spark, n, 12, 4)
    pairs = {p: r or 0.0 for p, r in pairs_of(m).items()}
    items, nodes = H.linkage(stored(matrices.nearest_edges(cells, "row", "col", "v", tile=tile), "nearest-edges"))
    rows = [(i, j, r) for (i, j), r in pairs.items()] + [(j, i, r) for (i, j), r in pairs.items() if i != j]
    want = {r["node"]: r["modularity"] for r in H.node_modularity(spark.createDataFrame(rows, "i long, j long, r double"), nodes, 0.7, method).collect()}
    placed = cells.join(items.withColumnRenamed("item", "col"), "col").join(H.leaf_gaps(nodes), "leaf").select("row", "v", F.struct("place", "leaf", "gap").alias("at"))
    own = stored(matrices.weights_below(placed, "row", "at", "v", 0.7, tile=tile), "weights")
    got = {r["node"]: r["modularity"] for r in H.modularity(own, own.agg(F.sum("inside").alias("total")), nodes, 0.7, method).collect()}
    assert own.filter("inside > 0").count() < len(pairs) and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("name", ["seriated_correlations", "modularity_partition"])
def test_queries_keep_no_table_of_pairs(spark, name, monkeypatch):
    """Neither query reads a stored table with a row for each pair of columns; the order comes with the tiles."""
    from sparkomics.plans import matrix_queries, registry

    cells = spark.range(9).selectExpr("id AS m", "explode(sequence(0, 199)) AS c").selectExpr("m", "c", "CAST(pmod(xxhash64(m, c), 1000) AS DOUBLE) AS v")
    sizes = []
    monkeypatch.setattr(matrix_queries, "cells", lambda *_: cells)
    monkeypatch.setattr(matrix_queries, "_LINKED", {})
    monkeypatch.setattr(matrices, "TILE", 16)
    for module in (matrices, H, matrix_queries):
        monkeypatch.setattr(module, "stored", lambda df, label: (sizes.append(out.count()), out)[1] if (out := stored(df, label)) is not None else None)
    out = registry.queries()[name](spark, "")
    assert out.count() == (200 * 201 // 2 if name == "seriated_correlations" else 200)
    assert sizes and max(sizes) < 200 * 201 // 2
