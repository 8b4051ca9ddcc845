"""Correlations of many columns of a matrix in long form, by tiles.

Cells are dealt into blocks of ROWS rows by TILE columns. Tiles of few rows are put into bands, and every two bands meet in a
task that goes through their tiles two by two; so a tile is sent as often as there are bands. Where a matrix has more rows
than a band may hold, every two tiles meet block by block in tasks that add up six matrices of the tiles' size, and what the
slices of rows give is added once more. So no plan names a column, memory holds a few tiles whatever the table's size, and
thousands of columns are one plan. What is asked of all pairs (edges of a spanning tree, weights below the nodes of a tree) is
found where tiles meet, and the pairs themselves are not stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.functions.special import t_tails
from sparkomics.operators.ordered import numbered
from sparkomics.operators.stats import with_rank
from sparkomics.operators.storage import stored

TILE = 256
ROWS = 512
#: Slices of row blocks that are added up apart.
SLICES = 16
#: Bytes of a band of tiles, and its tiles, at most.
BAND_BYTES = 1 << 25
BAND = 12

_BLOCK = "block long, tile long, cells binary"
_SUMS = "ta long, tb long, sums binary"

#: Of two tiles: their numbers, the six sums of `_products`, and the names of their columns.
Met = tuple[int, int, np.ndarray, pa.Array, pa.Array]


def _blocks(cells: DataFrame, tile: int, rows: int) -> DataFrame:
    """Dense blocks of cells (__r, __c, __v): null where a cell is missing; of several cells in a place the largest counts."""

    def dense(group: pa.Table) -> pa.Table:
        r, c = np.asarray(group["__r"]), np.asarray(group["__c"])
        out = np.full((rows, tile), -np.inf)
        np.maximum.at(out, (r % rows, c % tile), np.asarray(group["__v"], dtype=float))
        out[np.isneginf(out)] = np.nan
        return pa.table({"block": [int(r[0]) // rows], "tile": [int(c[0]) // tile], "cells": [out.tobytes()]})

    return cells.groupBy(F.floor(F.col("__r") / rows).alias("block"), F.floor(F.col("__c") / tile).alias("tile")).applyInArrow(dense, _BLOCK)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n, sums of x, y, xx, yy and xy of each column of a with each of b, over rows that have both."""
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    x, y, in_a, in_b = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0), has_a.astype(float), has_b.astype(float)
    return np.stack([in_a.T @ in_b, x.T @ in_b, in_a.T @ y, (x * x).T @ in_b, in_a.T @ (y * y), x.T @ y])


def _r(sums: np.ndarray) -> np.ndarray:
    """Correlations; nan where a side doesn't vary."""
    n, x, y, xx, yy, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy = xx - x * x / n, yy - y * y / n
        flat = (dx <= 1e-12 * xx) | (dy <= 1e-12 * yy)
        return np.where(flat, np.nan, np.clip((xy - x * y / n) / np.sqrt(dx * dy), -1, 1))


#: Degrees of freedom up to which a t distribution's finite series is summed up, and the p below which it lacks digits.
SERIES = 400
SMALL_P = 1e-3


def _p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of correlations over n rows; nan where r is. By Student's finite series for whole degrees of freedom, one
    Horner step for a term; small ones, and those of many degrees, by the beta function."""
    exact = np.isclose(np.abs(r), 1, rtol=0, atol=1e-15)
    p = np.full(r.shape, np.nan)
    for rows in np.flatnonzero(np.bincount(n.astype(np.int64))):
        df, at = int(rows) - 2, np.flatnonzero(n == rows)
        if not 0 < df <= SERIES:
            continue
        sine = np.abs(r[at])
        square = 1 - sine * sine
        total, odd = np.zeros_like(sine), df % 2
        for k in range((df - 1 - odd) // 2, 0, -1):  # terms grow from one to the next by (2 k - 1) / 2 k or 2 k / (2 k + 1)
            total = (1 + total) * square * ((2 * k) / (2 * k + 1) if odd else (2 * k - 1) / (2 * k))
        if odd:
            p[at] = 1 - 2 / np.pi * (np.arcsin(sine) + (sine * np.sqrt(square) * (1 + total) if df > 1 else 0.0))
        else:
            p[at] = 1 - sine * (1 + total)
    rest = np.flatnonzero(~np.isnan(r) & ~exact & ~(p > SMALL_P))
    if len(rest):
        with np.errstate(divide="ignore", invalid="ignore"):
            p[rest] = t_tails(np.sqrt(r[rest] ** 2 * (n[rest] - 2) / (1 - r[rest] ** 2)), n[rest] - 2)
    p[exact] = 0.0
    p[np.isnan(r)] = np.nan
    return p


def _meet(cells: DataFrame, row: str, column: str, value: str, told: Callable[[Iterator[Met]], Iterator[pa.RecordBatch]], schema: Callable[[str], str], method: str = "pearson", other: DataFrame | None = None, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """What `told` makes of every two tiles, several at a time or one by one; `schema` is its schema by a column's type."""
    sides = [cells] if other is None else [cells, other]
    long = [x.select(F.lit(k).alias("__side"), F.col(row).alias("__row"), F.col(column).alias("__column"), F.col(value).cast("double").alias("__v")).dropna() for k, x in enumerate(sides)]
    every = long[0] if other is None else long[0].unionByName(long[1])
    if method == "spearman":
        every = with_rank(every, "__v", ["__side", "__column"], "__rank").withColumn("__v", F.col("__rank").cast("double")).drop("__rank")
    every = stored(every.filter(~F.isnan("__v")), "cells")
    columns = every.groupBy("__side", "__column").agg(F.avg("__v").alias("__mean"))
    columns = numbered(columns, ["__side", "__column"], "__c")
    sizes = {r["__side"]: r["n"] for r in columns.groupBy("__side").agg(F.count("*").alias("n")).collect()}  # one or two rows
    shift = -(-sizes.get(0, 0) // tile) * tile - sizes.get(0, 0)  # the other side begins with a tile of its own
    columns = stored(columns.withColumn("__c", F.col("__c") + F.col("__side") * shift), "columns")
    numbers = stored(numbered(every.select("__row").distinct(), ["__row"], "__r"), "rows")
    height = numbers.count()
    rows = max(1, min(rows, height))
    placed = every.join(columns, ["__side", "__column"]).join(numbers, "__row")
    blocks = stored(_blocks(placed.select("__r", "__c", (F.col("__v") - F.col("__mean")).alias("__v")), tile, rows), "blocks")
    named = columns.groupBy(F.floor(F.col("__c") / tile).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("__c", "__column"))).alias("__names"))
    named = F.broadcast(named.select("tile", F.transform("__names", lambda x: x["__column"]).alias("names")))  # as many names as columns
    edge, tiles = (sizes.get(0, 0) + shift) // tile, -(-(sizes.get(0, 0) + shift + sizes.get(1, 0)) // tile)
    left, right = (F.col("tile") < edge, F.col("tile") >= edge) if other is not None else (F.lit(True), F.lit(True))
    one_side, bytes_of_tile = other is None, max(1, -(-height // rows)) * rows * tile * 8
    schema = schema(columns.schema["__column"].dataType.simpleString())
    if bytes_of_tile <= BAND_BYTES:
        wide = max(1, min(BAND_BYTES // bytes_of_tile, BAND, tiles // 8))
        band = F.floor(F.col("tile") / wide)
        last, begin = ((tiles - 1) // wide, 0) if one_side else ((tiles - 1) // wide, edge // wide)
        own = blocks.join(named, "tile").withColumn("own", band)
        ahead = F.sequence(F.col("own") if one_side else F.lit(begin).cast("long"), F.lit(max(last, begin)).cast("long"))
        as_left = own.filter(left).select(F.col("own").alias("ba"), F.explode(ahead).alias("bb"), F.lit(0).alias("side"), "tile", "block", "cells", "names")
        behind = F.sequence(F.lit(0).cast("long"), F.col("own") - 1 if one_side else F.lit(max(0, edge - 1) // wide).cast("long"))
        as_right = own.filter(right & (F.col("own") > 0) if one_side else right).select(F.explode(behind).alias("ba"), F.col("own").alias("bb"), F.lit(1).alias("side"), "tile", "block", "cells", "names")

        def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, names, same = ({}, {}), {}, False
            for batch in batches:
                for i in range(batch.num_rows):
                    k, at = batch["side"][i].as_py(), batch["tile"][i].as_py()
                    same = one_side and batch["ba"][i] == batch["bb"][i]
                    held[k].setdefault(at, {})[batch["block"][i].as_py()] = np.frombuffer(batch["cells"][i].as_buffer()).reshape(rows, tile)
                    names[at] = batch["names"][i].values

            def pairs() -> Iterator[Met]:
                for ta, x in sorted(held[0].items()):
                    for tb, y in sorted(held[0 if same else 1].items()):
                        both = x.keys() & y.keys()
                        if both and (ta <= tb or not one_side):
                            yield ta, tb, sum(_products(x[k], y[k]) for k in sorted(both)), names[ta], names[tb]

            yield from told(pairs())

        return as_left.unionByName(as_right).groupBy("ba", "bb").applyInArrow(bands, schema)

    first = blocks.filter(left).select("block", F.col("tile").alias("ta"), F.col("cells").alias("x"))
    second = blocks.filter(right).select("block", F.col("tile").alias("tb"), F.col("cells").alias("y"))
    pairs = first.join(second, "block") if other is not None else first.join(second, "block").filter("ta <= tb")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((6, tile, tile)), (0, 0)
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch["ta"][i].as_py(), batch["tb"][i].as_py()
                x, y = (np.frombuffer(batch[c][i].as_buffer()).reshape(rows, tile) for c in "xy")
                total += _products(x, y)
        yield pa.RecordBatch.from_pydict({"ta": [at[0]], "tb": [at[1]], "sums": [total.tobytes()]})

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((6, tile, tile)), None
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch["ta"][i].as_py(), batch["tb"][i].as_py(), batch["names_a"][i].values, batch["names_b"][i].values
                total += np.frombuffer(batch["sums"][i].as_buffer()).reshape(total.shape)
        yield from told(iter([(at[0], at[1], total, at[2], at[3])]))

    # How many rows of cells meet at once in a task: a row holds two blocks.
    slices = pairs.select("ta", "tb", F.pmod("block", F.lit(SLICES)).alias("slice"), "x", "y").groupBy("ta", "tb", "slice")
    sums = slices.applyInArrow(added, _SUMS)
    for c in "ab":
        sums = sums.join(named.select(F.col("tile").alias(f"t{c}"), F.col("names").alias(f"names_{c}")), f"t{c}")
    return sums.groupBy("ta", "tb").applyInArrow(one, schema)


def _values(ta: int, tb: int, sums: np.ndarray, one_side: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of two tiles have rows in common, each once; n, and r, nan where it isn't known."""
    n, keep = sums[0], sums[0] > 0
    if one_side and ta == tb:
        keep &= np.triu(np.ones_like(n, dtype=bool))
    return keep, n, np.where(n < 3, np.nan, _r(sums))


def correlation_table(cells: DataFrame, row: str, column: str, value: str, method: str = "pearson", other: DataFrame | None = None, tile: int = TILE, rows: int = ROWS, tests: bool = True) -> DataFrame:
    """a, b, r, n, p of every two columns, a <= b, or of each column of `cells` with each of `other`, by two-sided t tests.

    Rows in which a column has no value don't count with it. r and p are null where n is below 3 or a column doesn't vary
    over the rows they share. Spearman's ranks are taken within a column, over all its values. Cells with a null in
    row, column or value are missing. Without `tests` there is no p.
    """
    one_side = other is None

    def told(pairs: Iterator[Met]) -> Iterator[pa.RecordBatch]:
        for ta, tb, sums, names_a, names_b in pairs:
            keep, n, r = _values(ta, tb, sums, one_side)
            i, j = np.nonzero(keep)
            n, r = n[i, j], r[i, j]
            out = {"a": names_a.take(pa.array(i)), "b": names_b.take(pa.array(j)), "r": pa.array(r, from_pandas=True), "n": n.astype(np.int64)}
            yield pa.RecordBatch.from_pydict(out | ({"p": pa.array(_p_values(r, n), from_pandas=True)} if tests else {}))

    return _meet(cells, row, column, value, told, lambda kind: f"a {kind}, b {kind}, r double, n long" + ", p double" * tests, method, other, tile, rows)


def _forest(keys: np.ndarray, same: bool) -> np.ndarray:
    """The least keys that connect rows and columns (or, of the same items, a symmetric matrix's rows): Prim's algorithm.
    Keys differ; the largest is none."""
    none, (m, n) = np.iinfo(np.int64).max, keys.shape
    sides = [keys] if same else [keys, np.ascontiguousarray(keys.T)]
    best = [np.full(m, none)] if same else [np.full(m, none), np.full(n, none)]
    open_ = [np.ones(len(b), dtype=bool) for b in best]
    found, first = [], 0
    for _ in range(sum(map(len, best))):
        at = [int(b.argmin()) for b in best]
        side = min(range(len(best)), key=lambda k: best[k][at[k]])
        i = at[side]
        if (key := best[side][i]) != none:
            found.append(key)
        else:  # a further part
            while not (open_[0][first] if first < m else open_[1][first - m]):
                first += 1
            side, i = (0, first) if first < m else (1, first - m)
        open_[side][i], best[side][i] = False, none
        facing = 0 if same else 1 - side
        np.minimum(best[facing], sides[side][i], out=best[facing], where=open_[facing])
    return np.array(found, dtype=np.int64)


def nearest_edges(cells: DataFrame, row: str, column: str, value: str, digits: int = 8, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """a, b, distance (1 - r, rounded) of those pairs of different columns that a single linkage of all of them needs: the
    least spanning forest of every two bands of columns, of equal distances the smaller pair first. An edge that is left
    out is the last of a circle, so no spanning tree of all pairs has it. Where r is null, the distance is -1.

    The pairs that are kept are a number of bands times the columns; all others are gone where they were found.
    """
    unit, none = 10**digits, np.iinfo(np.int64).max

    def told(pairs: Iterator[Met]) -> Iterator[pa.RecordBatch]:
        met, names = {}, {}
        for ta, tb, sums, names_a, names_b in pairs:
            keep, _, r = _values(ta, tb, sums, True)
            far = np.where(np.isnan(r), -unit, np.floor((1 - np.nan_to_num(r)) * unit + 0.5)).astype(np.int64)
            met[ta, tb] = np.where(keep, far + unit, -1)
            names[ta], names[tb] = names_a, names_b
        if not met:
            return
        same = any(a == b for a, b in met)  # a band with itself
        lefts, rights = {a for a, _ in met}, {b for _, b in met}
        lefts, rights = (sorted(lefts | rights),) * 2 if same else (sorted(lefts), sorted(rights))
        size = next(iter(met.values())).shape[0]
        starts = {t: k * size for k, t in enumerate(lefts)}, {t: (k + (0 if same else len(lefts))) * size for k, t in enumerate(rights)}
        low = 0 if same else len(lefts) * size
        bits = ((len(lefts) + len(rights)) * size).bit_length()
        keys = np.full((len(lefts) * size, len(rights) * size), none)
        for (ta, tb), far in met.items():
            a, b = starts[0][ta], starts[1][tb]
            i, j = np.arange(a, a + size), np.arange(b, b + size)
            key = np.where(far < 0, none, (far << 2 * bits) | (i[:, None] << bits) | j[None, :])
            if same and ta == tb:
                np.fill_diagonal(key, none)
                key = np.minimum(key, key.T)
            keys[a : a + size, b - low : b - low + size] = key
            if same:
                keys[b : b + size, a : a + size] = key.T
        met.clear()
        found = _forest(keys, same)
        i, j = (found >> bits) & ((1 << bits) - 1), found & ((1 << bits) - 1)
        every = [*lefts] if same else [*lefts, *rights]
        slots, offsets = pa.concat_arrays([names[t] for t in every]), np.cumsum([0, *(len(names[t]) for t in every)])
        a, b = (slots.take(pa.array(offsets[x // size] + x % size)) for x in (i, j))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "distance": ((found >> 2 * bits) - unit) / unit})

    return _meet(cells, row, column, value, told, lambda kind: f"a {kind}, b {kind}, distance double", tile=tile, rows=rows)


#: The gap between two trees of a forest.
NO_NODE = 1 << 62


def weights_below(cells: DataFrame, row: str, place: str, value: str, sigma: float = 1.0, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """node, inside, every: sums over all pairs of columns of exp((|r| - 1) / sigma^2), r 0 where it isn't known. `inside` stands
    at the lowest node above both (null: none), `every` at both leaves.

    Column `place` is a struct of place (in a dendrogram's order), leaf, and gap: the node that parts this place from the next
    one, as 2^32 leaves + node, or NO_NODE. The node above two places is the largest gap between them.
    """
    spark = cells.sparkSession
    gaps = stored(cells.filter(F.col(value).isNotNull()).select(f"{place}.place", f"{place}.gap").distinct(), "gaps")
    numbers = numbered(gaps, ["place"], "k")
    tops = {r["t"]: r["gap"] for r in numbers.groupBy(F.floor(F.col("k") / tile).alias("t")).agg(F.max("gap").alias("gap")).collect()}  # one for each tile
    tops = spark.sparkContext.broadcast(np.array([tops[t] for t in sorted(tops)], dtype=np.int64))

    def told(pairs: Iterator[Met]) -> Iterator[pa.RecordBatch]:
        inside, every = {}, {}

        def add(to: dict, keys: np.ndarray, sums: np.ndarray) -> None:
            for k, v in zip(keys.tolist(), sums.tolist()):
                to[k] = to.get(k, 0.0) + v

        for ta, tb, sums, names_a, names_b in pairs:
            keep, n, r = _values(ta, tb, sums, True)
            w = np.where(sums[0] > 0, np.exp((np.abs(np.nan_to_num(r)) - 1) / sigma**2), 0.0)[: len(names_a), : len(names_b)]
            leaf_a, leaf_b, gap_a, gap_b = (np.asarray(x.field(c), dtype=np.int64) for c in ("leaf", "gap") for x in (names_a, names_b))
            add(every, leaf_a, w.sum(1))
            if ta == tb:
                add(inside, -1 - leaf_a, np.diag(w))
                for i in range(len(gap_a) - 1):
                    top, at = np.unique(np.maximum.accumulate(gap_a[i:-1]), return_inverse=True)
                    add(inside, top, np.bincount(at, weights=w[i, i + 1 :]))
                continue
            add(every, leaf_b, w.sum(0))
            between = int(tops.value[ta + 1 : tb].max(initial=0))
            up = np.maximum.accumulate(gap_a[::-1])[::-1]
            down = np.maximum(np.concatenate([[0], np.maximum.accumulate(gap_b)[:-1]]), between)
            top, at = np.unique(np.concatenate([up, down]), return_inverse=True)
            rank = np.maximum.outer(at[: len(up)], at[len(up) :])
            add(inside, top, np.bincount(rank.ravel(), weights=w.ravel(), minlength=len(top)))
        node = [None if k == NO_NODE else -1 - k if k < 0 else k & 0xFFFFFFFF for k in inside]
        yield pa.RecordBatch.from_pydict({"node": pa.array([*node, *every], pa.int64()), "inside": pa.array([*inside.values(), *[0.0] * len(every)], pa.float64()), "every": pa.array([*[0.0] * len(node), *every.values()], pa.float64())})

    return _meet(cells, row, place, value, told, lambda _: "node long, inside double, every double", tile=tile, rows=rows)


def distance_table(correlations: DataFrame) -> DataFrame:
    """a, b, distance of every two different columns of a correlation table: 1 - r; null where r is."""
    return correlations.filter("a != b").select("a", "b", (1 - F.col("r")).alias("distance"))
