"""LOWESS over tables of any size: sorted blocks, exact neighbourhoods, and moments of what lies farther away.

The nearest r of a point are a window of the sorted line; where it begins is an as-of search in the sums of x at both ends
of all such windows. A block of about the square root of a curve's rows is fitted by one task. It gets the rows of those blocks
that some of its windows cover in part, and of blocks that all its windows cover only the moments: tricube weights are
polynomials of the distance on either side of a point, so sums of weights times x and y are sums of moments. Medians of the
residuals come from ranks. So no task holds a curve, and the fit equals the plain one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.operators.ordered import along, places
from sparkomics.operators.storage import dropped, stored

#: Rows of a block at least.
LEAST_BLOCK = 256
#: Moments: the tricube's degree, and two more for sums of squares.
DEGREE = 12

_BINOMIAL = np.array([[math.comb(p, q) for q in range(DEGREE)] for p in range(DEGREE)], dtype=float)


def moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, centre: float, scale: float) -> np.ndarray:
    """Sums of weight * z^p and of weight * y * z^p, z = (x - centre) / scale, for p below DEGREE."""
    powers = ((x - centre) / scale)[None, :] ** np.arange(DEGREE)[:, None]
    return np.stack([powers @ weight, powers @ (weight * y)])


def moved(m: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moments (..., 2, DEGREE) of z as those of factor * z + shift."""
    p = np.arange(DEGREE)
    lower = np.maximum(p[:, None] - p[None, :], 0)
    turn = np.where(p[:, None] >= p[None, :], _BINOMIAL * shift[..., None, None] ** lower * factor[..., None, None] ** p[None, :], 0.0)
    return np.einsum("...pq,...eq->...ep", turn, m)


def _tricube_sums(m: np.ndarray, reach: np.ndarray, side: float) -> np.ndarray:
    """Sums over tricube weights of 1, d, d^2, y, d y from moments of d = x - x_i, all on one side of x_i: by rows."""
    parts = ((0, 1.0), (3, -3.0 * side), (6, 3.0), (9, -side))
    total = lambda e, q: sum(c * m[:, e, p + q] / reach**p for p, c in parts)
    return np.stack([total(0, 0), total(0, 1), total(0, 2), total(1, 0), total(1, 1)], axis=1)


def _near_sums(at: np.ndarray, reach: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same sums from rows, in pieces of bounded size. Where the reach is 0 only equal x count."""
    out = np.zeros((len(at), 5))
    for lo in range(0, len(at), 512):
        i = slice(lo, lo + 512)
        d = x[None, :] - at[i, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(reach[i, None] > 0, np.abs(d) / reach[i, None], d != 0)
        w = (1 - np.clip(u, 0, 1) ** 3) ** 3 * weight[None, :]
        out[i] = np.stack([w.sum(1), (w * d).sum(1), (w * d * d).sum(1), w @ y, (w * d) @ y], axis=1)
    return out


def _far_sums(at: np.ndarray, reach: np.ndarray, m: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The same sums from moments of blocks that all points reach as a whole. Moments are gathered about the middle of the
    points first; where a point's reach is less than its way to the middle, which would cost digits, block by block."""
    out, middle, unit = np.zeros((len(at), 5)), (at.min() + at.max()) / 2, float(reach.mean())
    sides = np.where(centre < middle, -1.0, 1.0)
    close = np.abs(at - middle) <= reach
    for side in np.unique(sides):
        own = sides == side
        if close.any():
            total = moved(m[own], scale[own] / unit, (centre[own] - middle) / unit).sum(0)
            about = moved(np.broadcast_to(total, (int(close.sum()), 2, DEGREE)), np.ones(int(close.sum())), (middle - at[close]) / unit)
            out[close] += _tricube_sums(about, reach[close] / unit, side) * np.array([1, unit, unit * unit, 1, unit])
        for i in np.flatnonzero(~close):
            about = moved(m[own], scale[own] / reach[i], (centre[own] - at[i]) / reach[i]).sum(0)
            out[i] += _tricube_sums(about[None], np.ones(1), side)[0] * np.array([1, reach[i], reach[i] ** 2, 1, reach[i]])
    return out


def _fitted(sums: np.ndarray, y: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The line at d = 0; the weighted mean where x doesn't vary, the value itself where nothing has weight."""
    s, sx, sxx, sy, sxy = sums.T
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, centre = sy / s, sx / s
        spread = sxx - sx * centre
        flat = spread <= 1e-12 * np.maximum(s * reach * reach, 1e-300)
        return np.where(s <= 0, y, np.where(flat, mean, mean - (sxy - sx * mean) / spread * centre))


def neighbourhoods(rows: DataFrame, by: list[str], f: float) -> DataFrame:
    """The rows (by, __x, __id) with __i (place within by), __n and __reach: the distance to the nearest but ceil(f n),
    itself the first, or to the farthest."""
    told = places(rows, by, ["__x", "__id"]).withColumnsRenamed({"place": "__i", "place_from_end": "__e"})
    told = told.withColumn("__n", F.col("__i") + F.col("__e") + 1).drop("__e")
    r = F.least(F.ceil(F.lit(f) * F.col("__n")), F.col("__n") - 1)
    told = stored(told.withColumn("__r", r), "sorted-rows")
    begins = told.select(*by, "__n", (F.col("__i") + F.col("__r")).alias("__i"), F.col("__i").alias("__l"), F.col("__x").alias("__low")).filter("__i < __n").drop("__n")
    windows = begins.join(told.select(*by, "__i", F.col("__x").alias("__high")), [*by, "__i"])
    none = F.lit(None)
    ends = windows.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("__at"), F.lit(0).alias("__kind"), F.col("__l").alias("__i"), F.struct("__l", "__low", "__high").alias("__w"), none.cast("double").alias("__x"))
    asks = told.select(*by, F.col("__x").alias("__at"), F.lit(1).alias("__kind"), "__i", none.cast(ends.schema["__w"].dataType).alias("__w"), "__x")
    # By the middle of a window: the last one before a point, and the first from it on, one of which is the nearest.
    family = F.struct(*by) if by else F.lit(0)
    window = F.when(F.col("__w").isNotNull(), F.struct(family.alias("g"), F.col("__w").alias("w")))
    found = along(ends.unionByName(asks), [*by, "__at", "__kind", "__i"], last={"__before": window}, first={"__after": window}).filter("__kind = 1")
    own = lambda c: F.when(F.col(c)["g"].eqNullSafe(family), F.col(c)["w"])
    width = lambda w: F.greatest(F.col("__x") - w["__low"], w["__high"] - F.col("__x"))
    both = found.select(*by, "__i", "__x", own("__before").alias("__b"), own("__after").alias("__a"))
    best = F.when(F.col("__a").isNull() | (width(F.col("__b")) <= width(F.col("__a"))), F.col("__b")).otherwise(F.col("__a"))
    nearest = both.withColumn("__w", best).select(*by, "__i", width(F.col("__w")).alias("__reach"))
    return told.join(nearest, [*by, "__i"])


def _needed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __for, __block, __whole: the other blocks that hold something within the reach of a block's points, and whether
    all of it is within the reach of all of them. Blocks are few; they are searched by their least and largest x."""
    blocks = rows.groupBy(*keys, "__block").agg(
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
        F.min(F.col("__x") - F.col("__reach")).alias("__low"),
        F.max(F.col("__x") + F.col("__reach")).alias("__high"),
        F.max(F.col("__x") - F.col("__reach")).alias("__left"),
        F.min(F.col("__x") + F.col("__reach")).alias("__right"),
        (F.min("__reach") > 0).alias("__wide"),
    )
    blocks = stored(blocks, "blocks")
    family = F.struct(*keys) if keys else F.lit(0)
    told = F.when(F.col("__has"), F.struct(family.alias("g"), "__block"))
    at = lambda c, kind, has: blocks.select(*keys, "__block", F.col(c).alias("__at"), F.lit(kind).alias("__kind"), F.lit(has).alias("__has"))
    order = [*keys, "__at", "__kind", "__block"]
    firsts = along(at("__low", 0, False).unionByName(at("__max", 1, True)), order, first={"__found": told}).filter("NOT __has").select(*keys, "__block", F.col("__found")["__block"].alias("__first"))
    finals = along(at("__min", 0, True).unionByName(at("__high", 1, False)), order, last={"__found": told}).filter("NOT __has").select(*keys, "__block", F.col("__found")["__block"].alias("__final"))
    own = blocks.join(firsts, [*keys, "__block"]).join(finals, [*keys, "__block"])
    needs = own.select(*keys, F.col("__block").alias("__for"), "__left", "__right", "__wide", F.explode(F.sequence("__first", "__final")).alias("__block")).filter("__for != __block")
    whole = F.col("__wide") & (F.col("__left") <= F.col("__min")) & (F.col("__max") <= F.col("__right"))
    return needs.join(blocks.select(*keys, "__block", "__min", "__max"), [*keys, "__block"]).select(*keys, "__for", "__block", whole.alias("__whole"))


def lowess(df: DataFrame, by: list[str], x: str, y: str, f: float = 2 / 3, iterations: int = 3, least_block: int = LEAST_BLOCK) -> DataFrame:
    """The rows with `fitted`, a curve for each group of `by`, or one of all rows where `by` is empty.

    Local lines with tricube weights over the nearest part f of a curve, fitted `iterations` times with bisquare weights of
    the residuals, 6 medians wide. Rows without x or y are no part of a curve; their `fitted` is null. Equal rows are fitted
    alike. Blocks have the square root of their curve's rows, `least_block` at least.
    """
    known = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__x", F.col(x).cast("double")).withColumn("__y", F.col(y).cast("double"))
    known = stored(known, "smoothed-rows")
    usable = known.filter("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")
    keys = [f"__g{i}" for i in range(len(by))]
    rows = usable.select("__id", "__x", "__y", *[F.col(c).alias(k) for c, k in zip(by, keys)])
    # Null groups are groups: they are told apart by a string that no value has.
    rows = rows.select("__id", "__x", "__y", *[F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")).alias(k) for k in keys])
    size = F.greatest(F.ceil(F.sqrt(F.col("__n").cast("double"))), F.lit(least_block))
    rows = neighbourhoods(rows, keys, f).withColumn("__size", size)
    rows = rows.withColumn("__block", F.floor(F.col("__i") / F.col("__size")))
    now = stored(rows.withColumn("__weight", F.lit(1.0)), "weighted-rows")
    needs = stored(_needed(now, keys), "needed-blocks")

    def summed(group: pa.Table) -> pa.Table:
        at = np.asarray(group["__x"])
        centre, scale = (at.min() + at.max()) / 2, max((at.max() - at.min()) / 2, 1e-300)
        m = moments(at, np.asarray(group["__y"]), np.asarray(group["__weight"]), centre, scale)
        out = {k: [group[k][0].as_py()] for k in [*keys, "__block"]}
        return pa.table(out | {"__centre": [centre], "__scale": [scale], "__m": [m.ravel().tolist()]})

    def fit(group: pa.Table) -> pa.Table:
        kind = np.asarray(group["__kind"])
        column = lambda c, k: np.asarray(group.column(c).filter(pa.array(kind == k)))
        at, value, reach = column("__x", 0), column("__y", 0), column("__reach", 0)
        sums = _near_sums(at, reach, *(np.concatenate([column(c, 0), column(c, 1)]) for c in ("__x", "__y", "__weight")))
        if (kind == 2).any():
            m = np.array(group.column("__m").filter(pa.array(kind == 2)).to_pylist()).reshape(-1, 2, DEGREE)
            sums += _far_sums(at, reach, m, column("__x", 2), column("__reach", 2))
        return pa.table({"__id": group.column("__id").filter(pa.array(kind == 0)), "__fit": _fitted(sums, value, reach)})

    block_schema = "".join(f"{k} string, " for k in keys) + "__block long, __centre double, __scale double, __m array<double>"
    fits = None
    for round_ in range(iterations):
        blocks = stored(now.select(*keys, "__block", "__x", "__y", "__weight").groupBy(*keys, "__block").applyInArrow(summed, block_schema), "block-moments")
        none = F.lit(None)
        cast = lambda kind, i, xx, yy, reach, weight, m: (F.lit(kind).alias("__kind"), i.cast("long").alias("__id"), xx.alias("__x"), yy.cast("double").alias("__y"), reach.cast("double").alias("__reach"), weight.cast("double").alias("__weight"), m.cast("array<double>").alias("__m"))
        own = now.select(*keys, F.col("__block").alias("__for"), *cast(0, F.col("__id"), F.col("__x"), F.col("__y"), F.col("__reach"), F.col("__weight"), none))
        edge = needs.filter("NOT __whole").join(now, [*keys, "__block"]).select(*keys, "__for", *cast(1, none, F.col("__x"), F.col("__y"), none, F.col("__weight"), none))
        whole = needs.filter("__whole").join(blocks, [*keys, "__block"]).select(*keys, "__for", *cast(2, none, F.col("__centre"), none, F.col("__scale"), none, F.col("__m")))
        fits = stored(own.unionByName(edge).unionByName(whole).groupBy(*keys, "__for").applyInArrow(fit, "__id long, __fit double"), "fits")
        if round_ == iterations - 1:
            break
        off = stored(now.join(fits, "__id").withColumn("__off", F.col("__y") - F.col("__fit")), "residuals")
        ranked = places(off.select(*keys, "__id", F.abs("__off").alias("__size_off")), keys, ["__size_off", "__id"])
        median = ranked.filter(F.abs(F.col("place") - F.col("place_from_end")) <= 1).groupBy(*keys).agg((6 * F.avg("__size_off")).alias("__wide"))
        joined = off.join(median, keys) if keys else off.join(F.broadcast(median))  # one row
        part = F.least(F.abs("__off") / F.col("__wide"), F.lit(1.0))
        again = joined.withColumn("__weight", F.when(F.col("__wide") > 0, F.pow(1 - part * part, F.lit(2.0))).otherwise(1.0))
        further = stored(again.select(*now.columns), "weighted-rows")
        dropped(now, off)
        now = further
    return known.join(fits.withColumnRenamed("__fit", "fitted"), "__id", "left").select(*df.columns, "fitted")
