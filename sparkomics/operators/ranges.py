"""Interval operators: merging, overlap and containment joins, nearest neighbours, clusters of runs.

Range joins are equi-joins on bins. `width` is a bin's size; an interval is in every bin that it touches, so it should be
of the order of a typical interval. A pair is found in the first bin that both touch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_regions(df: DataFrame, seqid: str, start: str, end: str, strict: bool = False) -> DataFrame:
    """seqid, start, end of merged regions: one joins the region before if it starts at or before that one's end.

    A region ends where its last interval does; with `strict`, where the furthest does.
    """
    w = Window.partitionBy(seqid).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if strict else F.lag(end).over(w)
    islands = df.withColumn("__new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(end) if strict else F.max_by(end, F.struct(start, end))
    return islands.groupBy(seqid, "__island").agg(F.min(start).alias(start), last.alias(end)).drop("__island")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def interval_overlap(features: DataFrame, regions: DataFrame, width: int, seqid: str = "seqid", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of a feature and a region of one sequence with feature.start <= region.end and feature.end > region.start.

    The region's columns have the prefix `region_`. Equal regions give equal hits, as often as they are asked for.
    """
    asked = regions.select(*[F.col(c).alias(f"region_{c}") for c in regions.columns])
    f = features.withColumn("__bin", _bins(F.col(start), F.col(end), width))
    r = asked.withColumn("__bin", _bins(F.col(f"region_{start}"), F.col(f"region_{end}"), width)).withColumn("__seq", F.col(f"region_{seqid}"))
    first = F.floor(F.greatest(F.col(start), F.col(f"region_{start}")) / width)
    hit = (F.col(start) <= F.col(f"region_{end}")) & (F.col(end) > F.col(f"region_{start}")) & (f["__bin"] == first)
    return f.join(r, (f[seqid] == r["__seq"]) & (f["__bin"] == r["__bin"]) & hit).drop("__bin", "__seq")


def points_in_regions(points: DataFrame, regions: DataFrame, width: int, seqid: str = "seqid", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of a point and a region with start < pos <= end; the region's columns have the prefix `region_`."""
    asked = regions.select(*[F.col(c).alias(f"region_{c}") for c in regions.columns])
    p = points.withColumn("__bin", F.floor(F.col(pos) / width))
    r = asked.withColumn("__bin", _bins(F.col(f"region_{start}"), F.col(f"region_{end}"), width)).withColumn("__seq", F.col(f"region_{seqid}"))
    hit = (F.col(pos) > F.col(f"region_{start}")) & (F.col(pos) <= F.col(f"region_{end}"))
    return p.join(r, (p[seqid] == r["__seq"]) & (p["__bin"] == r["__bin"]) & hit).drop("__bin", "__seq")


def neighbours(markers: DataFrame, queries: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The queries with `before`, the last marker position at or before theirs, and `after`, the first one behind it."""
    m = markers.select(*by, F.col(pos).alias("__pos"), F.lit(0).alias("__kind")).distinct()
    names = [c for c in queries.columns if c not in by]
    q = queries.select(*by, F.col(pos).alias("__pos"), F.lit(1).alias("__kind"), F.struct(*names).alias("__row"))
    both = m.withColumn("__row", F.lit(None).cast(q.schema["__row"].dataType)).unionByName(q)
    w = Window.partitionBy(*by).orderBy("__pos", "__kind")
    own = F.when(F.col("__kind") == 0, F.col("__pos"))
    told = both.withColumn("before", F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return told.filter("__kind = 1").select(*by, "__row.*", "before", "after")


def ld_clusters(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float, drop: float) -> DataFrame:
    """The rows in clusters, with `cluster` from 1 within `by`: runs of rows at threshold - drop or more, with a row more
    on either side, whose largest value reaches the threshold. A row between two runs belongs to the later one."""
    w = Window.partitionBy(*by).orderBy(*order)
    high = F.col(value) >= threshold - drop
    runs = df.withColumn("__high", high).withColumn("__new", F.when(high & ~F.coalesce(F.lag(high).over(w), F.lit(False)), 1).otherwise(0))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("__high"), F.col("__run"))
    runs = runs.withColumn("__own", F.coalesce(own, F.lead(own).over(w), F.lag(own).over(w)))
    peak = F.max(F.when(F.col("__high"), F.col(value))).over(Window.partitionBy(*by, "__own"))
    kept = runs.withColumn("__peak", peak).filter(F.col("__own").isNotNull() & (F.col("__peak") >= threshold))
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("__own"))
    return kept.withColumn("cluster", number).select(*df.columns, "cluster")


def peaks(clusters: DataFrame, by: list[str], pos: str) -> DataFrame:
    """The first and last position of each cluster."""
    return clusters.groupBy(*by, "cluster").agg(F.min(pos).alias("start"), F.max(pos).alias("end"))


def interpolate(curve: DataFrame, queries: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The queries (by, x) with y on the curve: linear between its points, clamped at its ends."""
    points = curve.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(0).alias("__kind"))
    names = [c for c in queries.columns if c not in by]
    q = queries.select(*by, F.col(x).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__kind"), F.struct(*names).alias("__row"))
    both = points.withColumn("__row", F.lit(None).cast(q.schema["__row"].dataType)).unionByName(q)
    w = Window.partitionBy(*by).orderBy("__x", "__kind")
    point = F.when(F.col("__kind") == 0, F.struct("__x", "__y"))
    a, b = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(point, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    told = both.withColumn("__a", a).withColumn("__b", b).filter("__kind = 1")
    slope = (F.col("__b.__y") - F.col("__a.__y")) / (F.col("__b.__x") - F.col("__a.__x"))
    value = F.coalesce(F.col("__a.__y") + slope * (F.col("__x") - F.col("__a.__x")), "__a.__y", "__b.__y")
    return told.withColumn(y, value).select(*by, "__row.*", y)
