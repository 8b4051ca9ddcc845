"""Linkage results: markers in order, LOD scores of families in peaks, identity by descent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.functions.columns import ibd_state
from sparkomics.operators import ranges


def marker_order(markers: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """The markers with `place`, from 0 within their chromosome."""
    return markers.withColumn("place", F.row_number().over(Window.partitionBy(chrom).orderBy(pos)) - 1)


def placed(lod: DataFrame, markers: DataFrame, marker: str) -> DataFrame:
    """The LOD rows with their marker's chrom and pos; rows with a null anywhere go."""
    return lod.dropna().join(markers.select(marker, "chrom", "pos"), marker)


def families_per_peak(peaks: DataFrame, lod: DataFrame, threshold: float = 0.3, width: int = 1 << 16) -> DataFrame:
    """cluster, families (sorted) whose LOD score is over the threshold somewhere strictly within the peak. `peaks` has
    cluster, chrom, start, end; `lod` has family, chrom, pos, lod."""
    strong = lod.filter(F.col("lod") > threshold).select("family", F.col("chrom").alias("seqid"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    inner = peaks.select(F.col("chrom").alias("seqid"), (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end")).filter("start <= end").distinct()
    met = ranges.interval_overlap(strong, inner, width).select("family", F.col("seqid").alias("chrom"), (F.col("region_start") - 1).alias("start"), (F.col("region_end") + 1).alias("end")).distinct()
    return peaks.join(met, ["chrom", "start", "end"], "left").groupBy("cluster").agg(F.sort_array(F.collect_set("family")).alias("families"))


def contributing_families(lod: DataFrame, chrom: str, start: int, end: int, threshold: float = 0.3, every: bool = False) -> DataFrame:
    """family: those at the threshold at any, or every, marker from the last one at `start` or before to the first one at
    `end` or behind."""
    here = lod.filter(F.col("chrom") == chrom)
    span = here.agg(F.max(F.when(F.col("pos") <= start, F.col("pos"))).alias("__from"), F.min(F.when(F.col("pos") >= end, F.col("pos"))).alias("__to"))
    within = here.join(F.broadcast(span), F.col("pos").between(F.col("__from"), F.col("__to")))  # one row
    test = F.min("lod") if every else F.max("lod")
    return within.groupBy("family").agg(test.alias("__lod")).filter(F.col("__lod") >= threshold).select("family")


def ibd_states(pairs: DataFrame) -> DataFrame:
    """family, person1, person2, marker, state of the most probable number of shared alleles (columns p0, p1, p2)."""
    return pairs.select("family", "person1", "person2", "marker", ibd_state(F.col("p0"), F.col("p1"), F.col("p2")).alias("state"))


def ibd_with_siblings(states: DataFrame, siblings: DataFrame, markers: list[str]) -> DataFrame:
    """family, person, sibling and a state for each marker, 0 where there is none. `siblings` has family, person, sibling."""
    both = states.select("family", F.col("person1").alias("person"), F.col("person2").alias("sibling"), "marker", "state")
    both = both.unionByName(states.select("family", F.col("person2").alias("person"), F.col("person1").alias("sibling"), "marker", "state")).filter(F.col("marker").isin(markers))
    wide = both.groupBy("family", "person", "sibling").agg(*[F.max(F.when(F.col("marker") == m, F.col("state"))).alias(m) for m in markers])
    return siblings.join(wide, ["family", "person", "sibling"], "left").fillna(0, markers)


def flanking(markers: DataFrame, chrom: str, pos: int) -> DataFrame:
    """before, after: the nearest markers at or before a place and at or behind it."""
    here = markers.filter(F.col("chrom") == chrom)
    low, high = F.when(F.col("pos") <= pos, F.col("pos")), F.when(F.col("pos") >= pos, F.col("pos"))
    return here.agg(F.max_by("marker", low).alias("before"), F.min_by("marker", high).alias("after"))
