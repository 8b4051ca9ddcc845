"""Pedigrees as tables (fam_id, id, father_id, mother_id, gender, features: a map) with their feature lists (idx, ftype,
feature, masked): every edit gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkomics.functions import columns as C

FIXED = ("fam_id", "id", "father_id", "mother_id", "gender")


def subset(ped: DataFrame, families: list[str]) -> DataFrame:
    return ped.filter(F.col("fam_id").isin(families))


def feature(ped: DataFrame, name: str) -> DataFrame:
    """fam_id, id, value."""
    return ped.select("fam_id", "id", F.try_element_at("features", F.lit(name)).alias("value"))


def set_feature(ped: DataFrame, name: str, value: Column, where: Column | None = None) -> DataFrame:
    """The pedigree with the feature set, for all or for some."""
    kept = F.map_filter(F.coalesce("features", F.expr("CAST(map() AS map<string,string>)")), lambda k, _: k != name)
    put = F.map_concat(kept, F.create_map(F.lit(name), value.cast("string")))
    return ped.withColumn("features", put if where is None else F.when(where, put).otherwise(F.col("features")))


def add_feature(ped: DataFrame, dat: DataFrame, kind: str, name: str, default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pedigree, feature list) with a further feature; without a default its values are unknown."""
    value = F.lit(default) if default is not None else C.empty_value(F.lit(kind))
    last = dat.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).cast("int").alias("idx"))
    return set_feature(ped, name, value), dat.unionByName(last.select("idx", F.lit(kind).alias("ftype"), F.lit(name).alias("feature"), F.lit(False).alias("masked")))


def mask(dat: DataFrame, name: str, masked: bool = True) -> DataFrame:
    return dat.withColumn("masked", F.when(F.col("feature") == name, F.lit(masked)).otherwise(F.col("masked")))


def set_type(dat: DataFrame, name: str, kind: str) -> DataFrame:
    return dat.withColumn("ftype", F.when(F.col("feature") == name, F.lit(kind)).otherwise(F.col("ftype")))


def _refer(c: str, family: str, old: str, new: Column) -> Column:
    return F.when((F.col("fam_id") == family) & (F.col(c) == old), new).otherwise(F.col(c)).alias(c)


def rename_member(ped: DataFrame, family: str, old: str, new: str) -> DataFrame:
    """The member under a new name, in the references of its family too."""
    renamed = [_refer(c, family, old, F.lit(new)) if c in ("id", "father_id", "mother_id") else F.col(c) for c in ped.columns]
    return ped.select(*renamed)


def delete_member(ped: DataFrame, family: str, member: str) -> DataFrame:
    """The pedigree without the member; references to it are null."""
    rest = ped.filter(~((F.col("fam_id") == family) & (F.col("id") == member)))
    return rest.select(*[_refer(c, family, member, F.lit(None)) if c in ("father_id", "mother_id") else F.col(c) for c in ped.columns])


def add_members(ped: DataFrame, members: DataFrame) -> DataFrame:
    """The pedigree with the members (columns as its own); they replace those of their family and name."""
    return ped.join(members.select("fam_id", "id"), ["fam_id", "id"], "left_anti").select(*ped.columns).unionByName(members)


def founders_per_family(ped: DataFrame) -> DataFrame:
    return ped.groupBy("fam_id").agg(F.count_if(F.col("father_id").isNull() & F.col("mother_id").isNull()).alias("founders"))


def to_rows(ped: DataFrame, features: list[tuple[str, str]]) -> DataFrame:
    """value: the lines of a pedigree file; missing parents are 0, missing values what stands for unknown ones."""
    parent = lambda c: F.coalesce(F.col(c), F.lit("0"))
    values = [F.coalesce(F.try_element_at("features", F.lit(n)), C.empty_value(F.lit(k))) for k, n in features]
    return ped.select(F.concat_ws("\t", "fam_id", "id", parent("father_id"), parent("mother_id"), "gender", *values).alias("value"))


def write_ped(ped: DataFrame, features: list[tuple[str, str]], path: str) -> None:
    to_rows(ped, features).write.text(path)


def write_dat(dat: DataFrame, path: str) -> None:
    """Write a feature list, one file, in its order; masked features are skipped by readers, type S."""
    kind = F.when(F.col("masked"), "S").otherwise(F.upper("ftype"))
    dat.coalesce(1).sortWithinPartitions("idx").select(F.concat_ws("\t", kind, "feature").alias("value")).write.text(path)


def passing_families(members: DataFrame, threshold: float = 0.9, least: int = 2) -> DataFrame:
    """fam_id of families with one of generation 0 and `least` of generation 1 at the percentile or over it. `members` has
    fam_id, generation, percentile."""
    over = lambda g: F.count_if((F.col("generation") == g) & (F.col("percentile") >= threshold))
    return members.groupBy("fam_id").agg(over(0).alias("__a"), over(1).alias("__b")).filter((F.col("__a") > 0) & (F.col("__b") >= least)).select("fam_id")


def passing_members(members: DataFrame, threshold: float = 0.9, least: int = 2) -> DataFrame:
    """The members at the threshold of families that pass."""
    return members.filter(F.col("percentile") >= threshold).join(passing_families(members, threshold, least), "fam_id", "left_semi")
