"""Operators on variant tables (chrom, pos, ref, alt, filter, info, genotypes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkomics.functions import columns as C


def has_sv(df: DataFrame):
    return F.map_contains_key("info", "SVTYPE")


def filter_variants(df: DataFrame, filters: list[str] | None = None, types: list[str] | None = None, n_alleles: int | None = None, samples: list[str] | None = None) -> DataFrame:
    """The variants that passed or have none of `filters`, of the types, with at most so many alternatives; of the
    samples only."""
    if samples is not None:
        df = df.withColumn("genotypes", F.filter("genotypes", lambda g: g["sample"].isin(samples)))
    if filters:
        df = df.filter(F.col("filter").isNull() | ~F.arrays_overlap("filter", F.array(*map(F.lit, filters))))
    if types:
        df = df.filter(C.var_type(F.col("ref"), F.col("alt"), has_sv(df)).isin(types))
    return df.filter(F.size("alt") <= n_alleles) if n_alleles is not None else df


def in_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Variants at start <= pos <= end."""
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def calls(df: DataFrame) -> DataFrame:
    """variant, alt, k (the alternative's number, from 1), sample, gt (allele numbers): a row for each call and
    alternative."""
    each = df.select("chrom", "pos", "ref", "genotypes", F.posexplode("alt").alias("i", "a"))
    named = each.select(C.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("a")).alias("variant"), "a", (F.col("i") + 1).alias("k"), F.explode("genotypes").alias("g"))
    return named.select("variant", F.col("a").alias("alt"), "k", "g.sample", C.genotype(F.try_element_at("g.fields", F.lit("GT"))).alias("gt"))


def summary(df: DataFrame) -> DataFrame:
    """variant, RR, RA, AA, R, A: calls with 0, 1 and 2 alleles that are the alternative, and the same of one allele.
    Alleles that are missing or another alternative count as the reference."""
    c = calls(df).withColumn("n", F.size(F.filter("gt", lambda x: x == F.col("k")))).withColumn("ploidy", F.size("gt"))
    count = lambda p, n: F.count_if((F.col("ploidy") == p) & (F.col("n") == n))
    return c.groupBy("variant").agg(count(2, 0).alias("RR"), count(2, 1).alias("RA"), count(2, 2).alias("AA"), count(1, 0).alias("R"), count(1, 1).alias("A"))


def genotype_matrix(df: DataFrame) -> DataFrame:
    """variant, sample, dosage: how many of a call's alleles are the alternative."""
    return calls(df).select("variant", "sample", F.size(F.filter("gt", lambda x: x == F.col("k"))).alias("dosage"))


def who_has(df: DataFrame) -> DataFrame:
    """variant, sample of all carriers."""
    return genotype_matrix(df).filter("dosage > 0").select("variant", "sample")


def find_variants(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The variants that match `wanted` (chrom, pos, ref, alt) as they are or with the alleles swapped; any case."""
    w = wanted.select(F.col("chrom").alias("w_chrom"), F.col("pos").alias("w_pos"), F.upper("ref").alias("w_ref"), F.upper("alt").alias("w_alt"))
    up = F.transform("alt", lambda a: F.upper(a))
    same = (F.upper("ref") == F.col("w_ref")) & F.array_contains(up, F.col("w_alt"))
    swapped = (F.upper("ref") == F.col("w_alt")) & F.array_contains(up, F.col("w_ref"))
    met = df.join(w, (F.col("chrom") == F.col("w_chrom")) & (F.col("pos") == F.col("w_pos")))
    return met.filter(same | swapped).withColumn("swapped", ~same)


def _gt(g):
    return F.try_element_at(g["fields"], F.lit("GT"))


def set_format(df: DataFrame, field: str, value) -> DataFrame:
    """The variants with a field of every call set to `value`, a function of the call (sample, fields)."""

    def put(g):
        rest = F.map_filter(g["fields"], lambda k, _: k != field)
        return F.struct(g["sample"].alias("sample"), F.map_concat(rest, F.create_map(F.lit(field), value(g))).alias("fields"))

    return df.withColumn("genotypes", F.transform("genotypes", put))


def filter_calls(df: DataFrame, field: str, test) -> DataFrame:
    """The variants with calls that fail `test`, a function of the field's value, set to missing alleles; those go that no
    call has an alternative of any more."""
    missing = lambda g: F.array_join(F.array_repeat(F.lit("."), C.ploidy(_gt(g))), "/")
    told = set_format(df, "GT", lambda g: F.when(F.coalesce(test(F.try_element_at(g["fields"], F.lit(field))), F.lit(False)), _gt(g)).otherwise(missing(g)))
    return told.filter(F.exists("genotypes", lambda g: F.exists(C.genotype(_gt(g)), lambda a: a > 0)))


def drop_filtered(df: DataFrame, filters: list[str], call_filters: list[str] | None = None) -> DataFrame:
    """The variants that have none of `filters`, without the calls that have one of `call_filters` (the same by default);
    those go that are left without an alternative allele, unless they have no calls at all."""
    wanted = F.array(*map(F.lit, call_filters if call_filters is not None else filters))
    ok = filter_variants(df, filters)
    failed = lambda g: F.coalesce(F.arrays_overlap(F.split(F.try_element_at(g["fields"], F.lit("FT")), ";"), wanted), F.lit(False))
    some = F.size("genotypes") > 0
    kept = ok.withColumn("__some", some).withColumn("genotypes", F.filter("genotypes", lambda g: ~failed(g)))
    return kept.filter(~F.col("__some") | F.exists("genotypes", lambda g: F.exists(C.genotype(_gt(g)), lambda a: a > 0))).drop("__some")


def of_subtypes(df: DataFrame, subtypes: list[str]) -> DataFrame:
    return df.filter(C.var_subtype(F.col("ref"), F.col("alt"), F.col("info")).isin(subtypes))


def select_records(df: DataFrame, record: str, wanted: DataFrame) -> DataFrame:
    """The variants whose number in column `record` is in `wanted`."""
    return df.join(wanted.select(record).distinct(), record, "left_semi")


def _is_in(values: list[str]):
    return lambda g: g.isin(values)


def text_summary(df: DataFrame, ref: int = 0, alt: int = 1) -> DataFrame:
    """id, RR, R, RA, A, AA, O by the genotypes' text: two reference alleles, one alone, both, one alternative, two, other."""
    told = df.select(C.legacy_variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("id"), F.transform("genotypes", _gt).alias("gt"))
    texts = {"RR": [f"{ref}{s}{ref}" for s in "/|"], "R": [f"{ref}"], "RA": [f"{a}{s}{b}" for s in "/|" for a, b in ((ref, alt), (alt, ref))], "A": [f"{alt}"], "AA": [f"{alt}{s}{alt}" for s in "/|"]}
    every = [x for v in texts.values() for x in v]
    count = lambda test: F.size(F.filter("gt", test))
    return told.select("id", *[count(_is_in(v)).alias(k) for k, v in texts.items()], count(lambda g: ~F.coalesce(g.isin(every), F.lit(False))).alias("O"))


def heterozygous_carriers(df: DataFrame, ref: int = 0, alt: int = 1) -> DataFrame:
    """id, sample of calls with one allele of each."""
    both = [f"{a}{s}{b}" for s in "/|" for a, b in ((ref, alt), (alt, ref))]
    rows = df.select(C.legacy_variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("id"), F.explode("genotypes").alias("g"))
    return rows.filter(_gt(F.col("g")).isin(both)).select("id", "g.sample")


def population_summary(df: DataFrame, populations: list[str]) -> DataFrame:
    """variant, population, RR, R, RA, A, AA, O, AF from the genotype counts, allele numbers and frequencies in INFO; ALL
    is summed over both sexes, with one allele of Y, and of X in males."""
    numbers = lambda k: F.transform(F.split(F.try_element_at("info", F.lit(k)), ","), lambda x: x.try_cast("double"))
    one = lambda k: F.coalesce(F.get(numbers(k), 0), F.lit(0.0))
    rows = df.select("chrom", "pos", "ref", "info", F.posexplode("alt").alias("i", "a"))
    k = F.col("i") + 1
    places = [F.lit(0), C.genotype_index(F.lit(0), k), C.genotype_index(k, k)]

    def counts(key: str) -> list:
        return [F.coalesce(F.get(numbers(key), p), F.lit(0.0)) for p in places]

    male, female = counts("GC_Male"), counts("GC_Female")
    chrom, zero = F.lower("chrom"), F.lit(0.0)
    ac, an = F.coalesce(F.get(numbers("AC"), F.col("i")), zero), one("AN")
    auto = ~chrom.isin("x", "y")
    both = [F.when(auto, m + f).when(chrom == "x", f).otherwise(zero) for m, f in zip(male, female)]
    r, a = F.when(chrom == "y", an - ac).when(chrom == "x", male[0]).otherwise(zero), F.when(chrom == "y", ac).when(chrom == "x", male[1]).otherwise(zero)

    def entry(name: str, rr, r, ra, a, aa, total, key: str):
        return F.struct(F.lit(name).alias("population"), rr.alias("RR"), r.alias("R"), ra.alias("RA"), a.alias("A"), aa.alias("AA"), (total - (2 * rr + r + 2 * ra + a + 2 * aa)).alias("O"), F.get(numbers(key), F.col("i")).alias("AF"))

    entries = [entry("ALL", both[0], r, both[1], a, both[2], one("AN_Male") + one("AN_Female"), "AF")]
    for p in populations:
        c = counts(f"GC_{p}")
        entries.append(entry(p, c[0], zero, c[1], zero, c[2], one(f"AN_{p}"), f"AF_{p}"))
    named = rows.select(C.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("a")).alias("variant"), F.explode(F.array(*entries)).alias("e"))
    return named.select("variant", "e.*")


def samples(df: DataFrame) -> list[str]:
    """The samples' names, in the order of the first variant's calls."""
    row = df.select(F.transform("genotypes", lambda g: g["sample"])).first()
    return list(row[0] or []) if row else []


def merge(frames: list[DataFrame]) -> DataFrame:
    """All variants of tables with the same samples."""
    names = [samples(f) for f in frames]
    if any(n != names[0] for n in names):
        raise ValueError("the tables have different samples")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
