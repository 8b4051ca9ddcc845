"""Lookups in annotation tables: points, regions, identifiers, associations, orthologs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkomics.operators import ranges


def _first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def scores_at(scores: DataFrame, chrom: str, start: int, end: int | None = None, alt: str | None = None) -> DataFrame:
    """pos, ref, alt, phred at a place, or from `start` to `end`; of one alternative, or of all. A place with an alternative
    gives a row only if there is exactly one."""
    found = scores.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end if end is not None else start))
    found = (found if alt is None else found.filter(F.col("alt") == alt)).select("pos", "ref", "alt", "phred")
    if end is None and alt is not None:
        return found.withColumn("__n", F.count("*").over(Window.partitionBy("pos"))).filter("__n = 1").drop("__n")
    return found


def scores_in(scores: DataFrame, regions: DataFrame, width: int = 1024) -> DataFrame:
    """chrom, pos, alt, phred, once each, in any of the regions (chrom, start, end; an end that is null is the start)."""
    named = regions.select(F.col("chrom").alias("seqid"), "start", F.coalesce("end", "start").alias("end"))
    points = scores.withColumnsRenamed({"chrom": "seqid", "pos": "start"}).withColumn("end", F.col("start") + 1)
    met = ranges.interval_overlap(points, named, width)
    return met.groupBy(F.col("seqid").alias("chrom"), F.col("start").alias("pos"), "alt").agg(F.max("phred").alias("phred"))


def score_percentile(scores: DataFrame, regions: DataFrame, percent: float = 95, width: int = 1024) -> DataFrame:
    """threshold: the exact percentile, with linear interpolation, of the scores in the regions."""
    return scores_in(scores, regions, width).agg(F.percentile("phred", percent / 100).alias("threshold"))


def in_regions(df: DataFrame, regions: DataFrame, width: int = 1024, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """The rows in each region (chrom, start, end), so often as regions hold them."""
    points = df.withColumn("seqid", F.col(chrom)).withColumn("start", F.col(pos)).withColumn("end", F.col(pos) + 1)
    named = regions.select(F.col("chrom").alias("seqid"), "start", "end")
    return ranges.interval_overlap(points, named, width).select(*df.columns, "region_start", "region_end")


def near_genes(df: DataFrame, genes: DataFrame, upstream: int, downstream: int, frequency: str | None = None, least: float | None = None, width: int = 1 << 16) -> DataFrame:
    """gene and the rows (chrom, pos) up to so far before or behind it; with `least`, of that minor allele frequency."""
    around = genes.select("gene", "chrom", F.greatest(F.col("start") - upstream, F.lit(0)).alias("start"), (F.col("end") + downstream).alias("end"))
    if least is not None:
        df = df.filter(F.least(F.col(frequency), 1 - F.col(frequency)) >= least)
    met = in_regions(df, around.drop("gene").distinct(), width)
    named = around.withColumnsRenamed({"start": "region_start", "end": "region_end"})
    return met.join(named, ["chrom", "region_start", "region_end"]).select("gene", *df.columns)


def identifiers_at(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (chrom, pos, alt) with `name`: rs, else ss and the number of the first record there with the alternative."""
    hits = wanted.join(records.select("chrom", "pos", F.explode("alts").alias("alt"), "rs", "ss"), ["chrom", "pos", "alt"], "left")
    name = F.coalesce(F.concat(F.lit("rs"), F.col("rs").cast("string")), F.concat(F.lit("ss"), F.col("ss").cast("string")))
    return hits.groupBy("chrom", "pos", "alt").agg(F.min_by(name, F.struct(F.col("rs").isNull(), "rs", "ss")).alias("name"))


def first_match(keys: DataFrame, table: DataFrame, source: str, target: str) -> DataFrame:
    """source, target: the smallest target of each key, or null."""
    one = table.filter(F.col(source).isNotNull()).groupBy(source).agg(F.min(target).alias(target))
    return keys.select(source).join(one, source, "left")


def complete(keys: DataFrame, table: DataFrame, known: str, others: list[str]) -> DataFrame:
    """Each key with the other identifiers of its first row in the table."""
    return keys.select(known).join(_first(table.select(known, *others).filter(F.col(known).isNotNull()), [known], [F.asc_nulls_last(o) for o in others]), known, "left")


def best_orthologs(hits: DataFrame, query: str, species: str, names: list[str], fields: list[str], confidence: str, rank: str) -> DataFrame:
    """A row for each query with a struct of `fields` for each species: its first hit whose confidence isn't low."""
    kept = _first(hits.filter(F.col(confidence) != "low"), [query, species], [rank])
    first = lambda n: F.max(F.when(F.col(species) == n, F.struct(*fields))).alias(n)
    return kept.groupBy(query).agg(*[first(n) for n in names])


def associations(df: DataFrame, chrom: str, start: int | None = None, stop: int | None = None, p: float | None = None, traits: list[str] | None = None) -> DataFrame:
    """Rows (chrom, pos, p, trait) on a chromosome, within both places, at or under a p-value, of the traits."""
    out = df.filter(F.col("chrom") == chrom)
    out = out if start is None else out.filter(F.col("pos") >= start)
    out = out if stop is None else out.filter(F.col("pos") <= stop)
    out = out if p is None else out.filter(F.col("p") <= p)
    return out if traits is None else out.filter(F.col("trait").isin(traits))


def load_associations(raw: DataFrame, listed: list[str], p: str, pos: str) -> DataFrame:
    """Association rows: those with an x in the place go, parallel lists by ; become rows, a p-value that is none is 1, a
    place that is none 0."""
    from sparkomics.operators.tables import flat

    out = flat(raw.filter(~F.coalesce(F.contains(F.lower(pos), F.lit("x")), F.lit(False))), listed, ";", True)
    return out.withColumn(p, F.coalesce(F.col(p).try_cast("double"), F.lit(1.0))).withColumn(pos, F.coalesce(F.trim(F.col(pos)).try_cast("bigint"), F.lit(0)))


def at_strength(df: DataFrame, evidence: str, scale: dict[str, int], least: int) -> DataFrame:
    """The rows with `score`, their evidence by the scale, at or over `least`."""
    table = F.create_map(*[F.lit(x) for pair in scale.items() for x in pair])
    return df.withColumn("score", F.try_element_at(table, F.col(evidence))).filter(F.col("score") >= least)


def left_merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The left join of two tables; of columns that both have, the first one's stay."""
    return first.join(second.select(key, *[c for c in second.columns if c not in first.columns]), key, "left")


def in_both(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.join(second.select(key).distinct(), key, "left_semi")


def counts_with_metadata(counts: DataFrame, metadata: DataFrame, sample: str, taxon: str, value: str, n: int = 3) -> DataFrame:
    """A row for each sample of either table: the metadata's first row, and the n most abundant taxa, top_1 to top_n."""
    order = Window.partitionBy(sample).orderBy(F.desc(value), taxon)
    tops = counts.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).groupBy(sample).agg(*[F.max(F.when(F.col("__n") == k, F.col(taxon))).alias(f"top_{k}") for k in range(1, n + 1)])
    return _first(metadata, [sample], [c for c in metadata.columns if c != sample]).join(tops, sample, "full_outer")


def aligned(inputs: DataFrame, lifted: DataFrame, number: str) -> DataFrame:
    """The inputs with the region that each was lifted to, or nulls; `chr` before a chromosome goes."""
    out = lifted.select(number, F.regexp_replace("chrom", "^chr", "").alias("new_chrom"), F.col("start").alias("new_start"), F.col("end").alias("new_end"))
    return inputs.join(out, number, "left")


def zip_longest(df: DataFrame, fields: list[str], sep: str = "|") -> DataFrame:
    """A row for each place of the longest of several delimited columns; shorter ones are filled with nulls."""
    zipped = F.arrays_zip(*[F.when(F.col(c).isNotNull(), F.split(c, F.lit("\\Q" + sep + "\\E"))).otherwise(F.expr("array()")).alias(c) for c in fields])
    rest = [c for c in df.columns if c not in fields]
    return df.select(*rest, F.explode_outer(zipped).alias("__z")).select(*rest, *[F.col(f"__z.{c}").alias(c) for c in fields])


def name_classes(names: DataFrame, key: str, kind: str, name: str, kinds: list[str], order: str) -> DataFrame:
    """A row for each key with a column for each kind of name: the first one."""
    return names.groupBy(key).agg(*[F.min_by(F.when(F.col(kind) == k, F.col(name)), F.when(F.col(kind) == k, F.col(order))).alias(k.replace(" ", "_")) for k in kinds])


def co_occurrence(df: DataFrame, person: str, item: str) -> DataFrame:
    """a, b, n: persons who have both items, a < b."""
    one = df.select(F.col(person).alias("p"), F.col(item).alias("i")).distinct()
    met = one.alias("x").join(one.alias("y"), F.expr("x.p = y.p AND x.i < y.i"))
    return met.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("n"))


def samples_per_person(df: DataFrame, person: str, sample: str) -> DataFrame:
    return df.groupBy(person).agg(F.count_distinct(sample).alias("n"), F.sort_array(F.collect_set(sample)).alias("samples"))


def spliced(features: DataFrame, sequences: DataFrame, feature: str = "CDS") -> DataFrame:
    """parent, seq: the parent's features of one kind joined by their place, from the end on the minus strand. `features`
    has seqid, feature, start, end, strand, parent; `sequences` has name, seq."""
    from sparkomics.functions.columns import feature_sequence

    parts = features.filter(F.col("feature") == feature).join(sequences.select(F.col("name").alias("seqid"), "seq"), "seqid")
    part = feature_sequence(F.col("seq"), F.col("start"), F.col("end"), F.col("strand"))
    place: Column = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    ordered = F.sort_array(F.collect_list(F.struct(place.alias("place"), part.alias("part"))))
    return parts.groupBy("parent").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("seq"))


def same_strand(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, same of pairs of ids."""
    strand = lambda c: features.groupBy(F.col("id").alias(c)).agg(F.max("strand").alias(f"__{c}"))
    return pairs.join(strand("a"), "a").join(strand("b"), "b").select("a", "b", (F.col("__a") == F.col("__b")).alias("same"))
