"""Readers and writers of tables in files: named columns, alignments, annotations, terms, regions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of these formats and their types.
BLAST = {
    "qseqid": "string", "sseqid": "string", "pident": "double", "length": "int", "mismatch": "int", "gapopen": "int", "qstart": "int",
    "qend": "int", "sstart": "int", "send": "int", "evalue": "double", "bitscore": "double", "slen": "int", "qlen": "int",
}
PSL = {
    "matches": "bigint", "mismatches": "bigint", "rep_matches": "bigint", "n_count": "bigint", "q_num_insert": "bigint", "q_base_insert": "bigint",
    "t_num_insert": "bigint", "t_base_insert": "bigint", "strand": "string", "q_name": "string", "q_size": "bigint", "q_start": "bigint",
    "q_end": "bigint", "t_name": "string", "t_size": "bigint", "t_start": "bigint", "t_end": "bigint", "block_count": "bigint",
    "block_sizes": "string", "q_starts": "string", "t_starts": "string",
}
VEP = (
    "variant_id", "location", "allele", "gene", "feature", "feature_type", "consequence", "cdna_position", "cds_position", "protein_position",
    "amino_acids", "codons", "existing_variation", "extra",
)


def read_table(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t", comment: str | None = None, header: bool = False) -> DataFrame:
    """A delimited table with these columns and types; empty fields, and those that their type can't read, are null.

    Lines that begin with `comment` are skipped, so is a header line.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("nullValue", "").option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    text = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return text.select(*[(F.col(c) if kind == "string" else F.trim(c).try_cast(kind)).alias(c) for c, kind in columns.items()])


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BLAST, comment="#")


def write_blast(hits: DataFrame, path: str) -> None:
    """Write the hits' columns in the format's order, without a header."""
    hits.select(*BLAST).write.option("sep", "\t").csv(path)


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """The alignments' columns and `length`, what is aligned and the query's gaps; lines of the format's header go."""
    rows = read_table(spark, path, PSL).filter("matches IS NOT NULL")
    return rows.withColumn("length", F.col("matches") + F.col("mismatches") + F.col("q_base_insert"))


def read_vep(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, dict.fromkeys(VEP, "string"), comment="#")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """id, namespace, name, definition of the terms of an ontology in XML."""
    schema = "id string, namespace string, name string, def struct<defstr:string>"
    rows = spark.read.format("xml").option("rowTag", "term").schema(schema).load(path)
    return rows.select("id", "namespace", "name", F.trim("def.defstr").alias("definition"))


def write_regions(regions: DataFrame, path: str, number: str) -> None:
    """Write chrom, start, end and a running number of regions for lifting over; chromosomes get the prefix chr."""
    chrom = F.when(F.startswith("chrom", F.lit("chr")), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    regions.select(F.concat_ws("\t", chrom, F.col("start").cast("string"), F.col("end").cast("string"), F.col(number).cast("string")).alias("value")).write.text(path)


def write_vcf(variants: DataFrame, path: str, samples: list[str]) -> None:
    """Write variants (read_vcf's columns) with a header; each file of the folder has it.

    A call has its fields in the order of their names, GT first.
    """
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("genotypes", lambda g: F.map_keys(g["fields"])))))
    names = F.concat(F.filter(names, lambda n: n == "GT"), F.filter(names, lambda n: n != "GT"))

    def call(sample: str):
        fields = F.get(F.filter("genotypes", lambda g: g["sample"] == sample), 0)["fields"]
        return F.array_join(F.transform(names, lambda n: dot(F.try_element_at(fields, n))), ":")

    fixed = [F.col("chrom"), dot(F.col("pos")), dot(F.col("id")), F.col("ref"), dot(F.nullif(F.array_join("alt", ","), F.lit(""))), dot(F.col("qual")), F.coalesce(F.array_join("filter", ";"), F.lit("PASS")), dot(F.nullif(info, F.lit("")))]
    calls = [F.array_join(names, ":"), *map(call, samples)] if samples else []
    line = F.concat_ws("\t", *fixed, *calls)
    title = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])
    first = F.row_number().over(_within_files())
    rows = variants.withColumn("__file", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).withColumn("__first", first)
    rows.select(F.when(F.col("__first") == 1, F.concat(F.lit(title + "\n"), line)).otherwise(line).alias("value")).write.text(path)


def _within_files():
    from pyspark.sql.window import Window

    return Window.partitionBy("__file").orderBy("__at")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path whose name has the latest date for `{date}`, eight digits, in the pattern of a folder's names; or none."""
    folder, _, name = pattern.rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before, _, after = name.partition("{date}")
    dated = re.compile(re.escape(before) + r"([0-9]{8})" + re.escape(after))
    found = [(m[1], f"{folder}/{m[0]}") for s in files.listStatus(hadoop) if (m := dated.fullmatch(s.getPath().getName()))]
    return max(found)[1] if found else None
