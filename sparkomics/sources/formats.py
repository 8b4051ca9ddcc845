"""Readers and writers of domain text formats as DataFrames with fixed schemas.

Files are read as text, split by Spark, and parsed by column expressions; so any number of files, however large, is read
in parallel, and columns that aren't asked for aren't parsed. Compressed files are recognised by their suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GFF3_COLUMNS = ("seqid", "source", "feature", "start", "end", "score", "strand", "phase")
GAF_COLUMNS = (
    "db", "db_o_id", "db_o_symbol", "qualifier", "go_id", "db_ref", "evidence", "w_o_f", "aspect", "db_o_name",
    "db_o_synonym", "db_o_type", "date", "assigned_by", "annot_ext", "gene_product_form_id",
)


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    line = F.regexp_replace("value", "\r$", "")
    return spark.read.text(path).select(line.alias("line")).filter((F.length(F.trim("line")) > 0) & ~F.startswith("line", F.lit(comment)))


def _placed(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, at (a row's place in its file) and value. Splits of a file are read in order, each by one task."""
    rows = spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("at"), "value")


def read_fasta(spark: SparkSession, path: str, seq_type: str = "dna") -> DataFrame:
    """name, full_name, seq, seq_type of every record; the name is the header's first word.

    Records start with > at the start of a line; a file's text is split there. What stands before a file's first header is
    no record, and of records with one name the last counts (by file name, then place); only names are shuffled for that.
    """
    rows = _placed(spark, path, lineSep="\n>")
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = F.split(record, "\n", 2)
    header, body = F.trim(parts[0]), F.coalesce(F.get(parts, 1), F.lit(""))
    rows = rows.select("file", "at", F.startswith(F.ltrim(F.regexp_replace("value", r"^\s+", "")), F.lit(">")).alias("marked"), F.split(header, r"\s+")[0].alias("name"), header.alias("full_name"), F.regexp_replace(body, r"\s", "").alias("seq"))
    heads = rows.groupBy("file").agg(F.min_by(F.struct("at", "marked"), "at").alias("head"))
    junk = heads.filter("NOT head.marked").select("file", F.col("head")["at"].alias("at"))
    rows = rows.filter(F.length("name") > 0)
    named = rows.select("file", "at", "name").join(junk, ["file", "at"], "left_anti")
    again = named.groupBy("name").agg(F.count("*").alias("n"), F.max(F.struct("file", "at")).alias("last")).filter("n > 1").select("name", "last")
    told = rows.join(junk, ["file", "at"], "left_anti").join(again, "name", "left").filter(F.col("last").isNull() | (F.col("last") == F.struct("file", "at")))
    return told.select("name", "full_name", "seq", F.lit(seq_type).alias("seq_type"))


def fasta_records(spark: SparkSession, sequences: dict[str, str] | list[str], seq_type: str = "dna") -> DataFrame:
    """Records of read_fasta's columns from a mapping of names to sequences, or from a list, named by its places."""
    items = sequences.items() if isinstance(sequences, dict) else ((str(i), s) for i, s in enumerate(sequences))
    return spark.createDataFrame([(n, n, s, seq_type) for n, s in items], "name string, full_name string, seq string, seq_type string")


def merge_fasta(left: DataFrame, right: DataFrame) -> DataFrame:
    """All records; where both have a name, the right one's."""
    return right.unionByName(left.join(right.select("name"), "name", "left_anti").select(*right.columns))


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """Write records of full_name and seq, in lines of `width`."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "full_name", F.lit("\n"), wrapped).alias("value")).write.text(path)


def attributes(c: Column) -> Column:
    """A map from `k=v;...`; a key without = has a null value, further = belong to the value."""
    parts = F.filter(F.split(c, ";"), lambda x: F.trim(x) != "")
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("key"), F.get(F.split(x, "=", 2), 1).alias("value")))
    # The last of equal keys counts.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def read_gff3(spark: SparkSession, path: str, allow_additional_columns: bool = False) -> DataFrame:
    """The eight columns, attr, id (ID, else Name), parent and name of every row with nine columns."""
    cells = F.split("line", "\t", -1)
    n = F.size(cells)
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter((n >= 9) if allow_additional_columns else (n == 9)).filter(~F.startswith("line", F.lit("#")))
    named = rows.select(*[cells[i].alias(c) for i, c in enumerate(GFF3_COLUMNS)], attributes(cells[8]).alias("attr"))
    typed = named.withColumn("start", F.col("start").try_cast("bigint")).withColumn("end", F.col("end").try_cast("bigint"))
    get = lambda k: F.try_element_at("attr", F.lit(k))
    return typed.select("*", F.coalesce(get("ID"), get("Name")).alias("id"), get("Parent").alias("parent"), get("Name").alias("name"))


def write_gff3(df: DataFrame, path: str) -> None:
    """Write rows of read_gff3's schema."""
    attr = F.array_join(F.transform(F.map_entries("attr"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF3_COLUMNS], attr).alias("value")).write.text(path)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt (array), qual, filter (array, null if passed), info (map), genotypes (sample, values).

    The header line with the samples' names is looked up first; files read together must share it.
    """
    header = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).first()
    samples = header[0].rstrip("\r\n").split("\t")[9:] if header else []
    cells = F.split("line", "\t", -1)
    names = F.split(F.get(cells, 8), ":")
    field = lambda text: F.map_from_entries(F.filter(F.arrays_zip(names.alias("key"), F.split(text, ":").alias("value")), lambda e: e["key"].isNotNull()))
    calls = F.array(*[F.struct(F.lit(s).alias("sample"), field(F.get(cells, 9 + i)).alias("fields")) for i, s in enumerate(samples)]) if samples else F.lit(None).cast("array<struct<sample:string,fields:map<string,string>>>")
    return _lines(spark, path, "#").select(
        cells[0].alias("chrom"),
        cells[1].try_cast("bigint").alias("pos"),
        F.nullif(cells[2], F.lit(".")).alias("id"),
        cells[3].alias("ref"),
        F.split(cells[4], ",").alias("alt"),
        cells[5].try_cast("double").alias("qual"),
        F.when(~cells[6].isin("PASS", "."), F.split(cells[6], "[;,]")).alias("filter"),
        attributes(cells[7]).alias("info"),
        calls.alias("genotypes"),
    )


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """The annotation table's columns, all as strings; of rows with one go_id and db_o_id the first (by file name, then
    place) counts."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    lines = _placed(spark, path).filter((F.length(F.trim("value")) > 0) & ~F.startswith("value", F.lit("!")))
    rows = lines.select("file", "at", *[F.get(cells, i).alias(c) for i, c in enumerate(GAF_COLUMNS)])
    first = rows.groupBy("go_id", "db_o_id").agg(F.min_by(F.struct(*GAF_COLUMNS), F.struct("file", "at")).alias("r"))
    return first.select("r.*")


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """idx, ftype, feature, masked of a pedigree's feature list, in its order, up to a line of type E; the file is one small
    table. Lines without both type and name are none; types other than A, C, T, M and S are S."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("idx", "line"))
    cells = F.split(F.trim("line"), r"\s+", 2)
    kind = F.upper(F.substring(cells[0], 1, 1))
    told = rows.select("idx", F.upper(cells[0]).alias("type"), kind.alias("ftype"), F.trim(F.get(cells, 1)).alias("feature"), (F.length(cells[0]) > 1).alias("masked"))
    end = told.agg(F.min(F.when(F.col("type") == "E", F.col("idx"))).alias("end"))
    told = told.join(F.broadcast(end)).filter((F.col("end").isNull() | (F.col("idx") < F.col("end"))) & F.col("feature").isNotNull() & (F.col("feature") != ""))  # one row
    return told.select("idx", F.when(F.col("ftype").isin("A", "C", "T", "M", "S"), F.col("ftype")).otherwise("S").alias("ftype"), "feature", "masked")


def read_ped(spark: SparkSession, path: str, features: list[tuple[str, str]] = ()) -> DataFrame:
    """fam_id, id, father_id, mother_id, gender (m for 1 or m, else f) and `features`, a map. `features` lists (type, name) in
    the order of the columns; a marker (type M) takes two columns, or one with a slash, and is a/b. Features that a row lacks
    are null. A file ends at its first line of fewer than five cells, comments (#) aside."""
    lines = _placed(spark, path).filter(~F.startswith("value", F.lit("#"))).withColumn("cells", F.filter(F.split("value", r"\s+"), lambda x: x != ""))
    cut = lines.filter(F.size("cells") < 5).groupBy("file").agg(F.min("at").alias("cut"))
    lines = lines.join(cut, "file", "left").filter(F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    cells = F.col("cells")
    parent = lambda i: F.nullif(F.get(cells, F.lit(i)), F.lit("0"))
    table = F.lit(None).cast("map<string,string>")
    if features:
        # Each row has its own places: `at` is where the next feature begins.
        kinds = F.array(*[F.struct(F.lit(k.upper() == "M").alias("marker"), F.lit(n).alias("name")) for k, n in features])
        begin = F.struct(F.lit(5).alias("at"), F.expr("CAST(array() AS array<struct<key:string,value:string>>)").alias("out"))

        def step(s: Column, f: Column) -> Column:
            one, two = F.get(cells, s["at"]), F.get(cells, s["at"] + 1)
            pair = f["marker"] & ~F.coalesce(F.instr(one, "/") > 0, F.lit(False))
            value = F.when(pair, F.concat(one, F.lit("/"), two)).when(f["marker"], one).otherwise(F.nullif(one, F.lit("x")))
            return F.struct((s["at"] + F.when(pair, 2).otherwise(1)).alias("at"), F.array_append(s["out"], F.struct(f["name"].alias("key"), value.alias("value"))).alias("out"))

        table = F.map_from_entries(F.aggregate(kinds, begin, step)["out"])
    gender = F.when(F.get(cells, F.lit(4)).isin("1", "m"), "m").otherwise("f")
    return lines.select(F.get(cells, F.lit(0)).alias("fam_id"), F.get(cells, F.lit(1)).alias("id"), parent(2).alias("father_id"), parent(3).alias("mother_id"), gender.alias("gender"), table.alias("features"))


def founders(ped: DataFrame) -> DataFrame:
    return ped.filter("father_id IS NULL AND mother_id IS NULL")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None, int, int]]:
    """(node, parent, name, length, place among its siblings, depth) in pre-order of one tree, without its semicolon."""
    nodes: list[list] = [[0, None, None, None, 0, 0]]
    children = {0: 0}
    node, label = 0, ""

    def close() -> None:
        name, _, length = label.strip().partition(":")
        nodes[node][2] = name.strip() or None
        try:
            nodes[node][3] = float(length) if length.strip() else None
        except ValueError:
            nodes[node][3] = None

    def add(parent: int) -> int:
        nodes.append([len(nodes), parent, None, None, children[parent], nodes[parent][5] + 1])
        children[parent] += 1
        children[len(nodes) - 1] = 0
        return len(nodes) - 1

    for ch in text:
        if ch == "(":
            node = add(node)
        elif ch in ",)":
            close()
            label, parent = "", nodes[node][1]
            if parent is None:
                break  # more closed than opened
            node = add(parent) if ch == "," else parent
        else:
            label += ch
    close()
    return [tuple(n) for n in nodes]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """tree, node_id, parent_id, name, length, ord, depth of all nodes; trees end with a semicolon, `tree` is a hash."""
    schema = "tree long, node_id int, parent_id int, name string, length double, ord int, depth int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(tree, *n) for tree, text in zip(frame["tree"], frame["value"]) for n in parse_newick(text)]
            out = pd.DataFrame(rows, columns=["tree", "node_id", "parent_id", "name", "length", "ord", "depth"])
            yield out.astype({"parent_id": "Int32", "node_id": "int32", "ord": "int32", "depth": "int32", "length": "float64"})

    rows = spark.read.text(path, lineSep=";").filter(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    return rows.select(F.xxhash64("value").alias("tree"), "value").mapInPandas(run, schema)


def leaves(tree: DataFrame) -> DataFrame:
    """The nodes without children."""
    parents = tree.filter("parent_id IS NOT NULL").select("tree", F.col("parent_id").alias("node_id")).distinct()
    return tree.join(parents, ["tree", "node_id"], "left_anti")
