from sparkomics.functions import columns as C
from sparkomics.sources import formats, tabular


def test_alignment_tables(spark, tmp_path):
    line = "q1\ts1\t98.5\t100\t1\t0\t1\t100\t5\t104\t1e-20\t180\t400\t"
    (tmp_path / "a.tsv").write_text(f"# a comment\n{line}\nq2\ts2\todd\t\t1\t0\t1\t100\t5\t104\t0\t90\t1\t2\n")
    hits = tabular.read_blast(spark, str(tmp_path / "a.tsv"))
    rows = {r["qseqid"]: r for r in hits.collect()}
    assert (rows["q1"]["pident"], rows["q1"]["evalue"], rows["q1"]["qlen"]) == (98.5, 1e-20, None)
    assert (rows["q2"]["pident"], rows["q2"]["length"], rows["q2"]["qlen"]) == (None, None, 2)
    tabular.write_blast(hits, str(tmp_path / "out"))
    assert sorted(map(tuple, tabular.read_blast(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, hits.collect()), key=repr)


def test_psl_without_its_header(spark, tmp_path):
    row = "90\t3\t5\t0\t1\t7\t2\t9\t+\tq\t120\t0\t100\tt\t400\t0\t330\t2\t10,100,\t0,20,\t0,30,"
    (tmp_path / "a.psl").write_text(f"psLayout version 3\n\nmatch\tmis-\n-----\n{row}\n")
    found = tabular.read_psl(spark, str(tmp_path / "a.psl"))
    score, _ = C.psl_scores({c: found[c] for c in tabular.PSL})
    assert [tuple(r) for r in found.select("length", score).collect()] == [(100, 264)]


def test_annotations_and_terms(spark, tmp_path):
    (tmp_path / "vep.txt").write_text("## VEP\n#Uploaded\nv1\t1:5\tA" + "\t-" * 11 + "\n")
    assert [(r["variant_id"], r["allele"], r["extra"]) for r in tabular.read_vep(spark, str(tmp_path / "vep.txt")).collect()] == [("v1", "A", "-")]
    (tmp_path / "go.xml").write_text("<obo><term><id>GO:1</id><name>one</name><namespace>n</namespace><def><defstr>The first.</defstr></def></term><term><id>GO:2</id></term></obo>")
    assert sorted(map(tuple, tabular.read_terms(spark, str(tmp_path / "go.xml")).collect())) == [("GO:1", "n", "one", "The first."), ("GO:2", None, None, None)]


def test_variants_written_and_read(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n20\t5\trs1\tA\tC,G\t29.0\tPASS\tDB;DP=3\tGT:GQ\t0|1:9\t1/1:8\n20\t9\t.\tA\tT\t.\tq10;s50\tDP=1\tGT:GQ\t./.:.\t0/0:7\n"
    (tmp_path / "a.vcf").write_text(text)
    variants = formats.read_vcf(spark, str(tmp_path / "a.vcf"))
    tabular.write_vcf(variants, str(tmp_path / "out"), ["S1", "S2"])
    again = formats.read_vcf(spark, str(tmp_path / "out"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, variants.collect()))
    assert sum(f.read_text().count("#CHROM") for f in (tmp_path / "out").glob("part*")) >= 1


def test_regions_and_newest(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, 9, 0), ("chr2", 1, 2, 1)], "chrom string, start int, end int, n int")
    tabular.write_regions(df, str(tmp_path / "bed"), "n")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "bed")).collect()) == ["chr1\t5\t9\t0", "chr2\t1\t2\t1"]
    for name in ("a.20200101.gz", "a.20211231.gz", "a.2022.gz", "b.20230101.gz"):
        (tmp_path / name).write_text("x")
    assert tabular.newest(spark, f"{tmp_path}/a.{{date}}.gz") == f"{tmp_path}/a.20211231.gz"
    assert tabular.newest(spark, f"{tmp_path}/c.{{date}}.gz") is None
