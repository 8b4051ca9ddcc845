from pyspark.sql import functions as F

from sparkomics.functions import columns as C
from sparkomics.operators import variants as V
from sparkomics.sources import formats as R

VCF = """##fileformat=VCFv4.1
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
20\t100\trs1\tG\tA\t29\tPASS\tNS=3;DB;H2\tGT:GQ\t0|0:48\t1|0:48\t1/1:43
20\t200\t.\tT\tA,C\t3\tq10;s50\tNS=3\tGT\t0|1\t2/1\t./.
20\t300\tms\tGTC\tG\t50\t.\tSVTYPE=DEL;X=a=b\tGT\t0/1\t0/2\t1
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fasta", ">one first record\nACGT\nAC GT\n\n>two\nTT\n>three empty\n")
    got = {r["name"]: (r["full_name"], r["seq"]) for r in R.read_fasta(spark, path).collect()}
    assert got == {"one": ("one first record", "ACGTACGT"), "two": ("two", "TT"), "three": ("three empty", "")}
    R.write_fasta(R.read_fasta(spark, path), str(tmp_path / "out"), 3)
    assert {r["name"]: (r["full_name"], r["seq"]) for r in R.read_fasta(spark, str(tmp_path / "out")).collect()} == got
    other = spark.createDataFrame([("two", "two new", "GG", "dna")], "name string, full_name string, seq string, seq_type string")
    assert {r["name"]: r["seq"] for r in R.merge_fasta(R.read_fasta(spark, path), other).collect()}["two"] == "GG"


def test_gff3(spark, tmp_path):
    path = write(tmp_path / "a.gff3", "##gff-version 3\nchr1\ts\tgene\t1\t10\t.\t+\t.\tID=g;Name=n;flag;k=a=b\nchr1\ts\tmRNA\t2\t9\t.\t-\t0\tName=m;Parent=g\nshort\tline\n")
    rows = {r["id"]: r for r in R.read_gff3(spark, path).collect()}
    assert set(rows) == {"g", "m"} and rows["m"]["parent"] == "g" and rows["g"]["attr"] == {"ID": "g", "Name": "n", "flag": None, "k": "a=b"}
    assert (rows["g"]["start"], rows["g"]["end"], rows["g"]["name"]) == (1, 10, "n")
    R.write_gff3(R.read_gff3(spark, path), str(tmp_path / "out"))
    assert {r["id"] for r in R.read_gff3(spark, str(tmp_path / "out")).collect()} == {"g", "m"}


def test_vcf_and_variants(spark, tmp_path):
    df = R.read_vcf(spark, write(tmp_path / "a.vcf", VCF)).cache()
    rows = {r["pos"]: r for r in df.collect()}
    assert rows[100]["filter"] is None and rows[200]["filter"] == ["q10", "s50"] and rows[300]["filter"] is None
    assert rows[100]["info"] == {"NS": "3", "DB": None, "H2": None} and rows[300]["info"]["X"] == "a=b"
    kinds = {r["pos"]: r["t"] for r in df.select("pos", C.var_type(F.col("ref"), F.col("alt"), V.has_sv(df)).alias("t")).collect()}
    assert kinds == {100: "snp", 200: "snp", 300: "sv"}
    assert [r["pos"] for r in V.filter_variants(df, filters=["q10"]).collect()] == [100, 300]
    assert [r["pos"] for r in V.filter_variants(df, types=["snp"], n_alleles=1).collect()] == [100]
    assert len(V.filter_variants(df, samples=["S2"]).first()["genotypes"]) == 1
    s = {r["variant"]: (r["RR"], r["RA"], r["AA"], r["R"], r["A"]) for r in V.summary(df).collect()}
    assert s == {"20-100-G-A": (1, 1, 1, 0, 0), "20-200-T-A": (1, 2, 0, 0, 0), "20-200-T-C": (2, 1, 0, 0, 0), "20-300-GTC-G": (1, 1, 0, 0, 1)}
    assert {(r["variant"], r["sample"]) for r in V.who_has(df).collect()} >= {("20-100-G-A", "S3"), ("20-300-GTC-G", "S3")}
    wanted = spark.createDataFrame([("20", 100, "a", "g"), ("20", 200, "T", "C"), ("20", 200, "T", "G")], "chrom string, pos long, ref string, alt string")
    assert {(r["pos"], r["swapped"]) for r in V.find_variants(df, wanted).collect()} == {(100, True), (200, False)}


def test_pedigree(spark, tmp_path):
    dat = R.read_dat(spark, write(tmp_path / "a.dat", "A some_disease\nM2 marker\nT trait\n"))
    features = [(r["ftype"], r["feature"]) for r in dat.orderBy("idx").collect()]
    assert features == [("A", "some_disease"), ("M", "marker"), ("T", "trait")] and [r["masked"] for r in dat.orderBy("idx").collect()] == [False, True, False]
    ped = R.read_ped(spark, write(tmp_path / "a.ped", "1 1 0 0 m 1 3 3 x\n1 2 0 0 f 1 4 4 x\n1 3 1 2 f 2 1 3 1.5\n"), features)
    rows = {r["id"]: r for r in ped.collect()}
    assert rows["3"]["father_id"] == "1" and rows["3"]["features"] == {"some_disease": "2", "marker": "1/3", "trait": "1.5"} and rows["1"]["features"]["trait"] is None
    assert {r["id"] for r in R.founders(ped).collect()} == {"1", "2"}


def test_newick(spark, tmp_path):
    df = R.read_newick(spark, write(tmp_path / "a.nwk", "((A:1,B:2)x:0.5,(C,D),E)root;\n(F,G);\n"))
    assert df.select("tree").distinct().count() == 2
    assert {r["name"] for r in R.leaves(df).collect()} == set("ABCDEFG")
    x = df.filter("name = 'x'").first()
    assert x["length"] == 0.5 and x["depth"] == 1 and x["ord"] == 0
    assert R.parse_newick("(" * 3000 + "a" + ")" * 3000)[-1][5] == 3000


def test_sequences(spark):
    row = spark.range(1).select(C.revcomp(F.lit("ACgtN")).alias("r"), C.revcomp(F.lit("SW")).alias("q"), C.revcomp(F.lit("SW"), strict=True).alias("s"), C.translate_dna(F.lit("ATGTAAGG")).alias("p"), C.safe_name(F.lit("1 a-b")).alias("n"), C.kegg_id(F.lit("hsa10"), True).alias("k")).first()
    assert tuple(row) == ("NacGT", "SW", "WS", "M**", "X1_ab", "path:hsa00010")
