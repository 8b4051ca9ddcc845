import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from sparkomics.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        x = int(ch)
        total += (2 * x - 9 if x > 4 else 2 * x) if i % 2 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, rx in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in rx.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PIECES = ["a@b.co", "_x@d.e", "x.@y.z", "@", "..", ".", "1.2.3.4", "256.1.1.1", "007.08.1.2", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467", "0" * 14, "5", " ", "-", "  ", "--", "\n", "+1 (212) 555-0100", "+", "(", ")", "é", "日", "word", "12", "345678", "%", "_"]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "1 2 " * 6000), (1003, "9" * 30_000), (1005, "a@b" + ".c" * 30_000), (1006, "+" + "1" * 30_000), (1004, "plain"), (1004, "plain"), (None, "a@b.co")]
    out = P.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], ",".join(x for x in r["spans"].split(",") if not x.startswith("term")), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in out.collect())
    want = []
    for d, t in rows:
        s = brute(t or "")
        said = ",".join(f"{P.KINDS[k]}:{a}:{e}" for a, k, e in s)
        want.append((-1 if d is None else d, said, hashlib.sha256(said.encode()).hexdigest(), *(sum(k == j for _, k, _ in s) for j in range(4))))
    assert got == sorted(want)


TERM = re.compile(r"(?<![^\W_]|[@._%+-])[^\W\d_]{4,}(?![0-9@_%+-]|\.[A-Za-z0-9]|[^\W\d_])")


def brute_terms(rows, disclosure=P.DISCLOSURE, shrinkage=P.SHRINKAGE):
    """Per row: (start, end) of the terms whose shrunk pointwise mutual information with an entity of their context is
    enough."""
    with_entity, with_term, both, spots, n = {}, {}, {}, [], 0
    for i, (_, text) in enumerate(rows):
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            n += max(1, math.ceil(len(line) / P.CONTEXT))
            entities, terms = {}, {}
            for a, _, e in brute(line):
                entities.setdefault(a // P.CONTEXT, set()).add(line[a:e])
            for m in TERM.finditer(line):
                terms.setdefault(m.start() // P.CONTEXT, {}).setdefault(m[0].lower(), []).append((at + m.start(), at + m.end()))
            for piece, found in terms.items():
                for t in found:
                    with_term[t] = with_term.get(t, 0) + 1
            for piece, values in entities.items():
                for v in values:
                    with_entity[v] = with_entity.get(v, 0) + 1
                    for t, places in terms.get(piece, {}).items():
                        both[v, t] = both.get((v, t), 0) + 1
                        spots += [(i, v, t, p) for p in places]
            at += len(line) + 1
    ratio = {}
    for (v, t), k in both.items():
        share = with_entity[v] / n
        if share < 1:
            ratio[v, t] = math.log((k + shrinkage * share) / (with_term[t] + shrinkage) / share) / -math.log(share)
    return {(i, *p) for i, v, t, p in spots if ratio.get((v, t), 0) >= disclosure}


def test_disclosing_terms_against_brute_force(spark):
    """Names that stand with one address only disclose it, common words don't; repeated rows and stretches of long lines."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows = [(i, f"Write to Zubrowski about {w}.\nzub@example.org is the address of Zubrowski for {w}") for i, w in enumerate(("bees", "wasps", "ants", "moths"))]
    for i in range(10, 2500):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))
        rows.append((i, line + rng.choice(["", "", "", f" {rng.choice(words)}@{rng.choice('abc')}.org", "\n1.2.3.4 Quetzal " + rng.choice(words)])))
    rows += [rows[-1], (None, "seldom@example.org Xylograph"), (3000, " ".join(rng.choice([*words, "q@r.st", "Qoph"]) for _ in range(1500)))]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).withColumn("term", F.lit(1)).withColumn("line", F.lit(2)).withColumn("value", F.lit("v"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], ",".join(x for x in r["spans"].split(",") if x.startswith("term"))) for r in P.personal_data(df).collect())
    told, want = brute_terms(rows), []
    for i, (d, _) in enumerate(rows):
        want.append((-1 if d is None else d, ",".join(f"term:{a}:{e}" for k, a, e in sorted(told) if k == i)))
    assert got == sorted(want)
    said = {rows[i][1][a:e] for i, a, e in told}
    assert {"Zubrowski", "Quetzal", "Xylograph"} <= said and "address" in said and len(told) < 3000


def test_terms_occur_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = P.personal_data(docs).filter("n_term > 0").collect()
    assert sum(r["n_term"] for r in out) == len(brute_terms(rows)) > 0


def test_one_line_of_a_megabyte(spark):
    text = "someone " * 60_000 + "a@b.co and " * 3_000 + "a" * 400_000 + " 1.2.3.4"
    out = P.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_email"] == 3_000 and out["n_ip"] == 1


def test_sanitise(spark):
    struct = lambda k, a, b, r: f"named_struct('kind','{k}','start',{a}L,'end',{b}L,'ratio',{r}D)"
    spans = "array(" + ",".join([struct("email", 3, 9, 1.0), struct("ip", 7, 12, 1.0), struct("term", 15, 18, 0.9), struct("term", 22, 24, 1.0)]) + ")"
    text = "to a@b.co1234, Bob is él end"
    row = spark.range(1).select(P.sanitise(F.lit(text), F.expr(spans)).alias("x")).first()
    assert row["x"] == "to [email][ip]4, [term] is  end"


def test_empty_table(spark):
    assert P.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
