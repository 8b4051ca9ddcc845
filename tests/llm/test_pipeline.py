"""The pipeline on small tables, held against plain re-statements of its stages."""

import random

import corpus_pipeline
import pytest
import test_decontamination
import test_line_dedup
import test_ngram_join
import test_toxicity

import __spark_entry__

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    rows, labels = test_toxicity.corpus(500)
    texts = {r[0]: r[1] for r in rows}
    items = [(i, " ".join(f"item{i}word{k}" for k in range(20))) for i in range(5)]
    clean = [d for d in texts if d % 6]
    for d in rng.sample(clean, 20):
        texts[d] += "\n" + items[d % 5][1]
    for k, d in enumerate(rng.sample(clean, 40)):
        words = texts[d].split(" ")
        if k % 2:
            words[0] = "changed"
        texts[1000 + k] = " ".join(words)
    texts |= {2000: None, 2001: "", 2002: "short"}
    docs = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts.items()]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    at = 0
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        at += 1
        if name != "best-fit packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            toxic = {d for d in before if d < 500 and d % 6 == 0}
            assert len(toxic & set(after)) < 0.1 * len(toxic) and len(set(after) - toxic) > 0.97 * (len(before) - len(toxic))
        elif name == "line dedup":
            gone = test_line_dedup.brute(list(before.items()), 1, test_line_dedup.L.MIN_CHARS)
            want = {}
            for (d, t), numbers in gone.items():
                out = {int(x) for x in numbers.split(",") if x}
                lines = (before[d] or "").split("\n")
                kept = [x for i, x in enumerate(lines) if i not in out]
                if not out or "".join(kept).strip():
                    want[d] = None if before[d] is None else "\n".join(kept)
            assert after == want
        elif name == "n-gram Jaccard join":
            assert set(after) == {d for d, (_, c) in test_ngram_join.brute(list(before.items())).items() if d == c}
        elif name == "benchmark decontamination":
            leaked = {d for d, _ in test_decontamination.brute(list(before.items()), benchmark)}
            assert set(after) == set(before) - leaked and leaked
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, tables)) == key(docs)


def test_registered():
    names = __spark_entry__.queries().keys()
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {"pipeline", *(q[: q.index("_") + 1] for q in names if q.startswith("op"))}
    assert corpus_pipeline.ORACLE_SQL is None
