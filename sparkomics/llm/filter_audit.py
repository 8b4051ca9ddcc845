"""Filter interaction audit: what each filter removes, at each place of each order of the filters.

Documents become bit masks of the filters that they fail, and masks with their counts are cells; that aggregate is all
that sees documents. Cells are unpivoted against the steps of every order, a running bit-or over the steps before tells
whether an earlier filter has taken a cell, conditional sums give a step's counts, and a window over a filter's steps in all
orders sums what it removes: its Shapley value times the number of orders.

Filters of `document_masks`, in bit order (words: maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive): A under 100 words; B fewer
than 80 different words in 100; C more than 10 capitals A-Z in 100 code points; D any of `#$%&*|`; E the text of a document
with a smaller doc_id, of any part.

Nulls: a null text is empty, a null part the empty string; a row without doc_id fails E nowhere, is nobody's smaller
document and has no labels. Rows that share a doc_id are documents of their own, and none of them is a copy of the other. A
doc_id with several labels has each that any of its rows gives. Empty texts fail A, and E behind the first. Ties: none, counts
don't depend on order. An empty table gives no rows. Extra columns don't matter: only doc_id, text, lang, quality and toxic
are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"


def text_mask(text: F.Column, words: F.Column) -> F.Column:
    """Bits of the filters A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(MARKS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask, good, toxic of each row. Texts are read once; equal ones meet as digests, counted down to the
    smallest doc_id of each before they are joined, on doc_id and digest, so that no group of copies meets in a task."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(lang, '') part", "coalesce(text, '') text")
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), "")).select(
        "doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    rows = stored(rows, "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(firsts, ["doc_id", "digest"], "left")
        .join(marks, "doc_id", "left")
        .select(
            "doc_id",
            "part",
            (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, for every part of
    `masked` (part, mask with bit k for the filter at place k of `filters`, good, toxic) and every order, zeros included.

    There are 2^n cells a part at most for n filters, and n! n steps; so n should stay small."""
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    orders = ["".join(p) for p in permutations(filters)]
    steps = (
        cells.withColumn("filter_order", F.explode(F.lit(orders)))
        .select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
        .withColumn("bit", F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k))), F.col("letter")))
        .withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    )
    before = W.partitionBy("part", "mask", "filter_order").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    return (
        steps.groupBy("part", "filter_order", (F.col("place") + 1).alias("step"), "letter")
        .agg(
            total("n", ~gone & ~fails).alias("kept"),
            total("n", ~gone & fails).alias("removed"),
            total("n", gone & fails).alias("redundant"),
            total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
            total("good", ~gone & fails).alias("good_lost"),
            total("toxic", ~gone & fails).alias("toxic_lost"),
        )
        .withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter")))
        .drop("letter")
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents by A to E."""
    return audit(document_masks(docs, labels))
