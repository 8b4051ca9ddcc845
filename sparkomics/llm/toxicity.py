"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of words given the word before. Its counts are continuation counts: the number of contexts, here
documents, in which a word, or a pair of words, follows, not how often it is written. The counts are discounted, and the
mass set free goes to a distribution that both classes share, the continuation counts of all labelled documents. So an
expression rare in either class gets the same backed-off probability from both and says little; and where the counts of
both classes agree with the shared distribution (a likelihood-ratio statistic under GATE) the classes share it wholly. A
pair that they share wholly backs off to the word alone: the log-ratio of a word given the one before is that of the pair
less that of the word before, or else the word's own.

A text's feature is its toxic minus its ordinary log-likelihood, divided by its length in symbols. A logistic curve
turns it into a score; it is fitted across two halves of the training rows, counts from one, features from the other,
on about FIT_ROWS rows, picked by a hash of doc_id.

Counts cover all labelled training rows. The model goes to the tasks in blocks of at most MODEL_BLOCK entries, one pass
each; labels are broadcast up to BROADCAST_LABELS rows and joined
by a shuffle beyond.

Nulls: a null text is empty; a null doc_id has no label, counts as not held out, and is scored; null labels are no
labels, of several labels of a doc_id the highest counts. Empty texts have the feature 0. Without labelled rows of both
classes every score is the toxic part of the labels, or 0. Repeated rows are all counted and scored. Very long texts are
counted and scored whole. Empty tables give empty results; further columns are ignored, `keep_clean` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, row_slices, stored, text_bytes

DISCOUNT = 0.75
#: A chi-square quantile of one degree of freedom: 0.1 %.
GATE = 10.83
FIT_ROWS = 20_000
MODEL_BLOCK = 4_000_000
BROADCAST_LABELS = 4_000_000
THRESHOLD = 0.5

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(97, 123), *range(128, 256)]] = False

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)) == 0


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in row_slices(offsets, most):
        part = offsets[a : b + 1]
        yield a, b, data[part[0] : part[-1]], part - part[0]


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of consecutive words; the caller discards those that cross rows."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(1))


def word_counts(rows: DataFrame) -> DataFrame:
    """size (1 or 2 words), key, and counts t0, o0, t1, o1 (toxic and ordinary texts in both halves) over rows of text,
    toxic, half."""
    names = ["size", "key", "t0", "o0", "t1", "o1"]

    def counted(size: int, keys: np.ndarray, row: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        known, number = np.unique(keys, return_inverse=True)
        width = max(1, len(known))
        once = np.unique(row * width + number)  # each of a text counts once
        counts = np.bincount(group[once // width] * width + once % width, minlength=4 * width).reshape(4, -1)[:, : len(known)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(known), size, np.int8)), pa.array(known.view(np.int64)), *[pa.array(c.astype(np.int32)) for c in counts]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _slices(batch.column(0), 1 << 23):
                words = hash_words(data, offsets, _NO_LETTER)
                row = np.repeat(np.arange(b - a), np.diff(words.before))
                yield counted(1, words.hash, row, group[a:b])
                inside = row[:-1] == row[1:]
                yield counted(2, pairs(words.hash)[inside], row[1:][inside], group[a:b])

    group = F.when(F.col("toxic"), 0).otherwise(1) + 2 * F.col("half")
    found = rows.select("text", group.cast("int").alias("g")).mapInArrow(run, "size byte, key long, t0 int, o0 int, t1 int, o1 int")
    return found.groupBy("size", "key").agg(*[F.sum(c).alias(c) for c in ("t0", "o0", "t1", "o1")])


def log_ratios(counts: DataFrame, discount: float = DISCOUNT, gate: float = GATE) -> DataFrame:
    """size, key, ratio: the log-ratio of both classes' probabilities, of those of `counts` (size, key, t, o) that pass the
    gate; each size has a distribution of its own."""
    sums = [F.sum(c).cast("double").alias(f"total_{c}") for c in ("t", "o")] + [F.sum((F.col(c) > 0).cast("double")).alias(f"types_{c}") for c in ("t", "o")]
    told = counts.join(F.broadcast(counts.groupBy("size").agg(*sums)), "size").filter("total_t > 0 AND total_o > 0")  # two rows
    total, types = {c: F.col(f"total_{c}") for c in ("t", "o")}, {c: F.col(f"types_{c}") for c in ("t", "o")}
    shared = (F.col("t") + F.col("o")) / (total["t"] + total["o"])
    own = {c: (F.greatest(F.col(c) - discount, F.lit(0.0)) + discount * types[c] * shared) / total[c] for c in ("t", "o")}
    surprise = {c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (total[c] * shared))).otherwise(0.0) for c in ("t", "o")}
    return told.filter(2 * (surprise["t"] + surprise["o"]) >= gate).select("size", "key", F.log(own["t"] / own["o"]).alias("ratio"))


def model_blocks(model: DataFrame, most: int = MODEL_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stored model in blocks of about `most` entries: sorted keys and their ratios."""
    n = max(1, -(-model.count() // most))
    for b in range(n):
        part = model.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b).select("key", "ratio").toArrow()
        keys = part["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        yield keys[order], part["ratio"].to_numpy()[order]


def _find(keys: np.ndarray, ratios: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ratios of the wanted keys, 0 of those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, ratios[at], 0.0)


def members(rows: DataFrame, found: DataFrame, most: int = MODEL_BLOCK) -> DataFrame:
    """key, first, second: the words of the pairs in `found` (stored; size, key, ratio), looked up in the texts of `rows`."""
    out = None
    for keys, _ in model_blocks(found.filter("size = 2"), most):
        shared = rows.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys = shared.value
            for batch in batches:
                for _, _, data, offsets in _slices(batch.column(0), 1 << 22) if len(keys) else ():
                    words = hash_words(data, offsets, _NO_LETTER).hash
                    wanted = pairs(words)
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    _, once = np.unique(np.where(keys[at] == wanted, at, -1), return_index=True)
                    once = once[keys[at[once]] == wanted[once]]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (wanted[once], words[once], words[once + 1])], ["key", "first", "second"])

        part = rows.select("text").mapInArrow(run, "key long, first long, second long")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["key"])


def interactions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, ratio of the stored `found`: words with their own, pairs with what they say beyond both their words. The sums
    over a text are those of the log-ratios of words given the words before them."""
    words = found.filter("size = 1").select("key", "ratio")
    if not found.filter("size = 2").limit(1).count():
        return words
    of = lambda c: words.select(F.col("key").alias(c), F.col("ratio").alias(f"{c}_ratio"))
    told = found.filter("size = 2").join(members(rows, found), "key").join(of("first"), "first", "left").join(of("second"), "second", "left")
    beyond = F.col("ratio") - F.coalesce("first_ratio", F.lit(0.0)) - F.coalesce("second_ratio", F.lit(0.0))
    return words.unionByName(told.select("key", beyond.alias("ratio")))


def features(rows: DataFrame, model: DataFrame, most: int = MODEL_BLOCK) -> DataFrame:
    """The rows, which have a text, with `x`: the length-normalised difference of log-likelihoods."""
    spark = rows.sparkSession
    out = rows.withColumn("x", F.lit(0.0))
    text_at, x_at = out.columns.index("text"), len(out.columns) - 1
    for block in model_blocks(model, most):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(x_at).to_numpy().copy()
                for a, b, data, offsets in _slices(batch.column(text_at), 1 << 22) if len(shared.value[0]) else ():
                    words = hash_words(data, offsets, _NO_LETTER)
                    row = np.repeat(np.arange(b - a), np.diff(words.before))
                    value = _find(*shared.value, words.hash)
                    value[1:] += np.where(row[:-1] == row[1:], _find(*shared.value, pairs(words.hash)), 0.0)
                    symbols = np.bincount(row, weights=words.length + 1, minlength=b - a)
                    x[a:b] += np.bincount(row, weights=value, minlength=b - a) / np.maximum(symbols, 1)
                yield batch.set_column(x_at, "x", pa.array(x))

        out = out.mapInArrow(run, out.schema)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) by Newton's method on the standardised feature."""
    mean, scale = x.mean(), x.std() or 1.0
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        hessian = (design.T * (p * (1 - p))) @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of labelled rows outside the held-out part."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    small = labels.count() <= BROADCAST_LABELS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(known) if small else known, "doc_id")


class Scorer(NamedTuple):
    """The model table (key, ratio; None if there is nothing to learn from) and the curve."""

    model: DataFrame | None
    slope: float
    intercept: float


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows = with_labels(docs, labels).withColumn("half", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 > 2).cast("int"))
    counts = stored(word_counts(rows), "word-counts")
    size = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    n = {c: sum(v for k, v in size.items() if k[0] == c) for c in (True, False)}
    if not (n[True] and n[False]):
        return Scorer(None, 0.0, float(bool(n[True])))

    def model(t: Column, o: Column) -> DataFrame:
        found = stored(log_ratios(counts.select("size", "key", t.alias("t"), o.alias("o")).filter("t + o > 0")), "toxicity-ratios")
        return stored(interactions(rows, found), "toxicity-model")

    whole = model(F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"))
    crossed = len(size) == 4  # both halves have both classes
    fit_rows = rows.filter("half = 1") if crossed else rows
    share = min(1.0, FIT_ROWS / sum(v for k, v in size.items() if k[1] == 1 or not crossed))
    sample = fit_rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)).select("text", "toxic")
    fit = features(sample, model(F.col("t0"), F.col("o0")) if crossed else whole).select("x", "toxic").toPandas()
    return Scorer(whole, *fit_logistic(fit["x"].to_numpy(), fit["toxic"].to_numpy(dtype=float)))


def apply(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents with `score`."""
    if scorer.model is None:
        return docs.withColumn("score", F.lit(scorer.intercept))
    scored = features(docs, scorer.model)
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.col("x") * scorer.slope + scorer.intercept)))).drop("x")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = apply(rows, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    taken = {"x", "score"} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"__{c}" for c in taken})
    kept = apply(renamed, train(docs, labels)).filter(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnsRenamed({f"__{c}": c for c in taken}).select(*docs.columns)
