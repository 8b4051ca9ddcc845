"""Benchmark decontamination: item-sized windows of documents against the items of a benchmark.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. For every item a window of as many words
slides over the documents. Windows and items have 128-bit SimHash fingerprints of their words; a multi-index of BLOCKS
blocks finds every item within RADIUS bits, since two such fingerprints differ in RADIUS // BLOCKS bits at most in one
block at least: a block's table holds an item under all values within half of that of its own, and a window asks for all
within the other half. Candidates are then verified
exactly: the weighted Jaccard similarity of their 5-word shingles, each weighing its count times ln(1 + items / items that
have it), must be THRESHOLD or more.

A window's similarity is at most the weight of its shingles that the benchmark has, by the item's weight; windows that
can't reach the threshold with any item of their size aren't fingerprinted. For items with more words than a document, the
whole document is the one window; it is compared exactly with each that it shares enough weight with. Items of fewer than
5 words are too short to tell a leak from chance inside a text; they are found where a document is nothing else. The
benchmark goes to the tasks in blocks of a bounded number of items, one pass over the documents each.

Nulls: a null text is empty, and an empty text has no window; a null doc_id stays null; items without item_id or words
aren't sought. Repeated rows are all searched; of items with one item_id, each is sought. Ties: of a document's windows
that are equally similar to an item the first is returned. Very long texts are searched whole. Empty tables give empty
results; further columns are ignored, `clean` keeps them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, row_slices, run_hashes, stored, text_bytes

SHINGLE = 5
THRESHOLD = 0.75
RADIUS, BLOCKS = 39, 8
#: Items, and their shingles, that go to the tasks at once.
ITEM_BLOCK = 2048

#: Word characters: ASCII letters and digits, and every byte of other characters.
_NO_WORD = np.ones(256, dtype=bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_FILTER_BITS = 22


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row) for slices of a text column."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in row_slices(offsets):
        part = offsets[a : b + 1]
        words = hash_words(data[part[0] : part[-1]], part - part[0], _NO_WORD)
        yield a, words.hash, words.before


def fingerprints(words: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every window of n words, as two 64-bit values: bit k is set where more of its words have it than not."""
    both = np.stack([words, mix(words ^ np.uint64(0xC3C3C3C3))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits((sums[n:] - sums[:-n]) > 0, axis=1).view(np.uint64)


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """(BLOCKS, prints): the 16-bit blocks of each fingerprint."""
    return np.ascontiguousarray(prints).view(np.uint16).T


def neighbours(bits: int) -> np.ndarray:
    """All differences of a block in so few bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class ItemIndex:
    """The items of one block by length: fingerprints, their multi-index, and weighted shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: dict[int, float], rare: float, radius: int) -> None:
        self.radius, self.weights, self.rare = radius, weights, rare
        #: Items too short for a shingle, by the hash of all their words.
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in items:
            if 0 < len(w) < SHINGLE:
                self.short[whole(w)].append((i, len(w)))
        items = [x for x in items if len(x[1]) >= SHINGLE]
        self.shingles = np.unique(np.concatenate([run_hashes(w, SHINGLE) for _, w in items])) if items else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.shingles & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.bags = [Counter(run_hashes(w, SHINGLE).tolist()) for _, w in items]
        self.totals = np.array([sum(weights.get(g, rare) * n for g, n in bag.items()) for bag in self.bags])
        self.lengths_of: dict[int, set[int]] = defaultdict(set)  # of the items that have a shingle
        self.items_of: dict[int, list[int]] = defaultdict(list)
        for i, (bag, (_, w)) in enumerate(zip(self.bags, items)):
            for g in bag:
                self.lengths_of[g].add(len(w))
                self.items_of[g].append(i)
        # By length: items, fingerprints and least total weight; the multi-index is made when a length is first met.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.lengths = lengths = np.array([len(w) for _, w in items])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            prints = np.concatenate([fingerprints(items[i][1], int(n)) for i in at])
            self.by_length[int(n)] = at, prints, self.totals[at].min()

    def index(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block its values, all those within half the block's bits of an item's among them, sorted, and whose they
        are."""
        if n not in self.tables:
            near, tables = neighbours((self.radius // BLOCKS + 1) // 2), []
            for block in blocks_of(self.by_length[n][1]):
                values = (block[:, None] ^ near).ravel()
                order = np.argsort(values, kind="stable")
                tables.append((values[order], order // len(near)))
            self.tables[n] = tables
        return self.tables[n]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions of the shingles that an item has."""
        at = np.flatnonzero(self.filter[grams & np.uint64((1 << _FILTER_BITS) - 1)])
        near = np.searchsorted(self.shingles, grams[at])
        return at[self.shingles[np.minimum(near, len(self.shingles) - 1)] == grams[at]] if len(at) else at

    def similarity(self, bag: Counter, item: int) -> float:
        own, both, either = self.bags[item], 0.0, 0.0
        for s in own.keys() | bag.keys():
            weight = self.weights.get(s, self.rare)
            a, b = own.get(s, 0), bag.get(s, 0)
            both += weight * min(a, b)
            either += weight * max(a, b)
        return both / either

    def near(self, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item's place, distance) of all fingerprints within the radius, nearest first."""
        prints, pairs = self.by_length[n][1], []
        asked = neighbours(self.radius // BLOCKS // 2)
        for block, (values, whose) in zip(blocks_of(found), self.index(n)):
            for at in range(0, len(block), 1024):  # windows whose values are looked up at once
                wanted = (block[at : at + 1024, None] ^ asked).ravel()
                low = np.searchsorted(values, wanted, side="left")
                count = np.searchsorted(values, wanted, side="right") - low
                if total := int(count.sum()):
                    own = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
                    pairs.append(np.unique(np.repeat(at + np.arange(len(wanted)) // len(asked), count) * len(prints) + whose[own]))
        pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        window, item = pair // len(prints), pair % len(prints)
        distance = np.bitwise_count(found[window] ^ prints[item]).sum(axis=1)
        order = np.lexsort((window, distance))
        order = order[distance[order] <= self.radius]
        return window[order], item[order], distance[order]

    def search(self, words: np.ndarray, hits: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each item found in one document."""
        grams = run_hashes(words, SHINGLE)
        best: dict[int, tuple[float, int]] = {}
        hits_of: dict[int, list[int]] = defaultdict(list)
        for at, g in zip(hits.tolist(), grams[hits].tolist()):
            for n in self.lengths_of[g]:
                hits_of[n].append(at)
        for n, own_hits in hits_of.items():
            if n > len(words):
                continue
            at, _, least = self.by_length[n]
            shared = np.zeros(len(words) + 1)  # weight before each word of shingles that items of n words have
            shared[np.array(own_hits) + 1] = [self.weights.get(g, self.rare) for g in grams[own_hits].tolist()]
            shared = np.cumsum(shared)
            # A window's similarity is its shared weight by the item's weight at most.
            within = shared[n - SHINGLE + 1 : len(words) - SHINGLE + 2] - shared[: len(words) - n + 1]
            starts = np.flatnonzero(within >= threshold * least * (1 - 1e-9))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                window, place, _ = self.near(fingerprints(words[run[0] : run[-1] + n], n), n)
                for w, k in zip(window.tolist(), place.tolist()):
                    start, item = int(run[0]) + w, int(at[k])
                    found = best.get(item, (0.0, 0))
                    if found[0] >= 1 or within[start] < threshold * self.totals[item] * (1 - 1e-9):
                        continue
                    value = self.similarity(Counter(grams[start : start + n - SHINGLE + 1].tolist()), item)
                    if value >= threshold and (value > found[0] or (value == found[0] and start < found[1])):
                        best[item] = value, start
        for item, value in self.longer(words, grams, hits, threshold):
            best[item] = value, 0
        for item, (value, start) in sorted(best.items()):
            yield int(self.ids[item]), start, min(int(self.lengths[item]), len(words)), value

    def longer(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, similarity) of the items with more words than the document, which is the only window for them."""
        if not len(self.lengths) or len(words) >= self.lengths.max():
            return
        found = grams[hits].tolist()
        weight = [self.weights.get(g, self.rare) for g in found]
        if sum(weight) < threshold * self.totals[self.lengths > len(words)].min() * (1 - 1e-9):
            return
        shared: dict[int, float] = defaultdict(float)
        for g, v in zip(found, weight):
            for item in self.items_of[g]:
                shared[item] += v
        bag = Counter(grams.tolist())
        for item, v in shared.items():
            if self.lengths[item] > len(words) and v >= threshold * self.totals[item] * (1 - 1e-9):
                value = self.similarity(bag, item)
                if value >= threshold:
                    yield item, value


def whole(words: np.ndarray) -> int:
    """A hash of a sequence of fewer words than a shingle has."""
    return int(run_hashes(words, len(words))[0]) + len(words)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, text, n (its words) and its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets = [], []
            for _, words, before in _words(batch.column(1)):
                for a, b in zip(before, before[1:]):
                    n.append(int(b - a))
                    sets.append(np.unique(run_hashes(words[a:b], SHINGLE)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "text", "n", "shingles"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, text string, n long, shingles array<long>").filter("n > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of a document for each item it leaks."""
    spark = docs.sparkSession
    items = stored(item_shingles(benchmark), "items")
    total = items.filter(F.col("n") >= SHINGLE).count()
    n_blocks = max(1, -(-items.count() // item_block))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    counts = items.select("block", F.explode("shingles").alias("shingle"))
    frequency = counts.groupBy("shingle").agg(F.count("*").alias("items"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    parts = []
    for b in range(n_blocks):
        mine = items.filter(F.col("block") == b)
        own = [(i, next(_words(pa.array([t])))[1]) for i, t in mine.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
        known = frequency.join(counts.filter(F.col("block") == b).select("shingle").distinct(), "shingle", "left_semi") if n_blocks > 1 else frequency
        weights = {s % 2**64: float(np.log1p(total / n)) for s, n in known.toLocalIterator()}
        index = spark.sparkContext.broadcast(ItemIndex(own, weights, float(np.log1p(total)), radius))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids, out = batch.column(0).to_pylist(), []
                for first, words, before in _words(batch.column(1)):
                    size = np.diff(before)
                    for r in np.flatnonzero((size > 0) & (size < SHINGLE)) if index.value.short else ():
                        out += [(doc_ids[first + r], i, 0, n, 1.0) for i, n in index.value.short.get(whole(words[before[r] : before[r + 1]]), ())]
                    hits = index.value.hits(run_hashes(words, SHINGLE))
                    row = np.searchsorted(before, hits, side="right") - 1
                    inside = hits + SHINGLE <= before[row + 1]
                    hits, row = hits[inside], row[inside]
                    for r in np.unique(row):
                        a, z = before[r], before[r + 1]
                        out += [(doc_ids[first + r], *m) for m in index.value.search(words[a:z], hits[row == r] - a, threshold)]
                columns = list(zip(*out)) if out else [[]] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
        parts.append(stored(found, "leaks") if n_blocks > 1 else found)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item; rows that are equal in doc_id and text share their fate."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, **options)
    leaks = stored(found.select(F.col("doc_id").alias("__key")).distinct(), "leaking")
    return docs.withColumn("__key", key).join(leaks, "__key", "left_anti").select(*docs.columns)
