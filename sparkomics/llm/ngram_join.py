"""Exact Jaccard join of word n-grams by prefixes under several global orders, down to components of linked documents.

A document's set holds its distinct runs of SHINGLE words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case); with fewer words,
all of them as one. Documents are linked at a similarity of THRESHOLD percent or more. Documents with one set form a
class, and only classes are compared. Classes are linked only if, under any order of all shingles, they share one of
the first n - ceil(threshold * n) + 1 of each. Three orders are used, and their filters are intersected before a set is
sent anywhere:

1. rare first: by the magnitude of a shingle's count, where it is frequent anywhere, then by a hash. The prefixes are
   dealt by shingle; classes that meet in a bucket and whose sizes and places allow the similarity are candidates.
2., 3. the shingles' hashes, ascending and descending. Candidates must share prefixes under both.

In between, candidates whose parity sketches differ in more bits than their sets may differ in shingles go; a sketch has
two bits or more for a shingle, and is folded where it meets a shorter one. What is left is verified by intersection.

The classes of a bucket are first compared with one of them, its centre: in small buckets the class with the smallest
hash, in those over SMALL_BUCKET the one with the fewest rarer shingles, which in a group of near copies is what the
copies were made from. When components are known, classes of a bucket that are still apart are compared; so no link
between components is lost, and no pairs are made within a component. In large buckets that is done in tiles of at most
TILE by TILE classes, by their sketches, and only pairs that pass leave a tile.

Nulls: a null text has an empty set; empty sets are linked with nothing, nor are rows without doc_id, whose component_id
is null. Rows that share a doc_id are documents of their own. Ties: none, components don't depend on order. Repeated
rows give a row each. Very long texts are one set. Empty tables give empty results; further columns are ignored,
`one_of_each` keeps them. Shingles and sets stand as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, row_slices, run_hashes, stored, text_bytes
from .components import components

SHINGLE = 5
THRESHOLD = 75
SMALL_BUCKET = 16
#: A shingle that so many documents of one slice of text have is counted as frequent.
FREQUENT = 4
#: Frequent shingles known to the tasks: the order needs no more to be right, only to be good.
FREQUENT_SHINGLES = 1 << 18
#: Parts of a frequent shingle's bucket, each with a centre of its own.
SALTS = 16
#: Sets of so many classes are picked out while the texts are read; more by a join.
BROADCAST_CLASSES = 4_000_000
#: Shared halves of hashes beyond the expected chance matches that may be chance.
SLACK = 4
#: Bits of a set's parity sketch for each shingle, and the least 64-bit words.
SKETCH_BITS, SKETCH_WORDS = 2, 4
#: Classes on each side of a tile.
TILE = 8192


def prefix_size(n, percent: int):
    """n - ceil(percent * n / 100) + 1, for numbers and arrays."""
    return n + (-percent * n) // 100 + 1


class Sets:
    """The sets of one slice of rows: shingles of row i are values[at[i]:at[i + 1]], ascending."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int) -> None:
        words = hash_words(data, offsets)
        grams, sets = run_hashes(words.hash, shingle), []
        before = words.before.tolist()
        for a, b in zip(before, before[1:]):
            if b - a >= shingle:
                sets.append(np.unique(grams[a : b - shingle + 1]))
            elif b > a:
                sets.append(run_hashes(words.hash[a:b], b - a) + np.uint64(b - a))
            else:
                sets.append(grams[:0])
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.values = np.concatenate(sets) if sets else grams[:0]
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def _sum(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def keys(self) -> np.ndarray:
        """A 64-bit key of each set, whatever the order of its shingles."""
        return mix(self._sum(mix(self.values)) + self.size.astype(np.uint64)).view(np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all sketches, words of each): every shingle turns one bit over, so that sets which differ in d
        shingles differ in d bits at most. A sketch's words are a power of two; its halves' difference is the sketch of
        half as many."""
        wanted = np.maximum(-(-self.size * SKETCH_BITS // 64), SKETCH_WORDS)
        width = np.int64(1) << np.ceil(np.log2(wanted)).astype(np.int64)
        start = np.cumsum(width) - width
        hashed, out = mix(self.values ^ np.uint64(0x5B5B5B5B)), np.zeros(int(width.sum()), dtype=np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // (64 * int(w)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                bit = np.concatenate([hashed[self.at[r] : self.at[r + 1]] for r in part]) & np.uint64(64 * w - 1)
                row = np.repeat(np.arange(len(part)), self.size[part])
                odd = np.bincount(row * (64 * w) + bit.astype(np.int64), minlength=len(part) * 64 * int(w)) & 1
                words = np.packbits(odd.astype(np.uint8).reshape(len(part), -1), axis=1).view(np.int64)
                out[(start[part][:, None] + np.arange(w)).ravel()] = words.ravel()
        return out, width


def _each_slice(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, Sets]]:
    """(doc_ids, sets) of slices of rows of doc_id, text; only rows with a doc_id."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in row_slices(offsets):
            part = offsets[a : b + 1]
            yield ids[a:b], Sets(data[part[0] : part[-1]], part - part[0], shingle)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame, shingle: int) -> DataFrame:
    """frequent false: id = doc_id, n, class, sketch of every row with a doc_id; true: id = a shingle frequent in a slice,
    n = its documents there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_slice(batches, shingle):
            words, width = sets.sketches()
            bits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(words))
            yield _batch(frequent=np.zeros(len(ids), bool), id=ids.astype(np.int64), n=sets.size, **{"class": sets.keys()}, sketch=bits)
            value, count = np.unique(sets.values, return_counts=True)
            often = count >= FREQUENT
            yield _batch(frequent=np.ones(often.sum(), bool), id=value[often].view(np.int64), n=count[often], **{"class": np.zeros(often.sum(), np.int64)}, sketch=pa.nulls(int(often.sum()), pa.list_(pa.int64())))

    return _rows(docs).filter("doc_id IS NOT NULL").mapInArrow(run, "frequent boolean, id long, n long, class long, sketch array<long>")


def frequent_shingles(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and the magnitudes of their counts: at most FREQUENT_SHINGLES, the most frequent."""
    counts = scanned.filter("frequent").groupBy("id").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "id").limit(FREQUENT_SHINGLES).toArrow()
    value = top["id"].to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], np.log2(top["n"].to_numpy()[order]).astype(np.uint64) if len(value) else np.zeros(0, np.uint64)


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int, percent: int) -> DataFrame:
    """shingle, salt, class, n, place: the rare-first prefix of every set, once for a slice of rows; the salt is -1 where
    the shingle isn't known as frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, magnitude = shared.value
        for _, sets in _each_slice(batches, shingle):
            keys = sets.keys()
            order_key = mix(sets.values ^ np.uint64(0xA5A5A5A5)) >> np.uint64(6)
            hot = np.zeros(len(sets.values), dtype=bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, sets.values), len(known) - 1)
                hot = known[at] == sets.values
                order_key |= np.where(hot, magnitude[at] + np.uint64(1), np.uint64(0)) << np.uint64(58)
            _, first = np.unique(keys, return_index=True)
            picked, place, row = [], [], []
            for r in first[sets.size[first] > 0].tolist():
                a, b = sets.at[r], sets.at[r + 1]
                take = np.argsort(order_key[a:b])[: prefix_size(int(b - a), percent)]
                picked.append(take + a)
                place.append(np.arange(len(take)))
                row.append(np.full(len(take), r))
            if picked:
                picked, place, row = (np.concatenate(x) for x in (picked, place, row))
                salt = np.where(hot[picked], keys[row] % SALTS, -1)
                yield _batch(shingle=sets.values[picked].view(np.int64), salt=salt.astype(np.int8), **{"class": keys[row]}, n=sets.size[row].astype(np.int32), place=place.astype(np.int32))

    return _rows(docs).filter("doc_id IS NOT NULL").mapInArrow(run, "shingle long, salt byte, class long, n int, place int")


def _can_reach(n_a, n_b, place_a, place_b, percent: int, least):
    """Whether sizes and places in the prefixes allow the similarity; of numbers, or of columns with F.least.

    It holds for the first shingle that two similar sets share: all others that they share follow it in both.
    """
    smaller, rest = least(n_a, n_b), least(n_a - place_a, n_b - place_b)
    return (100 * smaller >= percent * (n_a + n_b - smaller)) & ((100 + percent) * rest >= percent * (n_a + n_b))


def meetings(prefix: DataFrame, percent: int, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """a, b: candidate classes; with b null, a is in a bucket of three or more of `shingle`, with its n and place.

    Rows come sorted by bucket and place; no more than `small_bucket` of one are held at once. Buckets of frequent
    shingles are salted and always count as large.
    """
    schema = "a long, b long, shingle long, n int, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, large = (0, 0), [], False
        out: list[tuple] = []
        seen: set[tuple[int, int]] = set()

        def pair(x: tuple, y: tuple) -> None:
            both = (x[0], y[0]) if x[0] < y[0] else (y[0], x[0])
            if both not in seen and _can_reach(x[1], y[1], x[2], y[2], percent, min):
                seen.add(both)
                out.append((*both, None, None, None))

        def member(x: tuple) -> None:
            out.append((x[0], None, bucket[0], x[1], x[2]))

        def finish() -> None:
            """A small bucket's end: all are candidates with the class of the smallest key, which similar buckets share."""
            if not large and len(held) > 1:
                centre = min(held)
                for x in held:
                    if x is not centre:
                        pair(centre, x)
                    if len(held) > 2:
                        member(x)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            if len(seen) > 500_000:
                seen.clear()
            types = [pa.int64()] * 3 + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "shingle", "n", "place"])

        for batch in batches:
            shingle, salt, cls, n, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            edge = np.ones(len(shingle) + 1, dtype=bool)
            edge[1:-1] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
            runs = np.flatnonzero(edge)
            use = (np.diff(runs) > 1) | (salt[runs[:-1]] >= 0)
            use[:1] = use[-1:] = True  # may go on in another batch
            for a, b in zip(runs[:-1][use].tolist(), runs[1:][use].tolist()):
                now = (int(shingle[a]), int(salt[a]))
                if now != bucket:
                    finish()
                    bucket, held, large = now, [], now[1] >= 0
                last = held[-1][0] if held else None
                for x in zip(cls[a:b].tolist(), n[a:b].tolist(), place[a:b].tolist()):
                    if x[0] == last:
                        continue
                    last = x[0]
                    if not large and len(held) == small_bucket:
                        large = True
                        for y in held:
                            member(y)
                            if y is not held[0]:
                                pair(held[0], y)
                        del held[1:]
                    if large:
                        member(x)
                        if not held:
                            held = [x]
                        elif x[0] != held[0][0]:
                            pair(held[0], x)
                    else:
                        held.append(x)
            yield rows()
        finish()
        yield rows()

    dealt = prefix.repartition("shingle", "salt")
    return dealt.sortWithinPartitions("shingle", "salt", "place", "class").mapInArrow(run, schema)


def class_sets(docs: DataFrame, wanted: DataFrame, info: DataFrame, shingle: int, percent: int, bits: int = 64) -> DataFrame:
    """class, n, first, rest, last of the `wanted` classes, each from the rows of its smallest doc_id: its shingles (the
    first 32 or all 64 bits), `first` and `last` being the prefixes of the ascending and the descending order, which may
    overlap."""
    owners = stored(info.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")), "owners")
    few = owners.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    local = owners.toArrow().sort_by("class") if few else None
    picked = docs.sparkSession.sparkContext.broadcast((local["class"].to_numpy(), local["id"].to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_slice(batches, shingle):
            keys = sets.keys()
            rows = np.flatnonzero(sets.size)
            if picked.value is not None:
                classes, owner = picked.value
                at = np.minimum(np.searchsorted(classes, keys[rows]), len(classes) - 1) if len(classes) else rows[:0]
                rows = rows[(classes[at] == keys[rows]) & (owner[at] == ids[rows])] if len(classes) else rows[:0]
            size = sets.size[rows]
            ends = prefix_size(size, percent)
            parts = []
            for begin, end in ((0 * size, ends), (ends, size - ends), (size - ends, size)):
                n = np.maximum(end - begin, 0)
                index = np.repeat(sets.at[rows] + begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                values = sets.values[index].view(np.int64)
                values = (values >> 32).astype(np.int32) if bits == 32 else values
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values)))
            yield _batch(**{"class": keys[rows]}, id=ids[rows].astype(np.int64), n=size, first=parts[0], rest=parts[1], last=parts[2])

    kind = "int" if bits == 32 else "long"
    found = _rows(docs).filter("doc_id IS NOT NULL").mapInArrow(run, f"class long, id long, n long, first array<{kind}>, rest array<{kind}>, last array<{kind}>")
    return stored((found if few else found.join(owners, ["class", "id"], "left_semi")).drop("id"), "sets")


def _classes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def _both(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The pairs with columns of both classes' rows in `table`, suffixed."""
    side = lambda c: table.select(F.col("class").alias(c), *[F.expr(v).alias(f"{k}_{c}") for k, v in columns.items()])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def folds(percent: int) -> int:
    """How often a sketch is folded at most to meet that of a set which can be similar."""
    return int(np.ceil(np.log2(100 / percent)))


def within_sketches(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose sketches differ in no more bits than similar sets can differ in shingles."""
    one = info.join(_classes(pairs), "class", "left_semi").dropDuplicates(["class"])
    both = _both(pairs, one, {"n": "n", "bits": "sketch"})
    for _ in range(folds(percent)):
        for c, d in ("ab", "ba"):
            half = f"CAST(size(bits_{c}) / 2 AS INT)"
            folded = f"zip_with(slice(bits_{c}, 1, {half}), slice(bits_{c}, {half} + 1, {half}), (x, y) -> x ^ y)"
            both = both.withColumn(f"bits_{c}", F.expr(f"IF(size(bits_{c}) > size(bits_{d}), {folded}, bits_{c})"))
    differ = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return both.filter((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def within_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that share prefixes under both orders of hashes; only prefixes are read of the sets."""
    both = _both(pairs, sets, {"first": "first", "last": "last"})
    return both.filter(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("last_a", "last_b")).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame, percent: int, slack: Column) -> DataFrame:
    """a, b, sure: the pairs that are similar enough, give or take `slack` shared shingles; sure if so without them."""
    both = _both(pairs, sets, {"n": "n", "set": "concat(first, rest, last)"})
    enough = lambda x: 100 * x >= percent * (F.col("n_a") + F.col("n_b") - x)
    told = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b"))).withColumn("slack", slack).filter(enough(F.col("shared") + F.col("slack")))
    return told.select("a", "b", enough(F.col("shared") - F.col("slack")).alias("sure")).distinct()


def verified(docs: DataFrame, close: DataFrame, info: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: those of the pairs that are similar enough. Sets are compared by halves of their hashes first; pairs that
    chance matches of halves could decide, SLACK more than eight times as many as expected, are compared by all bits."""
    sets = class_sets(docs, _classes(close), info, shingle, percent, 32)
    close = stored(within_orders(close, sets), "candidates")
    chance = F.lit(SLACK) + F.ceil(8.0 * F.col("n_a") * F.col("n_b") / 2.0**32)
    rough = stored(compared(close, sets, percent, chance), "compared")
    open_pairs = rough.filter("NOT sure").select("a", "b")
    sure = rough.filter("sure").select("a", "b")
    if not open_pairs.limit(1).count():
        return sure
    exact = class_sets(docs, _classes(open_pairs), info, shingle, percent)
    return sure.unionByName(compared(open_pairs, exact, percent, F.lit(0)).select("a", "b"))


def tiles(members: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components in one tile whose sizes, places and sketches allow a link.

    `members` are rows of shingle, i, j (the tile), a, n, place, component, main (of the bucket's largest component),
    own (of the tile's first side), sketch. Rows of `main` are never on the first side.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, n, place, component, main, own = (rows.column(c).to_numpy() for c in ("a", "n", "place", "component", "main", "own"))
        sketch = rows.column("sketch").combine_chunks()
        width, bits = sketch.value_lengths().to_numpy(), sketch.flatten().to_numpy().view(np.uint64)
        start = np.cumsum(width) - width
        # By the words of the sketches compared: rows of the second side, and their sketches folded to that.
        sides: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero((width == w) & ~own)
            words = bits[start[at][:, None] + np.arange(w)]
            for _ in range(folds(percent) + 1):
                sides[w, words.shape[1]] = at, words
                words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
        for x in np.flatnonzero(own).tolist():
            mine = bits[start[x] : start[x] + width[x]]
            for _ in range(folds(percent) + 1):
                for (w, k), (at, words) in sides.items():
                    # Each pair once: where neither sketch is folded more than it has to be.
                    if k != len(mine) or k != min(w, width[x]):
                        continue
                    can = _can_reach(n[x], n[at], place[x], place[at], percent, np.minimum)
                    can &= (component[at] != component[x]) & (main[at] | (a[at] > a[x]))
                    y, near = at[can], words[can]
                    differ = np.bitwise_count(near ^ mine).sum(axis=1, dtype=np.int64)
                    y = y[(100 + percent) * differ <= (100 - percent) * (n[x] + n[y])]
                    if len(y):
                        yield _batch(a=np.minimum(a[x], a[y]), b=np.maximum(a[x], a[y]))
                mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if end > start:
                    if tile != (now := tuple(key[:, start].tolist())) and held:
                        yield from compare(pa.Table.from_batches(held))
                        held = []
                    tile = now
                    held.append(batch.slice(start, end - start))
        if held:
            yield from compare(pa.Table.from_batches(held))

    columns = ["shingle", "i", "j", "a", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "component", "main", "own", "sketch"]
    dealt = members.select(*columns).repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def apart(members: DataFrame, labels: DataFrame, info: DataFrame, percent: int, small_bucket: int = SMALL_BUCKET, tile: int = TILE) -> DataFrame:
    """a, b: classes of one bucket that are in different components and close by sizes, places and sketches.

    The classes of a bucket's largest component are only compared with the others.
    """
    own = F.coalesce("component", "a").alias("component")
    told = members.join(labels.withColumnRenamed("node", "a"), "a", "left").select("shingle", "a", "n", "place", own)
    told = stored(told, "members")
    sizes = told.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("size"), F.count("*").alias("parts")).filter("parts > 1")
    told = stored(told.join(most.select("shingle", "size", F.col("most.component").alias("largest")), "shingle").withColumn("main", F.expr("component = largest")), "apart")
    small, large = told.filter(F.col("size") <= small_bucket), told.filter(F.col("size") > small_bucket)
    other = small.select("shingle", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"), F.col("main").alias("main_b"))
    met = small.filter("NOT main").join(other, "shingle").filter("component != component_b AND (main_b OR a < b)")
    met = met.filter(_can_reach(F.col("n"), F.col("n_b"), F.col("place"), F.col("place_b"), percent, F.least))
    met = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    close = within_sketches(met, info, percent)
    if not large.limit(1).count():
        return close
    sketch = info.join(large.select(F.col("a").alias("class")).distinct(), "class", "left_semi").groupBy("class").agg(F.first("sketch").alias("sketch"))
    blocks = F.ceil(F.col("size") / tile).cast("int")
    block, every = F.pmod(F.xxhash64("a"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    rows = large.join(sketch.withColumnRenamed("class", "a"), "a").withColumn("own", F.explode(F.expr("IF(main, array(false), array(false, true))")))
    rows = rows.withColumn("k", F.explode(every)).withColumn("i", F.when(F.col("own"), block).otherwise(F.col("k"))).withColumn("j", F.when(F.col("own"), F.col("k")).otherwise(block))
    return close.unionByName(tiles(rows, percent)).distinct()


def linked(docs: DataFrame, percent: int = THRESHOLD, shingle: int = SHINGLE, small_bucket: int = SMALL_BUCKET, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(info, labels): id, n, class of every row with a doc_id; node, component of every class with a link."""
    scanned = stored(scan(docs, shingle), "scan")
    info = scanned.filter("NOT frequent").select("id", "n", "class", "sketch")
    prefix = prefixes(docs, frequent_shingles(scanned), shingle, percent)
    met = stored(meetings(prefix, percent, small_bucket), "meetings")
    pairs = stored(met.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    members = met.filter("b IS NULL").select("shingle", "a", "n", "place").distinct()

    def links(close: DataFrame) -> DataFrame:
        return stored(verified(docs, close, info, shingle, percent), "links")

    edges = links(stored(within_sketches(pairs, info, percent), "close"))
    labels = stored(components(edges), "labels")
    later = stored(apart(members, labels, info, percent, small_bucket, tile), "pairs")
    if later.limit(1).count():
        labels = stored(joined_labels(labels, links(later)), "labels")
    return info, labels


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after further edges, which join whole components."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = stored(components(between.filter("a != b").distinct()), "merged").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    grown = labels.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    # Classes without a label so far are components of their own.
    new = merged.join(labels.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("merged").alias("component"))
    return grown.unionByName(new)


def joined(docs: DataFrame, percent: int = THRESHOLD, shingle: int = SHINGLE, small_bucket: int = SMALL_BUCKET, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    info, labels = linked(docs, percent, shingle, small_bucket, tile)
    owners = info.filter("n > 0").groupBy("class").agg(F.min("id").alias("owner"), F.count("*").alias("copies"))
    label = owners.join(labels.withColumnRenamed("node", "class"), "class", "left").filter("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "class"))
    least = label.groupBy("component").agg(F.min("owner").alias("component_id"))
    grouped = label.join(least, "component").select("class", "component_id")
    linked_rows = info.drop("sketch").join(grouped, "class", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    rest = scan(docs.filter("doc_id IS NULL").withColumn("doc_id", F.lit(0)), shingle).filter("NOT frequent")
    null = F.lit(None).cast("long")
    return linked_rows.unionByName(rest.select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The documents whose doc_id is its component's smallest, and rows without doc_id."""
    kept = joined(docs, percent, shingle).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id IS NULL").unionByName(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))
