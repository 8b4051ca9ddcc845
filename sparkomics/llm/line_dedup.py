"""Line dedup by a segment-partition edit join.

Lines count without white space around them (space, tab, CR, VT, FF). A line of MIN_CHARS characters or more goes where
it has stood before (in an earlier document, or further up in the same), and everywhere if an earlier line is within
`threshold` edits of it. A different line is earlier if the smallest doc_id that holds it is smaller, or of lines with the
same one, if it is smaller itself. Shorter lines repeat by chance, so that they go only where the very same line has stood
before, and only if COMMON documents or more hold it; blank lines stay.

The join splits each line into threshold + 1 segments. A line within the threshold of it and at least as long holds one
of them unchanged, near its place; so lines meet over hashes of (length, segment, substring), with the places that
length and segment still allow. Where many lines share a segment, as those of one template do, what is left of the lines
is within the threshold too: it is split the same way, and they meet over both segments, and so on until buckets are
small or little is left. Pairs that meet must have close counts of several letters, and are verified by banded
bit-parallel edit distance. DataFrame operations only.

Nulls: a null text is empty. Rows with one doc_id, null among them, are one document here: a line that several of them
hold first stays in each. Null doc_ids come last. Repeated rows are treated alike. Very long lines are compared whole.
Empty tables give empty results; further columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

THRESHOLD = 1
MIN_CHARS = 20
#: So many documents hold a short line that is dropped.
COMMON = 10

#: Letters whose counts in two lines differ by the threshold at most.
LETTERS = "etna"
#: Lines of so many candidate pairs are picked out by a broadcast of their hashes; more by a join.
BROADCAST_LINES = 500_000
#: Pairs that one task verifies where the lines are broadcast, as far as there are tasks enough: a pair is a few bytes, but
#: takes milliseconds, so that splits by size would be too large.
TASK_PAIRS = 1_000
#: Segments of more lines than this are joined by what is left of the lines, too.
HOT = 64
#: So often at most; then all but a part in 2 ** (DEPTH + 1) of two lines is equal, with one edit.
DEPTH = 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def line_key(line: Column) -> list[Column]:
    """Two hashes that stand for a line."""
    return [F.xxhash64(line).alias("h"), F.crc32(line.cast("binary")).alias("c")]


def document_key(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_h"), F.crc32(text.cast("binary")).alias("text_c")]


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, line, h, c: the lines that are compared, each once a document."""
    lines = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), bare), lambda x: F.length(x) >= min_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.explode(lines).alias("line"))
    return rows.select("doc", "line", *line_key(F.col("line")))


def distinct_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, c, first_doc, n (documents that hold it), letters (their counts, packed), index and probe (keys) of each line.

    What the join needs of a line is made where the line is read; its text isn't shuffled.
    """
    rows = long_lines(docs, min_chars).withColumn("size", F.length("line")).withColumn("letters", letter_counts(F.col("line")))
    index, probe = index_keys(F.col("line"), F.col("size"), threshold), probe_keys(F.col("line"), F.col("size"), threshold)
    keys = {f"i{k}": c for k, c in enumerate(index)} | {f"p{k}": c for k, c in enumerate(probe)}
    rows = rows.select("h", "c", "doc", "letters", *[c.alias(k) for k, c in keys.items()])
    one = rows.groupBy("h", "c").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n"), F.min("letters").alias("letters"), *[F.min(k).alias(k) for k in keys])
    listed = lambda p: F.array_compact(F.array(*[k for k in keys if k[0] == p]))
    return one.select("h", "c", "first_doc", "n", "letters", listed("i").alias("index"), listed("p").alias("probe"))


def _segment(size: Column, i: int, segments: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of a line of that size: the last segments take what doesn't divide evenly."""
    short = F.floor(size / segments)
    longer = size - short * segments  # so many segments at the end have one more
    extra = F.greatest(F.lit(i) - (segments - longer), F.lit(0))
    return short * i + extra, short + F.when(F.lit(i) >= segments - longer, 1).otherwise(0)


Part = tuple[Column, int, Column, Column]
"""The size of the line that is looked for, its segment's number, and where that stands here: start from 0, length."""


def index_parts(size: Column, threshold: int) -> list[Part]:
    return [(size, i, *_segment(size, i, threshold + 1)) for i in range(threshold + 1)]


def probe_parts(size: Column, threshold: int) -> list[Part]:
    """All substrings that a segment of a line as long or up to `threshold` shorter can equal."""
    parts = []
    for shorter in range(threshold + 1):
        target = size - shorter
        for i in range(threshold + 1):
            start, length = _segment(target, i, threshold + 1)
            # Errors before the segment are at most i seen from the left, at most threshold - i seen from the right.
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1):
                parts.append((target, i, start + shift, length))
    return parts


def part_key(line: Column, size: Column, part: Part, *bucket: Column) -> Column:
    """The key of a part, in a bucket if there is one; null if the line doesn't reach so far."""
    target, i, start, length = part
    key = F.xxhash64(*bucket, target.cast("long"), F.lit(i), F.substr(line, (start + 1).cast("int"), length.cast("int")))
    return F.when((start >= 0) & (length >= 0) & (start + length <= size), key)


def rest_of(line: Column, size: Column, part: Part) -> Column:
    """The line without a part."""
    _, _, start, length = part
    after = start + length
    return F.concat(F.substr(line, F.lit(1), start.cast("int")), F.substr(line, (after + 1).cast("int"), (size - after).cast("int")))


def index_keys(line: Column, size: Column, threshold: int) -> list[Column]:
    return [part_key(line, size, part) for part in index_parts(size, threshold)]


def probe_keys(line: Column, size: Column, threshold: int) -> list[Column]:
    return [part_key(line, size, part) for part in probe_parts(size, threshold)]


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS, 15 bits each."""
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(F.least(n, F.lit(32767)).cast("long"), 15 * k))
    return packed


def _close_counts(a: Column, b: Column, threshold: int) -> Column:
    part = lambda x, k: F.shiftright(x, 15 * k).bitwiseAND(F.lit(32767))
    close = F.lit(True)
    for k in range(len(LETTERS)):
        close = close & (F.abs(part(a, k) - part(b, k)) <= threshold)
    return close


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two arrays of characters are within `threshold` edits: a band of 2 * threshold + 1 diagonals whose
    vertical differences are the bits of two integers, moved one column at a time.

    The distance is followed down the band's lowest diagonal to a's last row, then along that row.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    n, m = F.size(a), F.size(b)
    bits = lambda v: F.lit(v).cast("long")

    def match(j: Column) -> Column:
        out = bits(0)
        for k in range(width):  # row j - threshold + k
            same = F.get(a, j - threshold + k).eqNullSafe(F.get(b, j)) & (j - threshold + k >= 0)
            out = out.bitwiseOR(F.when(same, bits(1 << k)).otherwise(bits(0)))
        return out

    def column(s: Column, j: Column) -> Column:
        """The differences of column j, from those of the column before."""
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match(j).alias("x"), j.alias("j"))

    def diagonal(s: Column) -> Column:
        x, vp, vn = s["x"], s["vp"], s["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(bits(full))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), d0.alias("d0"), s["j"].alias("j"))

    def move(s: Column) -> Column:
        d0, vp, vn, j = s["d0"], s["vp"], s["vn"], s["j"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(bits(full))
        hn = d0.bitwiseAND(vp)
        return F.struct(d0.alias("d0"), hp.alias("hp"), hn.alias("hn"), s["d"].alias("d"), j.alias("j"))

    def score(s: Column) -> Column:
        d0, hp, hn, j = s["d0"], s["hp"], s["hn"], s["j"]
        down = F.when(F.shiftright(d0, width - 1).bitwiseAND(bits(1)) == 0, 1).otherwise(0)
        # a's last row, n - 1, is row j - threshold + k of the band.
        k = (n - 1 - j + threshold).cast("int")
        row = lambda v: F.call_function("shiftright", v, F.greatest(k, F.lit(0))).bitwiseAND(bits(1)).cast("int")
        d = s["d"] + F.when(j < n - threshold, down).otherwise(row(hp) - row(hn))
        right = F.shiftright(d0, 1)
        vp = hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp))).bitwiseAND(bits(full))
        return F.struct(vp.alias("vp"), right.bitwiseAND(hp).alias("vn"), d.alias("d"))

    step = lambda s, j: F.element_at(F.transform(F.transform(F.transform(F.array(column(s, j)), diagonal), move), score), 1)
    begin = F.struct(bits((full << threshold) & full).alias("vp"), bits(0).alias("vn"), F.least(n, F.lit(threshold)).alias("d"))
    distance = F.aggregate(F.sequence(F.lit(0), m - 1), begin, step)["d"]
    return F.when(F.abs(n - m) > threshold, False).when((n == 0) | (m == 0), F.greatest(n, m) <= threshold).otherwise(distance <= threshold)


def _picked(df: DataFrame, wanted: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is, or isn't, in a stored table, which is broadcast if it is small."""
    few = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    return df.join(F.broadcast(wanted) if few else wanted, on, how)


def line_texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """h, c, line, first_doc of the lines wanted (h, c; stored)."""
    return _picked(long_lines(docs, min_chars), wanted, ["h", "c"]).groupBy("h", "c", "line").agg(F.min("doc").alias("first_doc"))


def _entries(rows: DataFrame, threshold: int, bucket: str | None = None) -> DataFrame:
    """key, probe (whether it is one), h, c, letters, rest: the parts of each row's `line`, as index and as probe; in a
    bucket only as what the row is there."""
    line, size = F.col("line"), F.length("line")
    within_bucket = [F.col(bucket)] if bucket else []

    def entries(parts: list[Part], probe: bool) -> DataFrame:
        told = [F.struct(part_key(line, size, p, *within_bucket).alias("key"), rest_of(line, size, p).alias("rest")) for p in parts]
        own = rows.filter(F.col("probe") == probe) if bucket else rows
        return own.select("h", "c", "letters", F.lit(probe).alias("probe"), F.explode(F.array(*told)).alias("x"))

    both = entries(index_parts(size, threshold), False).unionByName(entries(probe_parts(size, threshold), True))
    return both.select("x.key", "probe", "h", "c", "letters", "x.rest").filter("key IS NOT NULL")


def hot_keys(index: DataFrame, hot: int = HOT) -> DataFrame:
    return index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key")


def _meet(index: DataFrame, probe: DataFrame, threshold: int) -> DataFrame:
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("h", "c", "letters")])
    other = (F.col("a_h") != F.col("b_h")) | (F.col("a_c") != F.col("b_c"))
    near = _close_counts(F.col("a_letters"), F.col("b_letters"), threshold)
    return side(index, "a").join(side(probe, "b"), "key").filter(other & near).drop("key")


def candidates(docs: DataFrame, lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """a_h, a_c, b_h, b_c of lines that meet, more than once maybe. `lines` are the documents' distinct lines, stored.

    Where segments are split, what meets at each level is stored: the joins of all levels in one query would be planned,
    compiled and started at once, which takes the driver's memory.
    """
    side = lambda name: lines.select(F.explode(name).alias("key"), "h", "c", "letters")
    index, probe = side("index"), side("probe")
    keys = stored(hot_keys(index, hot), "hot-segments")
    if keys.isEmpty():
        return _meet(index, probe, threshold)
    met = stored(_meet(_picked(index, keys, ["key"], "left_anti"), probe, threshold), "met")
    both = lines.select("h", "c", F.explode(F.concat("index", "probe")).alias("key"))
    wanted = stored(_picked(both, keys, ["key"]).select("h", "c").distinct(), "hot-lines")
    texts = line_texts(docs, wanted, min_chars).withColumn("letters", letter_counts(F.col("line")))
    rows = _picked(_entries(texts, threshold), keys, ["key"])
    for level in range(1, depth + 1):
        # Each row is a line in a hot bucket; what is left of it is the line now.
        rows = stored(rows.withColumnsRenamed({"key": "bucket", "rest": "line"}), f"hot-rests-{level}")
        entries = _entries(rows, threshold, "bucket")
        index, probe = entries.filter("NOT probe"), entries.filter("probe")
        keys = stored(hot_keys(index, hot), f"hot-segments-{level}")
        if level == depth or keys.isEmpty():
            return met.unionByName(stored(_meet(index, probe, threshold), f"met-{level}"))
        met = met.unionByName(stored(_meet(_picked(index, keys, ["key"], "left_anti"), probe, threshold), f"met-{level}"))
        rows = _picked(entries, keys, ["key"])
    return met


def edit_pairs(docs: DataFrame, lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """a_h, a_c, b_h, b_c: pairs of different lines within the threshold, a before b. `lines` are the documents' distinct
    lines, stored."""
    met = candidates(docs, lines, threshold, min_chars, hot)
    # Lines of one length meet both ways; which of them is earlier is only known with the lines.
    one = F.struct("a_h", "a_c") < F.struct("b_h", "b_c")
    pairs = met.select(
        F.when(one, F.col("a_h")).otherwise(F.col("b_h")).alias("a_h"),
        F.when(one, F.col("a_c")).otherwise(F.col("b_c")).alias("a_c"),
        F.when(one, F.col("b_h")).otherwise(F.col("a_h")).alias("b_h"),
        F.when(one, F.col("b_c")).otherwise(F.col("a_c")).alias("b_c"),
    ).distinct()
    pairs = stored(pairs, "line-pairs")
    wanted = pairs.select(F.col("a_h").alias("h"), F.col("a_c").alias("c")).union(pairs.select("b_h", "b_c")).distinct()
    wanted = stored(wanted, "pair-keys")
    texts = stored(line_texts(docs, wanted, min_chars), "pair-lines")
    side = lambda p: texts.select(F.col("h").alias(f"{p}_h"), F.col("c").alias(f"{p}_c"), F.col("first_doc").alias(f"{p}_doc"), F.split("line", "").alias(p), F.col("line").alias(f"{p}_line"))
    tasks = min(-(-pairs.count() // TASK_PAIRS), 8 * docs.sparkSession.sparkContext.defaultParallelism)
    both = pairs.repartition(max(tasks, 1)).join(side("a"), ["a_h", "a_c"]).join(side("b"), ["b_h", "b_c"])
    close = both.filter(within(F.col("a"), F.col("b"), threshold))
    order = lambda p: F.struct(F.col(f"{p}_doc").isNull(), F.coalesce(f"{p}_doc", F.lit(0)), f"{p}_line")
    first = order("a") < order("b")
    pick = lambda name: [F.when(first, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}")).alias(f"a_{name}"), F.when(first, F.col(f"b_{name}")).otherwise(F.col(f"a_{name}")).alias(f"b_{name}")]
    return close.select(*pick("h"), *pick("c"))


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """h, c, first_doc of the short lines that so many documents hold."""
    lines = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), bare), lambda x: F.length(x).between(1, min_chars - 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.explode(lines).alias("line")).select("doc", *line_key(F.col("line")))
    return rows.groupBy("h", "c").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).filter(F.col("n") >= common).drop("n")


def decisions(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """doc, text_h, text_c (the document's key) and keep: a flag for each line of its text."""
    lines = stored(distinct_lines(docs, threshold, min_chars), "lines")
    near = edit_pairs(docs, lines, threshold, min_chars).select(F.col("b_h").alias("h"), F.col("b_c").alias("c")).distinct().withColumn("near", F.lit(True))
    told = lines.select("h", "c", "first_doc", "n").join(near, ["h", "c"], "left").filter("n > 1 OR near").select("h", "c", "first_doc", F.coalesce("near", F.lit(False)).alias("near"))
    told = told.unionByName(common_lines(docs, min_chars, common).withColumn("near", F.lit(False)))
    rows = docs.select(*document_key(docs), F.posexplode(F.transform(lines_of(F.col("text")), bare)).alias("i", "line"))
    long, some = F.length("line") >= min_chars, F.length("line") > 0
    # Blank lines meet nothing, and each in another place.
    h, c = line_key(F.col("line"))
    rows = rows.select("doc", "text_h", "text_c", "i", long.alias("long"), F.when(some, h).otherwise(F.xxhash64("text_h", "i")).alias("h"), F.when(some, c).otherwise(-1).alias("c"))
    found = rows.join(told, ["h", "c"], "left")
    here = F.col("first_doc").eqNullSafe(F.col("doc"))
    keep = F.when(F.col("near").isNull(), True).otherwise(~F.col("near") & here)
    once = F.col("long") | F.col("near").isNotNull()  # stands once in a text
    found = found.select("doc", "text_h", "text_c", F.struct("h", "c", "i", once.alias("once"), keep.alias("keep")).alias("x"))
    by_line = F.sort_array(F.collect_set("x"))
    again = lambda a, x, k: (k > 0) & x["once"] & (F.get(a, k - 1)["h"] == x["h"]) & (F.get(a, k - 1)["c"] == x["c"])
    grouped = found.groupBy("doc", "text_h", "text_c").agg(by_line.alias("xs"))
    flags = F.sort_array(F.transform("xs", lambda x, k: F.struct(x["i"].alias("i"), (x["keep"] & ~again(F.col("xs"), x, k)).alias("keep"))))
    return grouped.select("doc", "text_h", "text_c", flags.alias("lines"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped: the numbers of the lines that go, from 0, comma-joined; of each document.

    Rows that are equal in doc_id and text give one row.
    """
    dropped = F.filter("lines", lambda x: ~x["keep"])
    numbers = F.array_join(F.transform(dropped, lambda x: x["i"].cast("string")), ",")
    return decisions(docs, threshold, min_chars, common).select(F.col("doc").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), numbers.alias("dropped"))


def copies(docs: DataFrame) -> DataFrame:
    """doc, text_h, text_c of the documents whose whole text an earlier one has, character for character."""
    keys = docs.select(*document_key(docs)).distinct()
    first = keys.groupBy("text_h", "text_c").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")
    return keys.join(first, ["text_h", "text_c"]).filter(~F.col("doc").eqNullSafe(F.col("first_doc"))).select("doc", "text_h", "text_c")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """The documents with the lines that stay; n_chars, if there, follows. Documents that lose lines go if nothing but
    white space is left of them, or if an earlier document has the very same text."""
    told = decisions(docs, threshold, min_chars, common).withColumnsRenamed({"doc": "__doc", "text_h": "__h", "text_c": "__c", "lines": "__lines"})
    again = copies(docs).select(F.col("doc").alias("__copy_doc"), F.col("text_h").alias("__copy_h"), F.col("text_c").alias("__copy_c"))
    doc, text_h, text_c = document_key(docs)
    own = docs.withColumn("__own", F.struct(doc, text_h, text_c))
    same = lambda d, h, c: own["__own"]["doc"].eqNullSafe(F.col(d)) & (own["__own"]["text_h"] == F.col(h)) & (own["__own"]["text_c"] == F.col(c))
    text = F.array_join(F.filter(lines_of(F.col("text")), lambda _, i: F.get("__lines", i)["keep"]), "\n")
    gone = F.exists("__lines", lambda x: ~x["keep"]) & (F.col("__copy_h").isNotNull() | ~text.rlike(r"\S"))
    joined = own.join(told, same("__doc", "__h", "__c")).join(again, same("__copy_doc", "__copy_h", "__copy_c"), "left")
    kept = joined.filter(~gone).withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
