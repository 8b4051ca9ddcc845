"""Personal data: base patterns, and terms that disclose what the patterns protect.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Corpus co-occurrence then tells how far
a term reveals a protected entity. Contexts are lines, longer ones by stretches of CONTEXT characters. The pointwise
mutual information of term and entity over all contexts, as a part of the entity's information content, is the term's
disclosure; the entity's share of the term's contexts is shrunk towards its share of all by SHRINKAGE contexts, so that
few joint occurrences tell less than many, but a term seen with one rare entity alone still tells. Terms at or over
`disclosure` are spans too, wherever they stand in a context with that entity; in sanitised texts they are generalised
to a placeholder, or removed at or over `removal`. DataFrame operations only.

Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows give one result row each, and count
as often as they are there. Spans are code points with exclusive ends, in the order of start, then kind. No span crosses
a line end. Very long lines are only compared within their stretches. Empty tables give empty results; further columns
of the input are ignored, or kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.8
REMOVAL = 0.95
SHRINKAGE = 3.0
CONTEXT = 2000

#: Possessive throughout: nothing follows that could want characters back, and long chains need no stack. An address
#: begins where its run of characters does, or where the address before it ends.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: On lines whose separators stand between two digits only; so a run is a match of `[0-9]([\x20-]?[0-9])+`.
LONE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CARD = r"[0-9][0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word of at least four letters that isn't part of an address or a code.
TERM = r"(?<![\p{L}0-9@._%+-])\p{L}{4,}+(?![0-9@_%+-]|\.[A-Za-z0-9])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, less 9 where that has two places."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.split(F.reverse(digits), "(?!^)(?!$)"),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("second")),
        lambda a, x: F.struct((a["sum"] + F.when(a["second"], doubled(x.cast("int"))).otherwise(x.cast("int"))).alias("sum"), (~a["second"]).alias("second")),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's further test."""
    part = lambda i: F.regexp_replace(F.split(value, r"\.")[i], "^0+(?=[0-9])", "")
    small = [(F.length(part(i)) <= 3) & (part(i).try_cast("int") <= 255) for i in range(4)]
    digits = _digits(value)
    ip = small[0] & small[1] & small[2] & small[3]
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(F.length(digits).between(10, 15))


def _matches(line: Column, pattern: str, kind: str) -> Column:
    """Per match: kind, what stands between it and the match before, and its text."""
    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(line, pattern, -1).alias("gap"), F.regexp_extract_all(line, p, F.lit(0)).alias("value"))
    found = F.filter(pairs, lambda x: x["value"].isNotNull())
    return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["value"].alias("value")))


def _placed(rows: DataFrame, matches: Column, *keep: str) -> DataFrame:
    """A row per match with its start and end in the text, and its context's number in the line; rows has row, line_no,
    at (the line's start)."""
    order = Window.partitionBy("row", "line_no", "kind").orderBy("i")
    size = F.length("value")
    return (
        rows.select("row", "line_no", "at", *keep, F.explode(matches).alias("m"))
        .select("row", "line_no", "at", *keep, "m.*")
        .withColumn("end", F.col("at") + F.sum(F.col("gap") + size).over(order))
        .withColumn("start", F.col("end") - size)
        .withColumn("piece", F.floor((F.col("start") - F.col("at")) / CONTEXT))
        .drop("gap", "i", "at")
    )


def entity_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, line_no, at, line: the lines that can hold an entity; every text that could has one or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    can = lambda c: c.rlike("[0-9@]")
    order = Window.partitionBy("row").orderBy("line_no")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .filter(can(F.col("text")))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .withColumn("at", F.sum(F.length("line") + 1).over(order) - F.length("line") - 1)
        .filter(can(F.col("line")))
    )


def base_spans(lines: DataFrame) -> DataFrame:
    """row, line_no, piece, kind, value, start, end of every base span."""
    line = F.col("line")
    none = F.expr("filter(array(named_struct('kind', '', 'i', 0, 'gap', 0, 'value', '')), x -> false)")
    digit = line.rlike("[0-9]")
    found = F.concat(
        F.when(F.instr(line, "@") > 0, _matches(line, EMAIL, "email")).otherwise(none),
        F.when(digit, _matches(line, IP, "ip")).otherwise(none),
        F.when(digit, _matches(F.regexp_replace(line, LONE_SEPARATOR, "\n"), CARD, "card")).otherwise(none),
        F.when(F.instr(line, "+") > 0, _matches(line, PHONE, "phone")).otherwise(none),
    )
    return _placed(lines, found).filter(_holds(F.col("kind"), F.col("value")))


def term_contexts(docs: DataFrame) -> tuple[DataFrame, float]:
    """(term and n_t, the number of its contexts; the number of all contexts)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.explode(F.split(text, "\n", -1)).alias("line"))
    long = F.length("line") > CONTEXT
    words = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(TERM), F.lit(0)), F.lower))
    stretches = docs.filter(F.length(text) > CONTEXT).withColumn("row", F.monotonically_increasing_id())
    stretches = stretches.select("row", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).filter(long).withColumn("at", F.lit(0))
    parts = _placed(stretches, _matches(F.col("line"), TERM, "term")).select("row", "line_no", "piece", F.lower("value").alias("term")).distinct()
    counts = lines.filter(~long).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = counts.unionByName(parts.groupBy("term").agg(F.count("*").alias("n_t")))
    n = lines.agg(F.sum(F.greatest(F.ceil(F.length("line") / CONTEXT), F.lit(1)))).first()[0]
    return counts.groupBy("term").agg(F.sum("n_t").alias("n_t")), float(n or 0)


def disclosing_terms(docs: DataFrame, met: DataFrame, spans: DataFrame, disclosure: float = DISCLOSURE, shrinkage: float = SHRINKAGE) -> DataFrame:
    """value, term, ratio: terms whose co-occurrence with an entity discloses it. `met` are the rows of row, line_no,
    piece, value, term of terms in a context with an entity."""
    pairs = met.groupBy("value", "term").agg(F.count("*").alias("n_et"))
    entity = spans.select("row", "line_no", "piece", "value").distinct().groupBy("value").agg(F.count("*").alias("n_e"))
    # Stored in parts: the joins of one stage hold their sorted rows side by side.
    pairs = stored(pairs.join(entity, "value"), "pii-counted")
    counts, n = term_contexts(docs)
    term = stored(counts.join(pairs.select("term").distinct(), "term", "left_semi"), "pii-terms")
    share = F.col("n_e") / n
    told = (F.col("n_et") + shrinkage * share) / (F.col("n_t") + shrinkage)
    joined = pairs.join(term, "term").filter(F.col("n_e") < n)
    return joined.select("value", "term", (F.log(told / share) / -F.log(share)).alias("ratio")).filter(F.col("ratio") >= disclosure)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, shrinkage: float = SHRINKAGE) -> tuple[DataFrame, DataFrame]:
    """(entity lines, spans): spans has row, kind, start, end, ratio for base spans and disclosing terms."""
    lines = stored(entity_lines(docs), "pii-lines")
    base = stored(base_spans(lines), "pii-spans")
    held = lines.join(base.select("row", "line_no").distinct(), ["row", "line_no"], "left_semi")
    placed = stored(_placed(held, _matches(F.col("line"), TERM, "term")).withColumn("term", F.lower("value")).drop("value"), "pii-terms")
    context = ["row", "line_no", "piece"]
    met = stored(base.select(*context, "value").distinct().join(placed.select(*context, "term").distinct(), context), "pii-pairs")
    told = stored(disclosing_terms(docs, met, base, disclosure, shrinkage), "pii-disclosing")
    where = met.join(told, ["value", "term"]).groupBy(*context, "term").agg(F.max("ratio").alias("ratio"))
    terms = placed.join(where, [*context, "term"])
    return lines, base.select("row", "kind", "start", "end", F.lit(1.0).alias("ratio")).unionByName(terms.select("row", "kind", "start", "end", "ratio"))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, shrinkage: float = SHRINKAGE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans: one row per document."""
    lines, spans = find(docs, disclosure, shrinkage)
    rank = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "ip", 1).when(F.col("kind") == "card", 2).when(F.col("kind") == "phone", 3).otherwise(4)
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("all"))
    said = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda a, k: F.size(F.filter(a, lambda s: s["kind"] == k)).cast("long")
    with_any = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id")).join(per_row, "row", "left")
    a = F.coalesce(F.col("all"), F.expr("filter(array(named_struct('start', 0L, 'rank', 0, 'end', 0L, 'kind', '')), x -> false)"))
    with_any = with_any.select("doc_id", a.alias("all"))
    none = docs.filter(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"))

    def result(df: DataFrame, a: Column | None) -> DataFrame:
        counts = [(count(a, k) if a is not None else F.lit(0).cast("long")).alias(f"n_{k}") for k in (*KINDS, "term")]
        base = said(F.filter(a, lambda s: s["kind"] != "term")) if a is not None else F.lit("")
        return df.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), (said(a) if a is not None else F.lit("")).alias("spans"))

    return result(with_any, F.col("all")).unionByName(result(none, None))


def sanitise(text: Column, spans: Column, removal: float = REMOVAL) -> Column:
    """Text with its spans (structs of kind, start, end, ratio, by start) replaced by their kind in brackets.

    Of spans that overlap, the first counts and the rest of a later one goes too. Terms at or over `removal` go
    without a trace.
    """
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["out"],
                F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                F.when((s["end"] <= acc["at"]) | ((s["kind"] == "term") & (s["ratio"] >= removal)), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))),
            ).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))
