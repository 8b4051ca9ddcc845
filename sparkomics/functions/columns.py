"""Column functions: identifiers, casts, sequences, variants, vectors, risk scores."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of all codons, bases in the order t, c, a, g, the last base changing fastest.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, itertools.product("tcag", repeat=3)), AMINO_ACIDS))

#: Bases and what pairs with them. S and W pair with each other; strictly, each pairs with itself.
BASES, PAIRS, STRICT_PAIRS = "ACGTRYKMSWBVDHNX", "TGCAYRMKWSVBHDNX", "TGCAYRMKSWVBHDNX"


def safe_name(c: Column) -> Column:
    """A valid identifier: white space becomes an underscore, other characters go, a leading digit gets an X."""
    kept = F.regexp_replace(F.regexp_replace(c, r"\s", "_"), "[^A-Za-z0-9_]", "")
    return F.when(kept.rlike("^[0-9]"), F.concat(F.lit("X"), kept)).otherwise(kept)


def cast_str(c: Column) -> Column:
    """As a string; blank is null."""
    text = c.cast("string")
    return F.when(F.trim(text) != "", text)


def cast_float(c: Column) -> Column:
    """As a double; what is none is null."""
    return F.trim(c.cast("string")).try_cast("double")


def kegg_id(c: Column, pathway: bool) -> Column:
    """`path:org00010` or `org:123` from such an id, one with its prefix left out, or a number."""
    number = F.regexp_extract(c, r"([0-9]+)$", 1)
    organism = F.coalesce(F.nullif(F.regexp_extract(c, r"([a-z]+):?[0-9]+$", 1), F.lit("")), F.lit("hsa"))
    return F.concat(F.lit("path:"), organism, F.lpad(number, 5, "0")) if pathway else F.concat(organism, F.lit(":"), number.cast("bigint").cast("string"))


def revcomp(c: Column, strict: bool = False) -> Column:
    """The reverse complement; upper and lower case are kept."""
    pairs = STRICT_PAIRS if strict else PAIRS
    return F.translate(F.reverse(c), BASES + BASES.lower(), pairs + pairs.lower())


def translate_dna(c: Column) -> Column:
    """The protein of a DNA sequence; unknown and partial codons are `*`."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(3)), lambda i: F.coalesce(F.try_element_at(table, F.lower(F.substr(c, i, F.lit(3)))), F.lit("*"))))
    return F.coalesce(F.array_join(codons, ""), F.when(c.isNotNull(), ""))


def reverse_translate(c: Column) -> Column:
    """A DNA sequence of a protein: the last codon in order of each amino acid."""
    last = {a: codon for codon, a in CODONS.items()}
    table = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    return F.array_join(F.transform(F.split(F.upper(c), "(?!^)(?!$)"), lambda a: F.coalesce(F.try_element_at(table, a), F.lit("nnn"))), "")


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("-", chrom, pos.cast("string"), ref, alt)


def is_snp(ref: Column, alt: Column) -> Column:
    """One reference base at most, and every alternative one base."""
    return (F.length(ref) <= 1) & (F.size(alt) >= 1) & F.forall(alt, lambda a: a.isin(*"ACGT"))


def is_indel(ref: Column, alt: Column, sv: Column) -> Column:
    return F.exists(alt, lambda a: (a == ".") | ((F.length(a) != F.length(ref)) & ~sv)) | ((F.length(ref) > 1) & ~sv)


def is_transition(ref: Column, alt: Column) -> Column:
    return is_snp(ref, alt) & (F.size(alt) == 1) & F.concat(ref, F.get(alt, 0)).isin("AG", "GA", "CT", "TC")


def var_type(ref: Column, alt: Column, sv: Column) -> Column:
    return F.when(is_snp(ref, alt), "snp").when(is_indel(ref, alt, sv), "indel").when(sv, "sv").otherwise("unknown")


def genotype(text: Column) -> Column:
    """Allele numbers of a genotype such as 0/1 or 1|0; a missing allele is -1."""
    return F.transform(F.split(text, r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))


def dosage(text: Column, allele: int | Column = 1) -> Column:
    """How often a genotype has the allele."""
    return F.size(F.filter(genotype(text), lambda a: a == allele))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scalar_projection(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(b, b)))


def angle_degrees(a: Column, b: Column) -> Column:
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


#: A published ten-year cardiovascular risk model by sex: coefficients and means of the logarithms of age,
#: cholesterol, HDL, untreated and treated systolic pressure, and of smoking and diabetes; baseline survival.
RISK = {
    True: ((3.06117, 1.12370, -0.93263, 1.93303, 1.99881, 0.65451, 0.57367), (3.8560, 5.3420, 3.7686, 4.3544, 0.5019, 0.3522, 0.0650), 0.88936),
    False: ((2.32888, 1.20904, -0.70833, 2.76157, 2.82263, 0.52873, 0.69154), (3.8686, 5.3504, 4.0176, 4.2400, 0.5826, 0.3423, 0.0376), 0.95012),
}


def framingham_risk(male: Column, age: Column, cholesterol: Column, hdl: Column, sbp: Column, treated: Column, smoker: Column, diabetic: Column) -> Column:
    """The risk; null if any input is."""

    def score(sex: bool) -> Column:
        weights, means, survival = RISK[sex]
        zero = F.lit(0.0)
        pressure = F.log(sbp)
        values = [F.log(age), F.log(cholesterol), F.log(hdl), F.when(treated, zero).otherwise(pressure), F.when(treated, pressure).otherwise(zero), smoker.cast("double"), diabetic.cast("double")]
        effect = sum(((v - m) * w for v, m, w in zip(values, means, weights)), F.lit(0.0))
        return 1 - F.pow(F.lit(survival), F.exp(effect))

    known = treated.isNotNull() & male.isNotNull()
    return F.when(known, F.when(male, score(True)).otherwise(score(False)))


def is_deletion(ref: Column, alt: Column, sv: Column) -> Column:
    """An indel of one alternative at most that is missing or shorter than the reference."""
    first = F.get(alt, 0)
    return (F.size(alt) <= 1) & is_indel(ref, alt, sv) & (first.isNull() | (first == ".") | (F.length(ref) > F.length(first)))


def var_subtype(ref: Column, alt: Column, info: Column) -> Column:
    """ts, tv, del, ins, unknown, complex (breakends), or the structural variant's type; of imprecise ones the
    alternative's symbol."""
    kind = F.try_element_at(info, F.lit("SVTYPE"))
    sv, one = F.map_contains_key(info, "SVTYPE"), F.size(alt) == 1
    snp = F.when(is_transition(ref, alt), "ts").when(one, "tv").otherwise("unknown")
    indel = F.when(is_deletion(ref, alt, sv), "del").when(one, "ins").otherwise("unknown")
    structural = F.when(kind.isNull(), "unknown").when(kind == "BND", "complex").when(~F.map_contains_key(info, "IMPRECISE"), kind).otherwise(F.trim(F.get(alt, 0), F.lit("<>")))
    return F.when(is_snp(ref, alt), snp).when(is_indel(ref, alt, sv), indel).otherwise(structural)


def ploidy(text: Column) -> Column:
    return F.size(F.split(text, r"[/|]"))


def is_phased(text: Column) -> Column:
    return F.contains(text, F.lit("|"))


def variant_end(pos: Column, alt: Column) -> Column:
    return pos + F.length(F.get(alt, 0))


def legacy_variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The identifier with all alternatives, joined by slashes; - stands for what is missing."""
    return F.concat_ws("-", chrom, pos.cast("string"), F.coalesce(ref, F.lit("-")), F.array_join(F.transform(alt, lambda a: F.coalesce(a, F.lit("-"))), "/"))


def genotype_index(low: Column, high: Column) -> Column:
    """The place of an unordered genotype among a variant's genotype counts."""
    return (high * (high + 1) / 2 + low).cast("int")


def same_sequence(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def without_ambiguity(c: Column) -> Column:
    """Two-base ambiguity codes become N."""
    return F.regexp_replace(c, "[KYWMRS]", "N")


def feature_sequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """A feature's part of a sequence, places from 1, both ends included; on the minus strand its reverse complement."""
    part = F.substr(seq, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(strand == "-", revcomp(part)).otherwise(part)


def pmin(*columns: Column) -> Column:
    """The lesser of each place of arrays and scalars."""
    return _parallel(F.least, columns)


def pmax(*columns: Column) -> Column:
    return _parallel(F.greatest, columns)


def _parallel(pick, columns) -> Column:
    """The first column is an array, the others arrays or scalars (given as numbers)."""
    out = columns[0]
    for c in columns[1:]:
        other = c if isinstance(c, Column) else F.array_repeat(F.lit(c), F.size(out))
        out = F.zip_with(out, other, lambda x, y: pick(x, y))
    return out


def psl_scores(c: dict[str, Column], mrna: bool = True) -> tuple[Column, Column]:
    """(score, percent identity) of an alignment in PSL columns."""
    last = lambda x: F.element_at(F.filter(F.split(c[x], ","), lambda v: v != ""), -1).cast("bigint")
    reach = 3 * last("block_sizes") + last("t_starts")
    protein = F.when(c["strand"] == "+", c["t_end"] == reach).when(c["strand"] == "-", c["t_start"] == c["t_size"] - reach).otherwise(False)
    size = F.when(protein, 3).otherwise(1)
    score = size * (c["matches"] + F.floor(c["rep_matches"] / 2)) - size * c["mismatches"] - c["q_num_insert"] - c["t_num_insert"]
    q_size, t_size = size * (c["q_end"] - c["q_start"]), c["t_end"] - c["t_start"]
    difference = q_size - t_size
    difference = F.when(difference >= 0, difference).otherwise(F.lit(0) if mrna else -difference)
    inserts = c["q_num_insert"] if mrna else c["q_num_insert"] + c["t_num_insert"]
    total = size * (c["matches"] + c["rep_matches"] + c["mismatches"])
    gap = F.floor(3 * F.log(1 + difference) + 0.5)
    bad = F.when((F.least(q_size, t_size) <= 0) | (total == 0), 0).otherwise(F.floor(1000 * (c["mismatches"] * size + inserts + gap) / total))
    return score, 100.0 - bad * 0.1


def feature_type(value: Column) -> Column:
    """The type of a pedigree's feature by a value: marker, trait, affection or other."""
    return F.when(value.rlike("[/ ]"), "m").when(F.upper(value) == "X", "t").when(value.isin("0", "1", "2"), "a").otherwise("s")


#: What stands for an unknown value, by a feature's type; 0 for any other.
EMPTY_VALUES = {"a": "X", "c": "X", "t": "X", "m": "0/0", "s": "X"}


def empty_value(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EMPTY_VALUES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit("0"))


def ibd_state(p0: Column, p1: Column, p2: Column) -> Column:
    """How many alleles are shared most probably; of equals the fewest."""
    p = [x.try_cast("double") for x in (p0, p1, p2)]
    return (F.array_position(F.array(*p), F.greatest(*p)) - 1).cast("int")


def parse_date(c: Column, formats: list[str]) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def body_mass_index(weight_kg: Column, height_cm: Column) -> Column:
    return F.try_divide(weight_kg, F.pow(height_cm / 100, F.lit(2.0)))


def token(c: Column, place: int, sep: str = "-") -> Column:
    """The token at a place, from 1; null if there are fewer."""
    return F.nullif(F.split_part(c, F.lit(sep), F.lit(place)), F.lit(""))
