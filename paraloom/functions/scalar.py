"""Column functions: names, keys, bases, rounding and bands."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: z beyond which a one-sided normal tail is below 0.001.
TAIL_Z = 3.0902323061678132


def fraction(n1: Column, n2: Column, min_depth: int = 1, empty: float | None = None) -> Column:
    """n1 / (n1 + n2), or `empty` below min_depth."""
    return F.when(n1 + n2 >= min_depth, n1 / F.greatest(n1 + n2, F.lit(1))).otherwise(F.lit(empty).cast("double"))


def round3(x: Column) -> Column:
    """Three decimals, halves to even; values within 1e-9 of a half count as halves."""
    half = F.floor(x * 1000) + 0.5
    return F.bround(F.when(F.abs(x * 1000 - half) < 1e-9, half / 1000).otherwise(x), 3)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCATGCA"))


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T 3 in either case, anything else 4."""
    return F.when(F.upper(base) == "A", 0).when(F.upper(base) == "C", 1).when(F.upper(base) == "G", 2).when(F.upper(base) == "T", 3).otherwise(4)


def either_prefix(a: Column, b: Column) -> Column:
    return F.startswith(F.upper(a), F.upper(b)) | F.startswith(F.upper(b), F.upper(a))


def allele_state(seen: Column, alt: Column, ref: Column) -> Column:
    """true for the alternative, false for the reference, null for neither; a prefix of either kind counts."""
    return F.when(either_prefix(seen, alt), True).when(either_prefix(seen, ref), False)


def parse_variant(name: Column) -> Column:
    """struct(pos, ref, alt, is_deletion) of g.<pos><ref>><alt> and g.<pos>del<bases>; null for anything else."""
    snv, cut = r"^g\.(\d+)([ACGT])>([ACGT])$", r"^g\.(\d+)del([ACGT]+)$"
    one = F.struct(F.regexp_extract(name, snv, 1).cast("long").alias("pos"), F.regexp_extract(name, snv, 2).alias("ref"), F.regexp_extract(name, snv, 3).alias("alt"), F.lit(False).alias("is_deletion"))
    gone = F.struct(F.regexp_extract(name, cut, 1).cast("long").alias("pos"), F.regexp_extract(name, cut, 2).alias("ref"), F.lit("-").alias("alt"), F.lit(True).alias("is_deletion"))
    return F.when(name.rlike(snv), one).when(name.rlike(cut), gone)


def main_allele(star: Column) -> Column:
    """A star name without its sub-allele number."""
    return F.regexp_replace(star, r"\.\d+", "")


def without_copies(star: Column) -> Column:
    return F.regexp_replace(star, r"x\d+$", "")


def star_parts(genotype: Column) -> Column:
    """The star names of a genotype with its alternatives, sorted, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(genotype, r"[/+;_]"), lambda x: x != ""), without_copies)))


def alt_count(measured: Column) -> Column:
    """The first number of `alt(fwd:rev),ref`."""
    return F.nullif(F.regexp_extract(measured, r"^(\d+)", 1), F.lit("")).cast("long")


def ref_count(measured: Column) -> Column:
    return F.nullif(F.regexp_extract(F.element_at(F.split(measured, ","), -1), r"^(\d+)$", 1), F.lit("")).cast("long")


def multiset_key(names: Column) -> Column:
    """Sorted names, repeats kept, joined by `_`; `NA` for none."""
    kept = F.array_sort(F.filter(names, lambda x: x != "NA"))
    return F.when(F.size(kept) == 0, "NA").otherwise(F.array_join(kept, "_"))


def geometric_mean(scores: list[Column], weights: list[float], least: float = 0.01) -> Column:
    """exp of the weighted mean of logs, each score kept above `least`, within 0 and 1."""
    total = sum((F.ln(F.greatest(s, F.lit(least))) * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(total / sum(weights))))


def phenotype_band(score: Column) -> Column:
    """The metaboliser band of an activity score; null scores are indeterminate and gaps unknown."""
    return (
        F.when(score.isNull(), "Indeterminate").when(score == 0, "Poor Metabolizer").when((score >= 0.25) & (score <= 1), "Intermediate Metabolizer")
        .when((score >= 1.25) & (score <= 2.25), "Normal Metabolizer").when(score > 2.25, "Ultrarapid Metabolizer").otherwise("Unknown")
    )


def sort_pair(genotype: Column) -> Column:
    """The two sides of a genotype in order of their first star number; other shapes are left alone."""
    sides = F.split(genotype, "/")
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^\*?(\d+)", 1), F.lit("")).cast("long"), F.lit(1 << 40))
    return F.when((F.size(sides) == 2) & (number(sides[0]) > number(sides[1])), F.concat_ws("/", sides[1], sides[0])).otherwise(genotype)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def log10_base(quality: Column, match: Column) -> Column:
    """log10 likelihood of a base with a phred quality: of a match log10(1 - e), else log10(e / 3)."""
    e = F.greatest(F.lit(1e-10), F.least(F.lit(0.5), F.pow(F.lit(10.0), -quality / 10)))
    return F.when(match, F.log10(1 - e)).otherwise(F.log10(e / 3))
