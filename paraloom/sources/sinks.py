"""What a run writes: one keyed JSON document or one TSV per sample, and the same without a call."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Keys of a call's JSON object and columns of its TSV, in order.
JSON_KEYS = (
    "Coverage_MAD", "Median_depth", "Total_CN", "Spacer_CN", "Total_CN_raw", "Spacer_CN_raw", "Variants_called", "CNV_group", "Genotype", "Filter", "Confidence", "Confidence_label", "Phasing_ambiguous", "Clinical_equivalence",
    "Long_read_recommended", "Raw_star_allele", "Call_info", "Exon9_CN", "CNV_consensus", "d67_snp_call", "d67_snp_raw", "Variant_raw_count",
)
TSV_COLUMNS = ("Sample", "Genotype", "Filter", "Confidence", "Activity score", "Predicted phenotype", "Phasing_ambiguous", "Long_read_recommended")
HAPLOTYPE_COLUMNS = ("Haplotype", "Activity value", "Function", "Evidence strength", "Evidence summary")


def _joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), sep)


def call_record(calls: DataFrame) -> DataFrame:
    """(sample_id and the JSON keys) of the rows of a run; what a run has not made is null."""
    have = set(calls.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    several = F.coalesce(col("n_alternatives", "int") > 1, F.contains(F.col("genotype"), F.lit(";")), F.lit(False))
    reflex = F.coalesce(col("reflex", "boolean"), F.lit(False))
    consensus = F.array(F.lit("2"), *[col(c).cast("string") for c in ("exon9", "exon9_intron4", "intron4_intron1", "intron1_up")])
    of = {
        "Coverage_MAD": col("mad"), "Median_depth": col("median_depth"), "Total_CN": col("total_cn"), "Spacer_CN": col("spacer_cn"), "Total_CN_raw": col("total_cn_raw"), "Spacer_CN_raw": col("spacer_cn_raw"),
        "Variants_called": F.array_join(col("names", "array<string>"), " "), "CNV_group": col("tag"), "Genotype": col("genotype"), "Filter": col("filter"), "Confidence": F.format_string("%.2f", F.coalesce(col("confidence", "double"), F.lit(0.0))),
        "Confidence_label": col("confidence_label"), "Phasing_ambiguous": several, "Clinical_equivalence": F.when(~several, "n/a").when(reflex, "different_effect").otherwise("same_effect"), "Long_read_recommended": reflex,
        "Raw_star_allele": col("candidates", "array<string>"), "Call_info": col("call_info"), "Exon9_CN": col("exon9_cn", "int"), "CNV_consensus": F.when(col("tag").isNotNull(), _joined(consensus)),
        "d67_snp_call": _joined(col("site_calls", "array<int>")), "d67_snp_raw": _joined(col("site_raw", "array<double>")), "Variant_raw_count": col("raw_counts", "map<string,string>"),
    }
    return calls.select("sample_id", *[of[k].alias(k) for k in JSON_KEYS])


def write_json(calls: DataFrame, path: str) -> None:
    """A line with a JSON object for each sample, `{sample: call}` with all keys; without samples one line `{}`."""
    keyed = call_record(calls).select(F.to_json(F.create_map("sample_id", F.struct(*JSON_KEYS)), {"ignoreNullFields": "false"}).alias("value"))
    if calls.isEmpty():
        keyed = calls.sparkSession.createDataFrame([("{}",)], "value string")
    keyed.write.text(path)


def read_json(text: str) -> dict:
    """All objects of a written folder's lines in one document."""
    return {k: v for line in text.splitlines() if line for k, v in json.loads(line).items()}


def tsv_lines(calls: DataFrame, haplotypes: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """(sample_id, block, ord, line) of each sample: the call, then what its haplotypes do, then how frequent they are.

    haplotypes (sample_id, haplotype, activity, function, evidence_strength, evidence_summary); frequencies (sample_id, grp, name, percent).
    """
    row = call_record(calls)
    more = calls.select("sample_id", *[(F.col(c) if c in calls.columns else F.lit(None).cast("string")).alias(c) for c in ("activity", "phenotype")])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    sure = F.concat(F.col("Confidence"), F.lit(" ("), F.coalesce("Confidence_label", F.lit("LOW")), F.lit(")"))
    fields = [F.col("sample_id"), text("Genotype"), text("Filter"), sure, dash("activity"), dash("phenotype"), F.col("Phasing_ambiguous").cast("string"), F.col("Long_read_recommended").cast("string")]
    line = lambda block, rank, value: [F.lit(block).alias("block"), rank.cast("long").alias("ord"), value.alias("line")]
    out = row.join(more, "sample_id").select("sample_id", *line(0, F.lit(1), F.concat_ws("\t", *fields)))
    out = row.select("sample_id", *line(0, F.lit(0), F.lit("\t".join(TSV_COLUMNS)))).unionByName(out)
    called = row.where("Genotype is not null").select("sample_id")
    if haplotypes is not None:
        held = haplotypes.join(called, "sample_id", "left_semi")
        body = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("haplotype", "activity", "function", "evidence_strength", "evidence_summary")])
        rank = F.xxhash64("haplotype")
        own = held.select("sample_id", *line(1, rank, body)).groupBy("sample_id").agg(F.array_sort(F.collect_set("line")).alias("l")).select("sample_id", F.posexplode("l").alias("ord", "line"))
        head = called.select("sample_id", F.explode(F.array(F.struct(F.lit(-2).alias("o"), F.lit("").alias("t")), F.struct(F.lit(-1).alias("o"), F.lit("\t".join(HAPLOTYPE_COLUMNS)).alias("t")))).alias("h"))
        out = out.unionByName(own.select("sample_id", F.lit(1).alias("block"), F.col("ord").cast("long"), "line")).unionByName(head.select("sample_id", *line(1, F.col("h.o"), F.col("h.t"))))
    if frequencies is not None:
        held = frequencies.join(called, "sample_id", "left_semi")
        names = held.groupBy("sample_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
        groups = held.groupBy("sample_id", "grp").agg(F.map_from_entries(F.collect_set(F.struct("name", "percent"))).alias("m")).join(names, "sample_id")
        body = F.concat_ws("\t", "grp", F.array_join(F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n), F.lit(""))), "\t"))
        own = groups.select("sample_id", "grp", body.alias("line")).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("grp", "line"))).alias("l")).select("sample_id", F.posexplode("l").alias("ord", "x"))
        head = names.select("sample_id", *line(2, F.lit(-1), F.concat_ws("\t", F.lit("Biogeographic group"), F.array_join("names", "\t"))))
        gap = names.select("sample_id", *line(2, F.lit(-2), F.lit("")))
        out = out.unionByName(own.select("sample_id", F.lit(2).alias("block"), F.col("ord").cast("long"), F.col("x.line").alias("line"))).unionByName(head).unionByName(gap)
    return out


def write_tsv(calls: DataFrame, path: str, haplotypes: DataFrame | None = None, frequencies: DataFrame | None = None) -> None:
    """One folder sample=... per sample with its TSV; without samples the header alone."""
    if calls.isEmpty():
        calls.sparkSession.createDataFrame([("\t".join(TSV_COLUMNS),)], "value string").write.text(path)
        return
    lines = tsv_lines(calls, haplotypes, frequencies).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("block", "ord", "line"))).alias("l"))
    whole = lines.select(F.col("sample_id").alias("sample"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))
    whole.write.partitionBy("sample").text(path)


def console_report(calls: DataFrame, rows: int = 100) -> str:
    """The calls as a table of text, for `rows` samples."""
    shown = call_record(calls).select("sample_id", "Genotype", "Filter", "Confidence", "Confidence_label", "CNV_group", "Total_CN").orderBy("sample_id").limit(rows).collect()
    head = ["Sample", "Genotype", "Filter", "Confidence", "CNV group", "Total CN"]
    body = [[r["sample_id"], r["Genotype"], r["Filter"], f"{r['Confidence']} ({r['Confidence_label']})", r["CNV_group"], r["Total_CN"]] for r in shown]
    table = [head, *[["-" if x is None else str(x) for x in r] for r in body]]
    width = [max(len(r[k]) for r in table) for k in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in table)
