"""Command line: reads or BAM files and a folder of definition tables in, JSON and TSV out."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.plans import diagnostics, genotype
from paraloom.operators import site_index
from paraloom.sources import alignment, bam, sinks
from paraloom.sources import tables as T


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="paraloom", description=__doc__)
    made.add_argument("-i", "--input", required=True, help="a Parquet reads table, or BAM files (path or pattern); an index <file>.bai is used where there is one; what follows ##idx## is ignored")
    made.add_argument("-o", "--outDir", required=True, help="folder for the results")
    made.add_argument("-d", "--definitions", required=True, help="folder of the definition tables, with names.json that tells their files")
    made.add_argument("-g", "--genome", default="autodetect", choices=["autodetect", "38", "chr38"])
    made.add_argument("--id", help="keep this sample only")
    made.add_argument("--countFilePath", help="folder of pre-computed counts, <sample>_count.txt")
    for flag in ("population-info", "haplotype-info", "print"):
        made.add_argument(f"--{flag}", action="store_true")
    for name in [f.name for f in dataclasses.fields(genotype.Options)] + list(diagnostics.TABLES):
        made.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    return made


#: Stretches of a file of reads that regions are counted in at most, and how near they are read as one.
COUNTED, COUNTED_GAP = 4096, 10_000


def load(spark: SparkSession, path: str, intervals: list | None = None) -> DataFrame:
    """A table of reads, or BAM files; of indexed BAM files only what overlaps the intervals, where those are given."""
    path = path.split("##idx##")[0]
    if not path.endswith(".bam"):
        return T.reads(spark, path)
    return bam.read_indexed(spark, path, intervals) if bam.readable(path) else alignment.read_bam(spark, path)


def inputs(spark: SparkSession, path: str, definitions: str, names: dict, genome: str) -> tuple[T.Resources, DataFrame, DataFrame, DataFrame | None]:
    """(definitions, reads that regions are counted in, reads of the gene's stretches, samples where those are known without the reads)."""
    path = path.split("##idx##")[0]
    if path.endswith(".bam"):  # contigs have no `chr` there
        res = T.resources(spark, definitions, names, "38")
        stretches = [(r["chrom"], r["start"], r["end"]) for r in res.regions.select("chrom", "start", "end").collect()]  # a definition table
        counted = load(spark, path, site_index.merged(stretches, COUNTED_GAP, COUNTED))
        samples = [(f.rpartition("/")[2].removesuffix(".bam"),) for f in bam.found_files(path)] if bam.readable(path) else []
        known = spark.createDataFrame(samples, "sample_id string") if samples else None
        return res, counted, genotype.gene_reads(load(spark, path, genotype.gene_intervals(res)), res), known
    reads = load(spark, path)
    first = reads.where("chrom is not null").select("chrom").limit(1).collect()
    res = T.resources(spark, definitions, names, "chr38" if genome == "chr38" or (first and first[0][0].startswith("chr")) else "38")
    named = res.regions.select("chrom").first()
    if named and named[0].startswith("chr"):
        res.chrom = f"chr{res.chrom}"
    if genome != "chr38" and first and named and first[0][0].startswith("chr") != named[0].startswith("chr"):
        # a name that is changed cannot be looked up in the files' statistics
        reads = reads.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return res, reads, genotype.gene_reads(reads, res), None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.split("##idx##")[0])
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("paraloom").getOrCreate()
    if not exists(spark, args.input):
        nothing = spark.createDataFrame([], "sample_id string, genotype string")
        sinks.write_json(nothing, f"{args.outDir}/json")
        sinks.write_tsv(nothing, f"{args.outDir}/tsv")
        return None
    names = json.loads(spark.read.text(f"{args.definitions}/names.json", wholetext=True).first()[0])
    res, reads, near, samples = inputs(spark, args.input, args.definitions, names, args.genome)
    if args.id:
        reads, near = reads.where(F.col("sample_id") == args.id), near.where(F.col("sample_id") == args.id)
        samples = samples.where(F.col("sample_id") == args.id) if samples is not None else None
    options = genotype.Options(**{f.name: getattr(args, f.name) for f in dataclasses.fields(genotype.Options)})
    counts = T.count_files(spark, args.countFilePath) if args.countFilePath else None
    calls = genotype.cut(genotype.run(reads, res, options, counts, near, samples))
    called = calls.where("genotype is not null").select("sample_id", "genotype")
    haplotypes = diagnostics.haplotype_details(called, res.function) if args.haplotype_info and res.function is not None else None
    both = (res.haplotype_frequency, res.diplotype_frequency)
    frequencies = genotype.frequencies(called, *both) if args.population_info and None not in both else None
    sinks.write_json(calls, f"{args.outDir}/json")
    sinks.write_tsv(calls, f"{args.outDir}/tsv", haplotypes, frequencies)
    for name in diagnostics.TABLES:
        if getattr(args, name):
            made = diagnostics.TABLES[name](near, res, calls)
            if made is not None:
                made.write.mode("overwrite").parquet(f"{args.outDir}/{name}")
    if args.print:
        print(sinks.console_report(calls))
    return calls
