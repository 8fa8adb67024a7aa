"""Indexed BAM files, the site index, and how often a run scans its reads."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from paraloom import cli
from paraloom.operators import intervals as I
from paraloom.operators import site_index as X
from paraloom.plans import genotype as G
from paraloom.sources import alignment, bam
from paraloom.sources import tables as T
from tests.test_operators import READS
from tests.test_plans import bam as bam_bytes
from tests.test_run import toy_reads

END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bin_of(start, end):
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def indexed(path, contigs, rows, block=3000):
    """Write rows (name, flag, contig, pos, mapq, tlen, cigar, seq) in order of contig and place as a blocked BAM file with its index."""
    head, bodies = bam_bytes(contigs, []), [bam_bytes([], [r])[12:] for r in rows]
    out, places, held, at = b"", [], b"", 0

    def flush():
        nonlocal out, held
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(held) + deflate.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(held), len(held))
        held = b""

    whole, starts = head + b"".join(bodies), []
    for b in [head, *bodies]:
        starts.append(at)
        at += len(b)
    offsets = {}
    for k in range(0, len(whole), block):  # records go over the ends of blocks
        offsets[k // block] = len(out)
        held = whole[k : k + block]
        flush()
    size = len(out)
    virtual = lambda x: (offsets[x // block] << 16 | x % block) if x < len(whole) else size << 16
    places = [virtual(x) for x in [*starts[1:], len(whole)]]
    path.write_bytes(out + END_BLOCK)
    index = b"BAI\1" + struct.pack("<i", len(contigs))
    for c in range(len(contigs)):
        bins, linear = {}, {}
        for k, (_, _, contig, pos, _, _, cigar, _) in enumerate(rows):
            if contig == c:
                end = pos + max(1, sum(n for op, n in cigar if op in "MDN=X"))
                pieces = bins.setdefault(bin_of(pos, end), [])
                if pieces and pieces[-1][1] == places[k]:
                    pieces[-1][1] = places[k + 1]
                else:
                    pieces.append([places[k], places[k + 1]])
                for w in range(pos >> 14, (end - 1 >> 14) + 1):
                    linear[w] = min(linear.get(w, 1 << 62), places[k])
        index += struct.pack("<i", len(bins) + 1)
        for number, pieces in sorted(bins.items()):
            index += struct.pack("<Ii", number, len(pieces)) + b"".join(struct.pack("<QQ", *p) for p in pieces)
        index += struct.pack("<IiQQQQ", bam.COUNTS_BIN, 2, 0, 0, 0, 0)
        windows, last = [], 0
        for w in range(max(linear, default=-1) + 1):
            last = linear.get(w, last)
            windows.append(last)
        index += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
    (path.parent / f"{path.name}.bai").write_bytes(index)


def many_rows(n=6000, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        size = r.randint(20, 60)
        cigar = r.choice([[("M", size)], [("S", 4), ("M", size - 4)], [("M", 10), ("D", 7), ("M", size - 10)], [("M", 10), ("N", 50_000), ("M", size - 10)], [("M", 8), ("I", 3), ("M", size - 11)]])
        rows.append((f"q{k % 3500}", r.choice([0, 16, 1024, 256]), r.choice([0, 0, 1]), r.randint(0, 2_000_000), r.choice([0, 60]), r.randint(-400, 400), cigar, "".join(r.choices("ACGT", k=size))))
    return sorted(rows, key=lambda x: (x[2], x[3])) + [("u", 4, -1, -1, 0, 0, [], "ACGT")]


@pytest.fixture(scope="module")
def bam_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    indexed(folder / "one.bam", ["chr22", "chr5"], many_rows())
    indexed(folder / "two.bam", ["chr5", "22"], many_rows(500, 8))
    return folder


def plain(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_indexed_bam(spark, bam_folder):
    whole = alignment.read_bam(spark, f"{bam_folder}/*.bam").cache()
    assert whole.count() == 6500
    for split in (1 << 30, 20_000, 1):
        got = bam.read_indexed(spark, f"{bam_folder}/*.bam", split_bytes=split)
        assert plain(got) == plain(whole) and got.columns == whole.columns
        assert got.rdd.getNumPartitions() == 2 if split == 1 << 30 else got.rdd.getNumPartitions() > 10
    assert plain(bam.read_indexed(spark, str(bam_folder))) == plain(whole)
    # filters that Spark pushes, and stretches
    for some in ("chrom = '22' and pos < 500000 and end_pos > 400000", "chrom in ('5', '7') and pos >= 1900000", "pos <= 1000", "chrom = '9'", "end_pos >= 1999990"):
        assert plain(bam.read_indexed(spark, str(bam_folder), split_bytes=5000).where(some)) == plain(whole.where(some))
    asked = [("22", 100_000, 101_000), ("22", 1_500_000, 1_500_001), ("5", 1_990_000, 3_000_000), ("7", 0, 10)]
    want = whole.where(" or ".join(f"(chrom = '{c}' and pos < {e} and end_pos > {s})" for c, s, e in asked))
    assert plain(bam.read_indexed(spark, str(bam_folder), asked)) == plain(want) and want.count() > 50
    assert bam.read_indexed(spark, str(bam_folder), []).count() == 0


def test_only_the_blocks_of_a_stretch_are_read(bam_folder, monkeypatch):
    read, real = [], bam.Blocks.read_at

    def counted(self, n, at):
        out = real(self, n, at)
        read.append(len(out))
        return out

    monkeypatch.setattr(bam.Blocks, "read_at", counted)
    monkeypatch.setattr(bam, "READ_BYTES", 1 << 12)
    size = (bam_folder / "one.bam").stat().st_size

    def look(**options):
        read.clear()
        reader = bam.BamReader({"path": f"{bam_folder}/one.bam", **options})
        planned = reader.partitions()
        head = sum(read)
        read.clear()
        rows = sum(b.num_rows for p in planned for b in reader.read(p))
        return rows, sum(read), head, len(planned)

    rows, n, head, _ = look(intervals="22:1000000-1020000")
    assert 0 < rows < 200 and head < 0.1 * size and n < 0.15 * size
    rows, n, _, tasks = look(splitbytes="20000")
    assert rows == 6000 and tasks > 5 and n < 1.5 * size + tasks * (1 << 17)


def test_bam_without_index_or_with_a_cut_end(spark, bam_folder, tmp_path):
    data = (bam_folder / "one.bam").read_bytes()
    (tmp_path / "bare.bam").write_bytes(data)
    got = bam.read_indexed(spark, str(tmp_path))
    assert got.count() == 6000 and got.rdd.getNumPartitions() == 1
    assert got.where("chrom = '5' and pos < 9000").count() == alignment.read_bam(spark, f"{bam_folder}/one.bam").where("chrom = '5' and pos < 9000").count()
    (tmp_path / "bare.bam").write_bytes(data[: len(data) // 2])
    assert 0 < bam.read_indexed(spark, f"{tmp_path}/bare.bam").count() < 6000
    (tmp_path / "bare.bam").write_bytes(b"nothing at all, but long enough for a block")
    with pytest.raises(ValueError):
        bam.BamReader({"path": f"{tmp_path}/bare.bam"}).partitions()
    assert not bam.readable("viewfs://store/x.bam") and not bam.readable(f"{tmp_path}/none/*.bam")


# ---- the site index ----


def test_observations_are_those_of_the_join(spark, bam_folder):
    reads = alignment.read_bam(spark, f"{bam_folder}/one.bam").unionByName(spark.createDataFrame([("s", "n1", 0, None, 5, 9, 60, 1, [("M", 4)], "ACGT", [1]), ("s", "n2", 0, "22", 5, 9, 60, 1, None, "ACGT", None), ("s", "n3", 0, "22", 70, 74, 60, 1, [("M", 4)], None, None)], READS))
    r = random.Random(1)
    rows = [(k, r.choice(["22", "5", "8"]), r.randint(0, 2_000_000), r.choice([["A"], ["AC", "T"], ["GTTT"], []]), r.randint(0, 2_000_000), ["C"]) for k in range(900)] + [(900, "22", 70, ["A"], 70, ["C"]), (901, "22", None, ["A"], 72, ["C"])]
    sites = spark.createDataFrame(rows, "idx int, chrom string, pos1 long, alleles1 array<string>, pos2 long, alleles2 array<string>")
    both = X.site_rows(sites, "a").unionByName(X.site_rows(sites.where("idx % 3 = 0"), "b"))
    got, want = X.observe(reads, both), X.observe(reads, both, most=0)
    assert got.columns == want.columns and plain(got) == plain(want) and got.count() > 40
    for mapq, span in ((0, 0), (10, 100)):
        own = X.at_sites(got, "b", (1,), mapq, span)
        old = I.site_bases(reads, sites.where("idx % 3 = 0").select("idx", "chrom", F.col("pos1").alias("pos"), "alleles1", "alleles2"), mapq, span)
        for f in (lambda x: I.supporting_counts(I.allele_reads(x, ["sample_id"]), ["sample_id"]), lambda x: I.haplotype_bases(x).select("sample_id", "qname", "idx", "base")):
            assert plain(f(own)) == plain(f(old))
    assert X.observe(reads, both.where("false")).count() == 0 and X.observe(reads.where("false"), both).count() == 0


def test_merged():
    assert X.merged([("2", 5, 9), ("1", 0, 4), ("1", 6, 7), ("1", 100, 200)], 2, 10) == [("1", 0, 7), ("1", 100, 200), ("2", 5, 9)]
    assert X.merged([("1", 1000 * k, 1000 * k + 1) for k in range(50)], 1, 4) == [("1", 0, 49_001)]
    assert X.merged([("a", 0, 1), ("b", 0, 1)], 1, 1) == [("a", 0, 1), ("b", 0, 1)]


def scans(spark, folder, since):
    """How many times files of the folder were scanned by the executions after one, and with which filters and columns."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = []
    for k in range(since, store.executionsCount()):
        e = store.executionsList(k, 1).head()
        found += [line for line in e.physicalPlanDescription().split("(unknown)")[0].split("\n\n") if "Location: InMemoryFileIndex" in line and folder in line]
    return found


def toy_resources(spark, folder):
    lines = [f"22\t{60_000_000 + 100 * k}\t{60_000_100 + 100 * k}\tn{k}\tnorm\t{0.3 + k / 100}" for k in range(30)] + ["22\t61000000\t61000100\tgene_hapcn1\td67\t0.5", "22\t62000000\t62000100\tspacer_hapcn1\tspacer\t0.5"]
    from tests.test_run import STATES

    words = {p: " ".join(f"{k}:{v}" for q, k, v in STATES if q == p and k is not None) for p in ("mean", "sd", "prior")}
    texts = {
        "regions": "\n".join(lines), "parameters": "\n".join(f"{r}\tshift\t1.0\n" + "\n".join(f"{r}\t{p}\t{w}" for p, w in words.items()) for r in ("d67", "spacer")),
        "sites": "\n".join(f"22\t{42_000_001 + i}\tA\t{42_500_001 + i}\tC\tx" for i in range(117)), "targets": "22\t42128000\tT\t42600001\tG\tg.42128000G>T\n", "homology": "#none\n",
        "stars": "*1\tNA\tNormal\n*2\tg.42128000G>T\tNone\n", "haplotypes": "22\t42000001\tA\t42500001\tC\th1\n22\t42000002\tA\t42500002\tC\th1\n22\t42000003\tA\t42500003\tC\th1\n",
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    return T.resources(spark, str(folder), {k: k for k in texts} | {"haplotype_groups": {k: "h1" for k in ("938", "526_556", "803", "ins_a")}})


def test_a_run_scans_its_reads_twice(spark, tmp_path):
    rows = toy_reads("het", 2, 2, 1) + toy_reads("three", 3, 2, 0)
    spark.createDataFrame(rows, READS).repartitionByRange(3, "chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(str(tmp_path / "reads.parquet"))
    (tmp_path / "d").mkdir()
    res = toy_resources(spark, tmp_path / "d")
    reads = T.reads(spark, str(tmp_path / "reads.parquet"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r["sample_id"]: r for r in G.run(reads, res, G.Options(read_voting=True, phase_disambiguate=True, consistency_check=True)).collect()}
    assert {s: (r["total_cn"], r["tag"], r["genotype"]) for s, r in got.items()} == {"het": (4, "cn2", "*1/*2"), "three": (5, "cn3", "*1/*1x2")}
    looked = scans(spark, "reads.parquet", before)
    assert len(looked) == 2, looked
    narrow, near = sorted(looked, key=len)
    assert "seq" not in narrow.split("ReadSchema")[1] and "cigar" not in narrow.split("ReadSchema")[1]
    assert all(x in near.split("PushedFilters")[1] for x in ("chrom", "pos", "end_pos"))
    # with counts made before, samples and the gene's reads
    counts = I.region_read_counts(reads, res.regions, ["sample_id"]).where("name is not null")
    again = {r["sample_id"]: r["genotype"] for r in G.run(reads, res, counts=counts).collect()}
    assert again == {s: r["genotype"] for s, r in got.items()}


def test_reads_without_regions_keep_their_sample(spark):
    reads = spark.createDataFrame([("a", "q", 0, "22", 10, 14, 60, 0, [("M", 4)], "ACGT", [1]), ("b", "q", 0, "1", 10, 14, 60, 0, [("M", 4)], "ACGT", [1]), (None, "q", 0, "22", 10, 14, 60, 0, [("M", 4)], "ACGT", [1])], READS)
    regions = spark.createDataFrame([("22", 0, 20, "x"), ("22", 12, 20, "y"), ("22", 9, 9, "z")], "chrom string, start long, end long, name string")
    got = sorted(map(tuple, I.region_read_counts(reads, regions, ["sample_id"]).collect()), key=str)
    assert got == sorted([(s, n, int(n == "x" and s != "b")) for s in ("a", "b", None) for n in "xyz"], key=str)
    assert sorted(map(tuple, I.region_read_counts(reads, regions.where("false"), ["sample_id"]).collect()), key=str) == sorted([("a", None, 0), ("b", None, 0), (None, None, 0)], key=str)


def test_command_line_reads_bam(spark, tmp_path):
    import json

    from paraloom.sources import sinks

    d = tmp_path / "d"
    d.mkdir()
    toy_resources(spark, d)
    (d / "names.json").write_text(json.dumps({k: k for k in ("regions", "parameters", "sites", "targets", "homology", "stars")}))
    for sample, rows in (("het", toy_reads("het", 2, 2, 1)), ("three", toy_reads("three", 3, 2, 0))):
        some = sorted([(q, flag, 0, pos, mapq, tlen, cigar, seq) for _, q, flag, _, pos, _, mapq, tlen, cigar, seq, _ in rows], key=lambda x: x[3])
        indexed(tmp_path / f"{sample}.bam", ["chr22"], some, block=20_000)
    cli.main(["-i", f"{tmp_path}/*.bam", "-o", str(tmp_path / "out"), "-d", str(d)], spark)
    found = sinks.read_json("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "json")).collect()))
    assert {s: (x["Total_CN"], x["CNV_group"], x["Genotype"]) for s, x in found.items()} == {"het": (4, "cn2", "*1/*2"), "three": (5, "cn3", "*1/*1x2")}
