"""What reads show at the sites of many tables, found in one pass over the reads.

All site tables of a run make one array sorted by contig and position, which every task has; a read's aligned blocks find their sites in it by binary
search, a batch of reads at once in numpy. No read is shuffled and none stands in several buckets. What comes out is narrow, a row for each read and site
with the few bases from the site on, so it is written once and every counter and pattern is taken from it. More sites than `most`
are joined by position instead (`intervals.site_bases`), with the same rows.

Defined cases: a read without sequence, CIGAR or contig shows nothing; a site inside a deletion or skip has no row; a site that stands in several
tables, or twice in one, has a row for each; no sites and no reads give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.operators import intervals as I
from paraloom.operators.sides import SMALL_ROWS

# CIGAR operations that align bases, that move along the reference, and that move along the read.
ALIGNED, ON_REFERENCE, ON_READ = "M=X", "M=XDN", "M=XIS"
#: Bits of a position in the sorted array; a contig's number stands above them.
POSITION_BITS = 40
OBSERVED = "sample_id string, qname string, flag int, mapq int, tlen long, source string, idx int, side int, qpos long, seq string, alleles1 array<string>, alleles2 array<string>"


def site_rows(sites: DataFrame, source: str) -> DataFrame:
    """(source, idx, side, chrom, pos, alleles1, alleles2): a row for each of the two coordinates of a table's sites."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"pos{k}").alias("pos")) for k in (1, 2)])).alias("at")
    rows = sites.select(F.col("idx").cast("int").alias("idx"), "chrom", "alleles1", "alleles2", both)
    return rows.select(F.lit(source).alias("source"), "idx", "at.side", "chrom", F.col("at.pos").cast("long").alias("pos"), "alleles1", "alleles2").where("chrom is not null and pos is not null")


def _width():
    """Bases that an observation keeps: all that the longer side's alleles can ask for, and one more, which tells whether the read goes on."""
    return F.greatest(*[F.coalesce(F.length(F.array_join(a, ",")), F.lit(0)) for a in ("alleles1", "alleles2")]) + 1


class SiteArray:
    """Sites in order of contig and position."""

    def __init__(self, rows: list):
        self.contigs = sorted({r["chrom"] for r in rows})
        code = {c: k for k, c in enumerate(self.contigs)}
        rows = sorted(rows, key=lambda r: (code[r["chrom"]], r["pos"], r["source"], r["idx"], r["side"]))
        self.pos = np.array([r["pos"] for r in rows], dtype=np.int64)
        self.keys = np.array([code[r["chrom"]] << POSITION_BITS | r["pos"] for r in rows], dtype=np.int64)
        self.width = np.array([r["width"] for r in rows], dtype=np.int64)
        alleles = lambda name: pa.array([r[name] for r in rows], pa.list_(pa.string()))
        self.columns = [pa.array([r["source"] for r in rows], pa.string()), pa.array([r["idx"] for r in rows], pa.int32()), pa.array([r["side"] for r in rows], pa.int32())]
        self.alleles = [alleles("alleles1"), alleles("alleles2")]

    def observe(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The observations of reads (sample_id, qname, flag, mapq, tlen, chrom, pos, cigar, seq)."""
        sample, qname, flag, mapq, tlen, chrom, pos, cigar, seq = batch.columns
        contig = pc.fill_null(pc.index_in(chrom, value_set=pa.array(self.contigs, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = pc.fill_null(pos, 0).to_numpy(zero_copy_only=False)
        ops, lengths = (cigar.flatten().field(k) for k in ("op", "len"))
        length = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = pc.fill_null(pc.list_value_length(cigar), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        is_any = lambda letters: pc.fill_null(pc.is_in(ops, value_set=pa.array(list(letters))), False).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), each)
        first = np.repeat(np.cumsum(each) - each, each)

        def before(moves: np.ndarray) -> np.ndarray:
            """How far each operation's read has moved before it."""
            total = np.cumsum(np.where(moves, length, 0)) - np.where(moves, length, 0)
            return total - total[first]

        on_reference, on_read = before(is_any(ON_REFERENCE)), before(is_any(ON_READ))
        block = np.flatnonzero(is_any(ALIGNED) & (contig[row] >= 0))
        low = start[row[block]] + on_reference[block]
        base = contig[row[block]] << POSITION_BITS
        a, b = np.searchsorted(self.keys, base | low), np.searchsorted(self.keys, base | (low + length[block]))
        n = b - a
        of = np.repeat(np.arange(len(block)), n)
        site = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a[of]
        read = row[block[of]]
        qpos = on_read[block[of]] + self.pos[site] - low[of]
        text = pc.fill_null(seq, "").cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1, offset=8 * text.offset)
        size = np.diff(ends)
        kept = np.clip(np.minimum(self.width[site], size[read] - qpos), 0, None)
        stops = np.cumsum(kept)
        letters = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        places = np.arange(int(kept.sum())) - np.repeat(stops - kept - (ends[:-1][read] + qpos), kept)
        bases = pa.Array.from_buffers(pa.large_string(), len(site), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64).tobytes()), pa.py_buffer(letters[places].tobytes())])
        read, site = pa.array(read), pa.array(site)
        columns = [*[x.take(read) for x in (sample, qname, flag, mapq, tlen)], *[x.take(site) for x in self.columns], pa.array(np.zeros(len(site), dtype=np.int64)), bases.cast(pa.string()), *[x.take(site) for x in self.alleles]]
        return pa.RecordBatch.from_arrays(columns, names=[f.rsplit(" ", 1)[0] for f in OBSERVED.split(", ")])


def observe(reads: DataFrame, sites: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """(OBSERVED) of pileup reads at sites (source, idx, side, chrom, pos, alleles1, alleles2).

    `seq` begins at the site (qpos is 0) and is cut behind what the site's alleles can ask for, so what takes site_bases takes these rows.
    """
    use = reads.where(F.col("flag").bitwiseAND(I.NOT_PILEUP) == 0)
    sites = sites.withColumn("width", _width())
    known = sites.limit(most + 1).collect()
    if len(known) > most:
        found = I.site_bases(use, sites)
        piece = F.when(F.col("qpos") < F.length("seq"), F.col("seq").substr(F.col("qpos").cast("int") + 1, F.col("width"))).otherwise("")
        return found.select("sample_id", "qname", "flag", "mapq", F.col("tlen").cast("long").alias("tlen"), "source", "idx", "side", F.lit(0).cast("long").alias("qpos"), F.coalesce(piece, F.lit("")).alias("seq"), "alleles1", "alleles2")
    array = SiteArray(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield array.observe(batch)

    return use.select("sample_id", "qname", F.col("flag").cast("int"), F.col("mapq").cast("int"), F.col("tlen").cast("long"), "chrom", F.col("pos").cast("long"), "cigar", "seq").mapInArrow(run, OBSERVED)


def at_sites(observed: DataFrame, source: str, sides: tuple[int, ...] = (1, 2), min_mapq: int = 0, min_span: int = 0) -> DataFrame:
    """The observations of one table at one coordinate or both, of reads that count."""
    return observed.where((F.col("source") == source) & F.col("side").isin(*sides) & (F.col("mapq") >= min_mapq) & (F.abs("tlen") >= min_span))


def merged(intervals: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[str, int, int]]:
    """Intervals in order, those nearer than a gap joined; the gap grows until there are few."""
    out = sorted(intervals)
    while True:
        made: list[tuple[str, int, int]] = []
        for chrom, start, end in out:
            if made and made[-1][0] == chrom and start - made[-1][2] <= gap:
                made[-1] = (chrom, made[-1][1], max(end, made[-1][2]))
            else:
                made.append((chrom, start, end))
        if len(made) <= max(most, len({c for c, _, _ in made})):
            return made
        gap *= 4


def overlapping_reads(reads: DataFrame, intervals: list[tuple[str, int, int]]) -> DataFrame:
    """Reads that overlap one of a few intervals; the bounds reach the scan, which skips row groups or blocks by them."""
    if not intervals:
        return reads.where("false")
    # the hull stands beside the stretches: sources that take no alternatives take it
    reads = reads.where(F.col("chrom").isin(*sorted({c for c, _, _ in intervals})) & (F.col("pos") < max(e for _, _, e in intervals)) & (F.col("end_pos") > min(s for _, s, _ in intervals)))
    hit = [(F.col("chrom") == c) & (F.col("pos") < e) & (F.col("end_pos") > s) for c, s, e in intervals]
    return reads.where(reduce(lambda a, b: a | b, hit))
