"""Indexed BAM files as a Spark data source: many tasks a file, and only the blocks that a stretch needs.

`spark.read.format("paraloom_bam").load(path)` plans its tasks from the index beside each file (`<file>.bai`, or the name with `.bai` for `.bam`): the index names places where
records begin, so a file is cut there into pieces of about `splitBytes` compressed bytes, whatever its size. Filters on chrom, pos and end_pos that Spark pushes, and the option
`intervals` (contig:start-end, comma-separated), are looked up in the index's bins and linear offsets, so blocks of other places are not read. A
file without an index is one task that reads it as a stream. Files are opened by pyarrow's file systems (local, HDFS, S3, GCS); other stores go through
`alignment.read_bam`. Records without a contig are left out; contigs lose their `chr`; the sample is the file's name without its ending.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from paraloom.sources.alignment import BATCH, batch_of, record
from paraloom.sources.tables import READS

NAME = "paraloom_bam"
#: Compressed bytes of a task, and of one look into a file.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Pieces of a file with fewer compressed bytes between them are read as one.
NEAR = 1 << 16
# The numbers of the first bins of the index's levels and the shifts of their widths, the width of a linear stretch, and the bin of counts.
FIRST_BINS, BIN_SHIFTS, LINEAR_SHIFT, COUNTS_BIN = (0, 1, 9, 73, 585, 4681), (29, 26, 23, 20, 17, 14), 14, 37450
END = 1 << 62


def opened(path: str):
    """(file, size): a file of random access, in whatever store pyarrow knows."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(place), system.get_file_info(place).size


def found_files(path: str) -> list[str]:
    """The BAM files of a path, a folder or a pattern, in order."""
    from pyarrow import fs

    head, _, tail = path.rpartition("/")
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    system, place = fs.FileSystem.from_uri(path) if scheme and not any(c in tail for c in "*?[") else (fs.FileSystem.from_uri(head) if scheme else (fs.LocalFileSystem(), head))
    named = lambda x: f"{scheme}{x.path}" if scheme and scheme != "file://" else x.path
    if not any(c in tail for c in "*?["):
        info = system.get_file_info(place if scheme else path)
        if info.type != fs.FileType.Directory:
            return [path]
        place, tail = info.path, "*.bam"
    some = system.get_file_info(fs.FileSelector(place or "."))
    return sorted(named(x) for x in some if fnmatch.fnmatch(x.base_name, tail) and x.base_name.endswith(".bam"))


class Blocks:
    """A blocked file's bytes from a virtual offset on: (virtual offset, bytes) of each block, read and inflated one after the other."""

    def __init__(self, path: str):
        self.file, self.size = opened(path)

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at)

    def since(self, start: int, stop: int = END) -> Iterator[tuple[int, bytes]]:
        """(place, content) of the blocks from the compressed offset `start` to the one at `stop`, looked at in pieces that end there."""
        held, at = b"", start
        while at < self.size and at <= stop:
            if len(held) < 18 or len(held) < (need := self._length(held)):
                need = 18 if len(held) < 18 else need
                wanted = max(need - len(held), min(READ_BYTES, max(0, stop - at - len(held)) + (1 << 16)))
                more = self.read_at(wanted, at + len(held))
                if not more:
                    return  # cut off
                held += more
                continue
            extra = struct.unpack_from("<H", held, 10)[0]
            content = zlib.decompress(held[12 + extra : need - 8], -15)
            yield at, content
            held, at = held[need:], at + need

    @staticmethod
    def _length(held: bytes) -> int:
        """The compressed length of the block that begins here."""
        if held[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked file")
        extra, at = struct.unpack_from("<H", held, 10)[0], 12
        while at < 12 + extra:
            kind, n = held[at : at + 2], struct.unpack_from("<H", held, at + 2)[0]
            if kind == b"BC":
                return struct.unpack_from("<H", held, at + 4)[0] + 1
            at += 4 + n
        raise ValueError("a block without its length")

    def header(self) -> tuple[list[str], int]:
        """(contigs, virtual offset of the first record)."""
        content, places = b"", []
        for place, block in self.since(0):
            places.append((len(content), place))
            content += block
            try:
                if content[:4] != b"BAM\1":
                    raise ValueError("not a BAM file")
                at = 8 + struct.unpack_from("<i", content, 4)[0]
                n, at, names = struct.unpack_from("<i", content, at)[0], at + 4, []
                for _ in range(n):
                    size = struct.unpack_from("<i", content, at)[0]
                    if at + 8 + size > len(content):
                        raise struct.error
                    names.append(content[at + 4 : at + 3 + size].decode())
                    at += 8 + size
            except struct.error:
                continue
            begin, place = max(x for x in places if x[0] <= at)
            return names, place << 16 | (at - begin)
        raise ValueError("not a BAM file")

    def bodies(self, start: int, stop: int) -> Iterator[bytes]:
        """The records that begin between two virtual offsets; what is cut off at the end is left out."""
        rest, rest_at = b"", start
        for place, block in self.since(start >> 16, min(stop >> 16, self.size)):
            if not rest and place == start >> 16:
                block, base = block[start & 0xFFFF :], start & 0xFFFF
            else:
                base = 0
            shift = len(rest)
            held, at = rest + block, 0
            while True:
                own = rest_at if at < shift else place << 16 | (at - shift + base)
                if own >= stop:
                    return
                if len(held) < at + 4 or len(held) < at + 4 + (n := struct.unpack_from("<i", held, at)[0]):
                    break
                yield held[at + 4 : at + 4 + n]
                at += 4 + n
            rest, rest_at = held[at:], own
        # the last record of the piece may go on in blocks beyond it
        if rest and rest_at < stop < END:
            for _, block in self.since(self._after(min(stop >> 16, self.size))):
                rest += block
                if len(rest) >= 4 and len(rest) >= 4 + (n := struct.unpack_from("<i", rest)[0]):
                    yield rest[4 : 4 + n]
                    return

    def _after(self, place: int) -> int:
        head = self.read_at(1 << 16, place)
        return place + self._length(head) if len(head) >= 18 else self.size


class Index:
    """A file's .bai: for each contig the pieces of its bins and the linear offsets."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\1":
            raise ValueError("not an index")
        n, at = struct.unpack_from("<i", data, 4)[0], 8
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.linear: list[tuple[int, ...]] = []
        for _ in range(n):
            bins, (count,), at = {}, struct.unpack_from("<i", data, at), at + 4
            for _ in range(count):
                number, pieces = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * pieces}Q", data, at + 8)
                at += 8 + 16 * pieces
                if number != COUNTS_BIN:
                    bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            (count,) = struct.unpack_from("<i", data, at)
            self.linear.append(struct.unpack_from(f"<{count}Q", data, at + 4))
            at += 4 + 8 * count
            self.bins.append(bins)

    def starts(self) -> list[int]:
        """Places where records begin, in order."""
        return sorted({a for bins in self.bins for pieces in bins.values() for a, _ in pieces} | {x for some in self.linear for x in some if x})

    def pieces(self, contig: int, start: int, end: int) -> list[tuple[int, int]]:
        """What must be read for the records that overlap a stretch, in order and without overlaps."""
        if contig >= len(self.bins):
            return []
        start, end = max(0, start), min(end, 1 << 29)
        linear = self.linear[contig]
        least = linear[min(start >> LINEAR_SHIFT, len(linear) - 1)] if linear and start >> LINEAR_SHIFT < len(linear) else 0
        some = []
        for first, shift in zip(FIRST_BINS, BIN_SHIFTS, strict=True):
            low, high = first + (start >> shift), first + (max(start, end - 1) >> shift)
            numbers = range(low, high + 1) if high - low < len(self.bins[contig]) else [b for b in self.bins[contig] if low <= b <= high]
            some += [(max(a, least), b) for k in numbers for a, b in self.bins[contig].get(k, []) if b > least]
        return union(some)


def union(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces in order; those that overlap or stand nearer than NEAR are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a >> 16 <= (out[-1][1] >> 16) + NEAR:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def dealt(pieces: list[tuple[int, int]], starts: list[int], size: int, split: int) -> list[list[tuple[int, int]]]:
    """Pieces cut at places where records begin, in groups of about `split` compressed bytes."""
    cut: list[tuple[int, int]] = []
    for a, b in pieces:
        for x in starts[bisect_left(starts, a + 1) : bisect_left(starts, b)]:
            if (x >> 16) - (a >> 16) >= split:
                cut.append((a, x))
                a = x
        cut.append((a, b))
    groups: list[list[tuple[int, int]]] = []
    held = 0
    for a, b in cut:
        n = (min(b, size << 16) >> 16) - (a >> 16)
        if not groups or held + n > split:
            groups.append([])
            held = 0
        groups[-1].append((a, b))
        held += n
    return groups


class Piece(InputPartition):
    """A task: some pieces of one file, and the stretches that its records must overlap (None: all)."""

    def __init__(self, path: str, contigs: list[str], pieces: list[tuple[int, int]], wanted: list[tuple[str, int, int]] | None, indexed: bool = True):
        super().__init__(None)
        self.path, self.contigs, self.pieces, self.wanted, self.indexed = path, contigs, pieces, wanted, indexed


def stretches(text: str) -> list[tuple[str, int, int]]:
    """contig:start-end, comma-separated, half open and 0-based."""
    out = []
    for x in filter(None, text.split(",")):
        contig, _, place = x.rpartition(":")
        start, end = place.split("-")
        out.append((contig.removeprefix("chr"), int(start), int(end)))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.intervals = stretches(options["intervals"]) if options.get("intervals") is not None else None
        self.contigs: set[str] | None = None
        self.low, self.high = 0, END

    def pushFilters(self, filters):
        """Bounds of contig and place narrow what is read; Spark still checks every filter."""
        for f in filters:
            column, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
            if column == ("chrom",) and isinstance(f, (EqualTo, In)):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.contigs = some if self.contigs is None else self.contigs & some
            elif column == ("pos",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif column in (("pos",), ("end_pos",)) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                # a record that begins at a place reaches it; one that ends behind it overlaps it
                self.low = max(self.low, value - (column == ("end_pos",) and isinstance(f, GreaterThanOrEqual)))
            yield f

    def wanted(self, contigs: list[str]) -> list[tuple[str, int, int]] | None:
        """The stretches to read: those of the option within the pushed bounds; None for all."""
        if self.intervals is None and self.contigs is None and self.low == 0 and self.high == END:
            return None
        some = self.intervals if self.intervals is not None else [(c.removeprefix("chr"), 0, END) for c in contigs]
        kept = [(c, max(a, self.low), min(b, self.high)) for c, a, b in some if self.contigs is None or c in self.contigs]
        return [x for x in kept if x[1] < x[2]]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in found_files(self.path):
            with Blocks(path) as file:
                contigs, first = file.header()
                size = file.size
            index = None
            for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
                try:
                    handle, n = opened(name)
                except OSError:
                    continue
                with handle:
                    index = Index(handle.read_at(n, 0))
                break
            wanted = self.wanted(contigs)
            number = {c.removeprefix("chr"): k for k, c in enumerate(contigs)}
            if index is None:
                out.append(Piece(path, contigs, [(first, END)], wanted, False))
                continue
            starts = index.starts()
            if wanted is None:
                out += [Piece(path, contigs, some, None) for some in dealt([(first, END)], starts, size, self.split)]
            for c in sorted({c for c, _, _ in wanted or []} & set(number)):  # a piece is of one contig
                own = [x for x in wanted if x[0] == c]
                pieces = union([x for _, a, b in own for x in index.pieces(number[c], a, b)])
                out += [Piece(path, contigs, some, own) for some in dealt(pieces, starts, size, self.split)]
        # Spark wants a task at least
        return out or [Piece("", [], [], [])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            return
        sample = partition.path.rpartition("/")[2].removesuffix(".bam")
        by_contig: dict[str, list[tuple[int, int]]] = {}
        for c, a, b in partition.wanted or []:
            by_contig.setdefault(c, []).append((a, b))
        last = {c: max(b for _, b in some) for c, some in by_contig.items()}
        rows: list[tuple] = []
        indexed = partition.indexed
        with Blocks(partition.path) as file:
            for start, stop in partition.pieces:
                for body in file.bodies(start, stop):
                    ref, pos = struct.unpack_from("<ii", body)
                    if ref < 0:
                        continue
                    if partition.wanted is not None:
                        contig = partition.contigs[ref].removeprefix("chr")
                        own = by_contig.get(contig, ())
                        if indexed and pos >= last.get(contig, END):
                            break  # records stand in order, so what follows in this piece begins behind the stretches too
                        if not any(pos < b for _, b in own):
                            continue
                        row = record(body, partition.contigs)
                        # what has no length on the reference stands at its place
                        if not any(pos < b and max(row[4], pos + 1) > a for a, b in own):
                            continue
                    else:
                        row = record(body, partition.contigs)
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch_of(sample, rows)
                        rows = []
        if rows:
            yield batch_of(sample, rows)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def read_indexed(spark: SparkSession, path: str, intervals: list[tuple[str, int, int]] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of BAM files, with the columns of READS; of records that overlap some stretches where those are given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    reader = spark.read.format(NAME).option("splitBytes", split_bytes)
    if intervals is not None:
        reader = reader.option("intervals", ",".join(f"{c}:{a}-{b}" for c, a, b in intervals))
    return reader.load(path)


def readable(path: str) -> bool:
    """Whether pyarrow can open files of this store."""
    try:
        return bool(found_files(path))
    except (OSError, ValueError, pa.ArrowInvalid, NotImplementedError):
        return False
