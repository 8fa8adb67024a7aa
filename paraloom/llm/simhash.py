"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are merged first, so a group of copies is one
fingerprint. Fingerprints within a Hamming distance are found on the ring of segments: if they differ in d bits or fewer, some
segment starts a chain whose cumulative differences over l segments stay within l * d / m for every l. The longest prefix
of a chain that must be free of differences is the join key; the rest of the chain is checked before the
full distance. A group of fingerprints that share a key is split again by a further part of the other bits as long as it is large, which loses
no pair: among d + 1 parts with d differences one is equal. A group gives the edges of a spanning forest, not its pairs.

The pipeline's stage links texts whose sets of NEAR_WORDS-word shingles have a Jaccard similarity of SIMILARITY as well, since two bits of 64 reach few of them: candidates
share a band of BANDS x ROWS minimum hashes (a pair at 0.8 shares none with probability 6e-7) and are checked on the whole sets (of 32-bit hashes).
First every member of a band's group is checked against the member that shares most bands, which connects a group of near copies by as many checks as it has
members; only groups that are not connected by then are checked pair by pair, in tiles, what is connected already aside.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; fewer words than a shingle
has are one shingle; repeated rows have equal fingerprints; a row with a null doc_id gets a fingerprint and the component
of its links, and never names one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm.common import cut, let_go, numbered, read_table, renamed, small, trim
from paraloom.llm.components import components

SHINGLE, DISTANCE, SEGMENTS = 3, 2, 5
SEED = 42
#: Groups of fingerprints that share a key are split further above this size.
GROUP = 512
#: Words of a shingle and least Jaccard similarity of the stage's near copies, as a fraction.
NEAR_WORDS, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 20, 3
#: Candidates that are checked against each other at once (larger groups go by pairs of parts), and members of a centre that one task checks.
PART, DEAL = 4096, 1024
#: Bytes of the sets of a part at most, about; a tile has two parts.
PART_BYTES = 8 << 20
#: Texts of candidates that are looked up by broadcast at most.
BROADCAST_IDS = 1_000_000
_A = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, max(NEAR_WORDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six white spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    if shingle == 3:
        hashes = [xxh64_intdigest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(len(words) - shingle + 1)]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[k : k + (1 << 14)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, fp long")


def ring(segments: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of each segment, the first on the left."""
    cuts = [bits * k // segments for k in range(segments + 1)]
    return [(bits - b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def free_prefix(segments: int, distance: int) -> int:
    """How many segments at a chain's start must be equal: those with l * distance / segments below 1."""
    return -(-segments // distance) - 1


def linked_pairs(fps: np.ndarray, start: int, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group whose chain from start holds and whose distance is within the limit."""
    order = [(start + k) % segments for k in range(segments)]
    left, right = [], []
    for k in range(0, len(fps), 256):
        differ = fps[k : k + 256, None] ^ fps[None, :]
        ok, total = np.arange(k, min(k + 256, len(fps)))[:, None] < np.arange(len(fps))[None, :], 0
        a, b = np.nonzero(ok)
        x = differ[a, b]
        for n, (shift, width) in enumerate([ring(segments)[i] for i in order], start=1):
            total = total + np.bitwise_count(x >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            keep = total * segments <= n * distance
            a, b, x, total = a[keep], b[keep], x[keep], total[keep]
        full = np.bitwise_count(x) <= distance
        left.append(a[full] + k)
        right.append(b[full])
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, one fewer than nodes at most."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _keyed(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """(fp, start, key, rest): each fingerprint once for every start of a chain; rest has the bits outside the prefix."""
    prefix, parts = free_prefix(segments, distance), ring(segments)
    keys = []
    for start in range(segments):
        order = [parts[(start + k) % segments] for k in range(segments)]
        key = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in order[:prefix]]
        rest = F.lit(0).cast("long")
        for s, w in order[prefix:]:
            rest = F.shiftleft(rest, w).bitwiseOR(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)))
        keys.append(F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(start), *key).alias("key"), rest.alias("rest")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def _split(rows: DataFrame, distance: int, width: int) -> tuple[DataFrame, int]:
    """The rows once for each of distance + 1 parts of their rest's width bits, the part in the key: one part is equal in any pair. With the width that is left."""
    cuts = [width * k // (distance + 1) for k in range(distance + 2)]
    parts = []
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = F.shiftrightunsigned("rest", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        others = F.shiftleft(F.shiftrightunsigned("rest", b), a).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << a) - 1)))
        parts.append(F.struct(F.xxhash64("key", F.lit(n), part).alias("key"), others.alias("rest")))
    out = rows.select("fp", "start", F.explode(F.array(*parts)).alias("k")).select("fp", "start", "k.*")
    return out, width - min(b - a for a, b in zip(cuts, cuts[1:], strict=False))


def linked_edges(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, group: int | None = None) -> DataFrame:
    """(a, b): fingerprints within the distance; within a group of equal keys (split while over `group`, GROUP by default) a spanning forest of its links."""
    group = group or GROUP
    prefix = free_prefix(segments, distance)
    if prefix < 1:
        raise ValueError("the ring has too few segments for the distance")

    def link(x: pd.DataFrame) -> pd.DataFrame:
        fps = x["fp"].to_numpy(np.int64).view(np.uint64)
        edges = forest(len(fps), *linked_pairs(fps, int(x["start"].iloc[0]), distance, segments)) if len(fps) > 1 else []
        at = np.array(edges, dtype=np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[at[:, 0]], "b": signed[at[:, 1]]})

    found, rows, width = None, _keyed(nodes, distance, segments), max(sum(ring(segments)[(s + k) % segments][1] for k in range(prefix, segments)) for s in range(segments))
    while True:
        # groups of one have no pair; the count is aggregated before the rows are dealt
        sizes = cut(rows.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"))
        large = width > 2 * (distance + 1) and not sizes.where(F.col("n") > group).isEmpty()
        small = rows.join((sizes.where(F.col("n") <= group) if large else sizes).drop("n"), ["start", "key"], "left_semi")
        edges = small.groupBy("start", "key").applyInPandas(link, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not large:
            return found
        # a large group is split until it is small, or its bits are nearly used up, so that it cannot be large
        rows, width = _split(rows.join(sizes.where(F.col("n") > group).drop("n"), ["start", "key"], "left_semi"), distance, width)
        rows = cut(rows)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's NEAR_WORDS-word shingles; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    words = np.array([xxh64_intdigest(w, SEED) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    width = min(NEAR_WORDS, len(words))
    if not width:
        return words.astype(np.uint32)
    hashes = sum(words[k : len(words) - width + 1 + k] * _MIX[k] for k in range(width))
    hashes = (hashes ^ hashes >> np.uint64(31)) * _MIX[0]
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def set_id(found: np.ndarray) -> int | None:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else None


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key a band of minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 1 << 10):
        least = np.minimum(least, ((found[k : k + (1 << 10), None].astype(np.uint64) ^ _A[0]) * _A[1]).min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, sid, keys): the fingerprint, the set's hash (null without words) and its band keys."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                fps, sids, keys = [], [], []
                for x in part.column(1):
                    text = x.as_py()
                    found = shingle_set(text)
                    fps.append(fingerprint(text, shingle))
                    sids.append(set_id(found))
                    keys.append(band_keys(found) if len(found) else [])
                columns = [part.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sid", "keys"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, fp long, sid long, keys array<long>")


def similar(sets: list[np.ndarray], other: np.ndarray) -> np.ndarray:
    """Which sets have a Jaccard similarity of SIMILARITY or more to another."""
    top, bottom = SIMILARITY
    both = np.array([np.isin(x, other, assume_unique=True).sum() for x in sets], dtype=np.int64)
    return bottom * both >= top * (np.array([len(x) for x in sets], dtype=np.int64) + len(other) - both)


def similar_forest(sets: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
    """Edges of a spanning forest of the pairs whose Jaccard similarity is SIMILARITY or more; sets of one group are connected already."""
    sizes = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    group = np.arange(len(sets)) if group is None else group.copy()
    mark, (top, bottom), edges = np.zeros(at.max() + 1, dtype=bool), SIMILARITY, []
    for k in range(len(sets) - 1):
        rest = group[k + 1 :] != group[k]
        if not rest.any():
            continue
        own = at[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        both = np.add.reduceat(mark[at[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1], dtype=np.int64)
        mark[own] = False
        met = np.flatnonzero(rest & (bottom * both >= top * (sizes[k] + sizes[k + 1 :] - both))) + k + 1
        others, first = np.unique(group[met], return_index=True)
        edges += [(k, m) for m in met[first].tolist()]
        group[np.isin(group, others)] = group[k]
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, broadcast_ids: int) -> DataFrame:
    """(sid, found): the set of each document that is wanted (doc_id), once for each set; documents without an id are looked up as well."""
    ids = wanted.select(F.col("doc_id").alias("__id")).where(F.col("__id").isNotNull()).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    texts = texts.join(small(ids, broadcast_ids), "__id", "left_semi").unionByName(texts.where(F.col("__id").isNull())).select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                found = [shingle_set(x.as_py()) for x in batch.column(0).slice(first, 1024)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["sid", "found"])
        trim()

    return texts.mapInArrow(compute, "sid long, found binary").where(F.col("sid").isNotNull()).dropDuplicates(["sid"])


def star_links(pairs: DataFrame, sets: DataFrame, deal: int = DEAL) -> DataFrame:
    """(x, y): the pairs (centre, sid) whose sets are similar; a centre with very many members is dealt to several tasks."""
    centres = cut(pairs.groupBy("centre").agg(F.ceil(F.count("*") / deal).alias("parts")))
    left = pairs.join(centres, "centre").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts"))).select("centre", "part", "sid").join(sets, "sid")
    hubs = centres.select(F.col("centre").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("deal"))
    right = hubs.join(sets.select(F.col("sid").alias("hub"), F.col("found").alias("own")), "hub")

    def check(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64)})
        ok = similar([np.frombuffer(v, np.uint32) for v in x["found"]], np.frombuffer(y["own"].iloc[0], np.uint32))
        sids = x["sid"].to_numpy(np.int64)[ok]
        return pd.DataFrame({"x": sids, "y": np.full(len(sids), y["hub"].iloc[0], np.int64)})

    return left.groupBy("centre", "part").cogroup(right.groupBy("hub", "deal")).applyInPandas(check, "x long, y long")


def near_edges(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, broadcast_ids: int = BROADCAST_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(a, b): fingerprints of texts whose shingle sets are equal or similar; marked has the rows of sketches."""
    held = marked.where(F.col("sid").isNotNull())
    of_set = cut(held.groupBy("sid").agg(F.min("fp").alias("least"), F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))
    equal = held.select("sid", "fp").distinct().join(of_set.select("sid", "least"), "sid").where(F.col("fp") != F.col("least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    bands = of_set.select("sid", F.posexplode("keys").alias("band", "key"))
    # the key stands twice in the joins: else they would reuse the aggregation's partitions, and a hot band's could not be split
    twice = F.xxhash64("key").alias("key2")
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(bands.select("*", twice).join(sizes.select("*", twice), ["band", "key", "key2"]))
    shared = met.groupBy("sid").agg(F.sum(F.col("n") - 1).alias("shared"))
    placed = cut(met.join(shared, "sid"))
    centre = cut(placed.groupBy("band", "key").agg(F.max(F.struct("shared", "sid"))["sid"].alias("centre"))).select("*", twice)
    stars = placed.join(centre, ["band", "key", "key2"]).where("sid <> centre").select("centre", "sid").distinct()
    sets = cut(shingle_sets(docs, of_set.join(shared.select("sid"), "sid", "left_semi"), id_col, text_col, broadcast_ids))
    links = cut(star_links(cut(stars), sets))
    joined = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    grouped = cut(placed.select("sid", "band", "key", "key2", "n").join(joined, F.col("sid") == F.col("node"), "left").select("sid", "band", "key", "key2", "n", F.coalesce("component", "sid").alias("group")))
    members = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"m{k}") for k in (1, 2)]
    open_ = grouped.groupBy("band", "key").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("n"), *members).where("g1 <> g2")
    # groups with the same members in several bands are checked once
    open_ = cut(open_.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("k")).select("k.*").select("*", twice))
    # a tile is bounded by its rows and by the bytes of their sets
    weights = sets.select("sid", F.length("found").cast("long").alias("bytes"))
    heavy = grouped.join(open_, ["band", "key", "key2"]).select("band", "key", "sid").join(weights, "sid").groupBy("band", "key").agg(F.sum("bytes").alias("bytes"))
    open_ = open_.join(heavy, ["band", "key"])
    parts = F.ceil(F.greatest(F.col("n") / part, F.col("bytes") / part_bytes))
    mine = F.pmod(F.xxhash64(F.lit(5), "sid"), parts)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    rows = grouped.join(open_, ["band", "key", "key2"]).select("sid", "band", "key", "group", F.explode(tiles).alias("t")).select("sid", "band", "key", "group", "t.*").join(sets, "sid")

    def link(x: pd.DataFrame) -> pd.DataFrame:
        at, sids = similar_forest([np.frombuffer(v, dtype=np.uint32) for v in x["found"]], x["group"].to_numpy(np.int64)), x["sid"].to_numpy(np.int64)
        return pd.DataFrame({"x": sids[at[:, 0]], "y": sids[at[:, 1]]})

    more = rows.groupBy("band", "key", "i", "j").applyInPandas(link, "x long, y long")
    fp = lambda side, name: of_set.select(F.col("sid").alias(side), F.col("least").alias(name))
    found = links.unionByName(more).distinct().join(fp("x", "a"), "x").join(fp("y", "b"), "y").where(F.col("a") != F.col("b")).select("a", "b")
    return equal.unionByName(found).distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, near: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to, the row's own included; with near, similar shingle sets link too."""
    marked = cut(sketches(docs, id_col, text_col, shingle) if near else fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = linked_edges(nodes.select("fp"), distance)
    found = components(edges.unionByName(near_edges(docs, marked, id_col, text_col)) if near else edges)
    grouped = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    ids = grouped.join(least, "group").select("fp", "component_id")
    return marked.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; of rows that repeat a doc_id one stays, the first by text, lang, source, n_chars and
    then its other columns in order (maps aside); rows without doc_id stay.

    The ids that go are looked up by broadcast while they are few, so that texts stay where they are.
    """
    marked = dedup(docs, near=True).where(F.col("doc_id").isNotNull())
    of_id = marked.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("keep"), F.count("*").alias("n"))
    odd = cut(of_id.where("not keep or n > 1").select(F.col("doc_id").alias("id"), F.col("keep").alias("repeated")))
    names = docs.columns
    rows = numbered(docs, names).withColumn("own", F.col(f"c{names.index('doc_id')}").cast("long")).join(small(odd, broadcast_ids), F.col("own") == F.col("id"), "left")
    whole = renamed(rows.where("id is null"), names)
    if odd.where("repeated").isEmpty():
        return whole
    lead = [f"c{names.index(c)}" for c in ("text", "lang", "source", "n_chars") if c in names]
    kinds = dict(rows.dtypes)
    order = lead + [c for c in (f"c{k}" for k in range(len(names))) if c not in lead and not any(x in kinds[c] for x in ("map<", "variant", "interval"))]
    # an aggregation, so that each task passes one row of an id on
    least = rows.where("repeated").groupBy("own").agg(F.min_by(F.struct(*[f"c{k}" for k in range(len(names))]), F.struct(*order)).alias("row"))
    first = least.select("row.*")
    return whole.unionByName(renamed(first, names))
