"""Reads, pileups, read-level evidence and decisions bound to the driver's tables, each with its SQL.

A row of lineitem stands for a read: the supplier tells the sample, the order the fragment, the part where it lies and what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import scalar as S
from paraloom.operators import calls as C
from paraloom.operators import evidence as E
from paraloom.operators import haplotypes as H
from paraloom.operators import intervals as I
from paraloom.operators import match as M
from paraloom.operators import reads as R
from paraloom.operators import site_index as X
from paraloom.operators.sides import small
from paraloom.plans import genotype as G
from paraloom.plans.base_queries import r6, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL of the models, from a table to a table ----


def poisson_sql(name: str, source: str, keys: str, least: int) -> str:
    """CTEs that end in `name` (keys, cn1, p1, cn2) of a source (keys, cn, n1, n2) whose keys are unique."""
    fits = f"cn > 0 AND n1 + n2 > 0 AND NOT (cn = 1 AND n1 > {least})"
    return f"""{name}_i AS (SELECT {keys}, cn, n1, n2, unnest(range(0, cn + 1)) AS i FROM {source} WHERE {fits}),
{name}_l AS (SELECT *, least(n1, n2) * ln(rate) - rate AS l FROM (SELECT *, CASE WHEN i = 0 THEN (n1 + n2) * (0.1::DOUBLE / 3) WHEN i = cn THEN (n1 + n2) * 0.9::DOUBLE ELSE (n1 + n2) * i / cn::DOUBLE END AS rate FROM {name}_i)),
{name}_w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {keys})) AS w FROM {name}_l),
{name}_q AS (SELECT {keys}, CASE WHEN n2 < n1 THEN cn - i ELSE i END AS copies, w / sum(w) OVER (PARTITION BY {keys}) AS post FROM {name}_w),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY post DESC, copies) AS place FROM {name}_q),
{name}_t AS (SELECT {keys}, max(CASE WHEN place = 1 THEN copies END) AS c1, max(CASE WHEN place = 1 THEN post END) AS q1, max(CASE WHEN place = 2 THEN copies END) AS c2 FROM {name}_o GROUP BY {keys}),
{name}_z AS (SELECT s.*, c1, q1, c2, c1 <> 0 AND n1 <= {least} AND n2 >= {least} AS none FROM {source} s LEFT JOIN {name}_t USING ({keys})),
{name} AS (SELECT {keys}, CASE WHEN cn = 0 THEN 0 WHEN cn = 1 AND n1 > {least} THEN 1 WHEN c1 IS NULL THEN NULL WHEN none THEN 0 ELSE c1 END AS cn1,
  CASE WHEN cn = 0 OR (cn = 1 AND n1 > {least}) OR none OR q1 >= 0.9 THEN 1.0 ELSE round_even(q1, 3) END::DOUBLE AS p1,
  CASE WHEN cn = 0 OR (cn = 1 AND n1 > {least}) OR none OR q1 >= 0.9 THEN NULL ELSE c2 END AS cn2 FROM {name}_z)"""


def conversion_sql(cutoff: float) -> str:
    return f"CASE WHEN cn2 IS NULL OR p1 > {cutoff} THEN cn1 END"


def denovo_sql(keep: float, choose: float, total: str | None = None) -> str:
    both = "(cn1 > 0 AND cn2 > 0)" + (f" OR cn1 = {total} OR cn2 = {total}" if total else "")
    return f"CASE WHEN cn2 IS NULL OR p1 > {keep} THEN cn1 WHEN {both} THEN CASE WHEN p1 > {choose} THEN cn1 ELSE least(cn1, cn2) END END"


def fisher_sql(name: str, source: str, keys: str) -> str:
    """CTEs that end in `name` (keys, p) of a source (keys, a, b, c, d)."""
    return f"""{name}_k AS (SELECT {keys}, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM {source}),
{name}_p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM {name}_k),
{name} AS (SELECT {keys}, least(1.0, sum(p) FILTER (WHERE p <= po + 1e-12)) AS p FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY {keys}) AS po FROM {name}_p) GROUP BY {keys})"""


# ---- reads ----

_READS = """r AS (SELECT 's' || (l_suppkey % 5) AS sample_id, l_orderkey::VARCHAR AS qname, CASE l_linenumber WHEN 5 THEN 1024 WHEN 6 THEN 256 WHEN 7 THEN 2048 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END AS flag,
  l_returnflag AS chrom, l_partkey % 2000 AS pos, l_quantity::INT AS mapq, floor(l_extendedprice)::BIGINT AS tlen, ((l_suppkey + l_partkey) % 3)::INT AS c,
  translate(lpad((l_orderkey * 7919 + l_partkey * 31)::VARCHAR, 12, '0'), '0123456789', 'ACGTACGTAC') AS seq FROM lineitem)"""
_SITES = """s AS (SELECT n_nationkey AS idx, ['A', 'N', 'R'][1 + n_nationkey % 3] AS chrom, (n_nationkey * 79) % 2000 + 5 AS pos1, (n_nationkey * 79 + 900) % 2000 + 5 AS pos2,
  CASE WHEN n_nationkey % 2 = 0 THEN ['A'] ELSE ['A', 'CG'] END AS a1, CASE WHEN n_nationkey % 2 = 0 THEN ['C', 'G'] ELSE ['T'] END AS a2 FROM nation)"""


def _hits(where: str, sites: str = "SELECT idx, chrom, pos1 AS pos, a1, a2 FROM s") -> str:
    """CTEs r, s and h (sample_id, qname, flag, seq, idx, a1, a2, qpos): reads over sites."""
    blocks = "CASE c WHEN 0 THEN [{'o': 0, 'q': 0, 'n': 12}] WHEN 1 THEN [{'o': 0, 'q': 2, 'n': 4}, {'o': 7, 'q': 6, 'n': 6}] ELSE [{'o': 0, 'q': 0, 'n': 4}, {'o': 4, 'q': 6, 'n': 6}] END"
    return f"""{_READS}, {_SITES}, b AS (SELECT *, unnest({blocks}) AS k FROM r WHERE (flag & 3328) = 0 AND {where}),
h AS (SELECT b.sample_id, b.qname, b.flag, b.seq, t.idx, t.a1, t.a2, k.q + t.pos - (b.pos + k.o) AS qpos FROM b JOIN ({sites}) t ON b.chrom = t.chrom AND t.pos >= b.pos + k.o AND t.pos < b.pos + k.o + k.n)"""


def lineitem_reads(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem")
    flag = F.when(F.col("l_linenumber") == 5, 1024).when(F.col("l_linenumber") == 6, 256).when(F.col("l_linenumber") == 7, 2048).otherwise(0) + F.when(F.col("l_partkey") % 2 == 0, 16).otherwise(0)
    op = lambda *x: F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in x])
    c = (F.col("l_suppkey") + F.col("l_partkey")) % 3
    cigar = F.when(c == 0, op(("M", 12))).when(c == 1, op(("S", 2), ("M", 4), ("D", 3), ("M", 6))).otherwise(op(("M", 4), ("I", 2), ("M", 6)))
    pos = F.col("l_partkey") % 2000
    seq = F.translate(F.lpad((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31).cast("string"), 12, "0"), "0123456789", "ACGTACGTAC")
    return rows.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sample_id"), F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), F.col("l_returnflag").alias("chrom"), pos.alias("pos"),
        (pos + F.when(c == 0, 12).when(c == 1, 13).otherwise(10)).alias("end_pos"), F.col("l_quantity").cast("int").alias("mapq"), F.floor("l_extendedprice").alias("tlen"), cigar.alias("cigar"), seq.alias("seq"), F.lit(None).cast("array<int>").alias("qual"),
    )


def nation_sites(spark, d) -> DataFrame:
    n, even = F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0
    chrom = F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), n % 3)
    return table(spark, d, "nation").select(
        n.alias("idx"), chrom.alias("chrom"), ((n * 79) % 2000 + 5).cast("long").alias("pos1"), ((n * 79 + 900) % 2000 + 5).cast("long").alias("pos2"),
        F.when(even, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("CG"))).alias("alleles1"), F.when(even, F.array(F.lit("C"), F.lit("G"))).otherwise(F.array(F.lit("T"))).alias("alleles2"),
    )


_COUNTED = """, al AS (SELECT *, unnest(a1) AS a, 1 AS allele FROM h UNION ALL SELECT *, unnest(a2) AS a, 2 AS allele FROM h), ok AS (SELECT * FROM al WHERE qpos + length(a) <= length(seq) AND substr(seq, (qpos + 1)::BIGINT, length(a)) = a)
SELECT sample_id, idx, count(DISTINCT qname) FILTER (WHERE allele = 1) AS n1, count(DISTINCT qname) FILTER (WHERE allele = 2) AS n2, count(DISTINCT qname) FILTER (WHERE allele = 1 AND (flag & 16) = 0) AS n1_fwd, count(DISTINCT qname) FILTER (WHERE allele = 1 AND (flag & 16) <> 0) AS n1_rev FROM ok GROUP BY 1, 2"""


def _counted(spark, d, *args, **more) -> DataFrame:
    sites = nation_sites(spark, d).withColumnRenamed("pos1", "pos").drop("pos2")
    return I.supporting_counts(I.allele_reads(I.site_bases(lineitem_reads(spark, d), sites, *args, **more), ["sample_id"]), ["sample_id"])


@query(f"""WITH {_READS}, g AS (SELECT n_name AS name, ['A', 'N', 'R'][1 + n_nationkey % 3] AS chrom, n_nationkey * 80 AS a, n_nationkey * 80 + 60 AS b FROM nation), k AS (SELECT DISTINCT sample_id FROM r)
SELECT k.sample_id, g.name, count(r.qname) AS count FROM k CROSS JOIN g LEFT JOIN r ON r.sample_id = k.sample_id AND r.chrom = g.chrom AND r.pos >= a AND r.pos < b AND (r.flag & 2304) = 0 GROUP BY 1, 2""")
def p1_primary_counts(spark, d):
    n = F.col("n_nationkey")
    regions = table(spark, d, "nation").select(F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), n % 3).alias("chrom"), F.col("n_name").alias("name"), (n * 80).cast("long").alias("start"), (n * 80 + 60).cast("long").alias("end"))
    return I.region_read_counts(lineitem_reads(spark, d), regions, ["sample_id"], 64)


@query("WITH " + _hits("mapq >= 10", "SELECT idx, chrom, unnest([pos1, pos2]) AS pos, a1, a2 FROM s") + _COUNTED)
def s3_site_index(spark, d):
    # what a run calls: sites in one sorted array, reads find theirs by binary search
    observed = X.observe(lineitem_reads(spark, d), X.site_rows(nation_sites(spark, d), "nation"))
    return I.supporting_counts(I.allele_reads(X.at_sites(observed, "nation", (1, 2), 10), ["sample_id"]), ["sample_id"])


_STRETCHES = [("A", 100, 140), ("N", 0, 30), ("R", 1900, 5000), ("N", 700, 701)]


@query(f"""WITH {_READS}, e AS (SELECT *, pos + CASE c WHEN 0 THEN 12 WHEN 1 THEN 13 ELSE 10 END AS end_pos FROM r)
SELECT sample_id, qname, chrom, pos, end_pos FROM e WHERE {" OR ".join(f"(chrom = '{c}' AND pos < {b} AND end_pos > {a})" for c, a, b in _STRETCHES)}""")
def s2_fetch(spark, d):
    return X.overlapping_reads(lineitem_reads(spark, d), _STRETCHES).select("sample_id", "qname", "chrom", "pos", "end_pos")


@query("WITH " + _hits("mapq >= 10") + _COUNTED)
def p2_pileup(spark, d):
    return _counted(spark, d, 10, width=64)


@query("WITH " + _hits("abs(tlen) < 20000") + _COUNTED)
def p3_near_pairs(spark, d):
    return _counted(spark, d, width=64, most_span=20000)


@query("WITH " + _hits("mapq >= 10 AND abs(tlen) >= 13000") + _COUNTED)
def p6_wide_pairs(spark, d):
    return _counted(spark, d, 10, H.BETWEEN_SOURCES, 64)


@query("WITH " + _hits("true") + """ SELECT sample_id, qname, idx, qpos::BIGINT AS qpos, substr(seq, (qpos + 1)::BIGINT, 1) AS base FROM h""")
def p9_read_offset(spark, d):
    sites = nation_sites(spark, d).withColumnRenamed("pos1", "pos").drop("pos2")
    out = I.site_bases(lineitem_reads(spark, d), sites, width=64)
    return out.select("sample_id", "qname", "idx", "qpos", F.col("seq").substr(F.col("qpos").cast("int") + 1, F.lit(1)).alias("base"))


@query("WITH " + _hits("true", "SELECT idx, chrom, unnest([pos1, pos2]) AS pos, a1, a2 FROM s") + """, z AS (SELECT *, least(length(array_to_string(a1, ',')), length(array_to_string(a2, ','))) AS n FROM h),
e AS (SELECT sample_id, qname, idx, any_value(a1) AS a1, any_value(a2) AS a2, CASE WHEN count(DISTINCT substr(seq, (qpos + 1)::BIGINT, n)) = 1 THEN min(substr(seq, (qpos + 1)::BIGINT, n)) END AS base FROM z WHERE qpos + n < length(seq) GROUP BY 1, 2, 3),
c AS (SELECT sample_id, qname, idx, CASE WHEN list_contains(a2, base) THEN '2' WHEN list_contains(a1, base) THEN '1' ELSE 'x' END AS c FROM e), q AS (SELECT DISTINCT sample_id, qname FROM e)
SELECT q.sample_id, q.qname, string_agg(coalesce(c, 'x'), '' ORDER BY s.idx) AS pattern FROM q CROSS JOIN s LEFT JOIN c ON c.sample_id = q.sample_id AND c.qname = q.qname AND c.idx = s.idx GROUP BY 1, 2""")
def p8_read_patterns(spark, d):
    return E.read_patterns(lineitem_reads(spark, d), nation_sites(spark, d), True, 0)


_MOTIFS = {"long": "CGTAC", "short": "GTA", "none": "AC"}


@query(f"""WITH {_READS}, m AS (SELECT sample_id, CASE WHEN contains(seq, 'CGTAC') THEN 1 WHEN contains(seq, 'GTA') THEN 2 WHEN contains(seq, 'AC') THEN 3 END AS m FROM r WHERE (flag & 2304) = 0 AND chrom = 'N' AND pos < 1500 AND pos + CASE c WHEN 0 THEN 12 WHEN 1 THEN 13 ELSE 10 END > 100)
SELECT sample_id, count(*) FILTER (WHERE m = 1) AS long, count(*) FILTER (WHERE m = 2) AS short, count(*) FILTER (WHERE m = 3) AS none FROM m GROUP BY 1""")
def d6_motif_counts(spark, d):
    return H.motif_counts(lineitem_reads(spark, d), "N", (100, 1500), _MOTIFS)


_LONG, _SHORT = H.INSERTION_NAMES["long"], H.INSERTION_NAMES["short"]


@query(f"""WITH k AS (SELECT l_suppkey AS sample_id, CASE l_linenumber % 3 WHEN 0 THEN '{_LONG}' WHEN 1 THEN '{_SHORT}' ELSE 'g.x' END AS name, count(*) AS n1, sum(l_linenumber)::BIGINT AS n2 FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_suppkey AS sample_id, count(*) FILTER (WHERE l_returnflag = 'A') AS lo, count(*) FILTER (WHERE l_returnflag = 'N') AS sh, count(*) FILTER (WHERE l_returnflag = 'R') AS nn FROM lineitem GROUP BY 1)
SELECT sample_id, name, CASE name WHEN '{_LONG}' THEN coalesce(lo, 0) WHEN '{_SHORT}' THEN coalesce(sh, 0) ELSE n1 END AS n1, CASE name WHEN '{_LONG}' THEN coalesce(sh + nn, 0) WHEN '{_SHORT}' THEN coalesce(lo + nn, 0) ELSE n2 END AS n2 FROM k LEFT JOIN m USING (sample_id)""")
def d7_insertion_counts(spark, d):
    rows = table(spark, d, "lineitem").withColumn("sample_id", F.col("l_suppkey"))
    k = F.col("l_linenumber") % 3
    counts = rows.groupBy("sample_id", F.when(k == 0, _LONG).when(k == 1, _SHORT).otherwise("g.x").alias("name")).agg(F.count("*").alias("n1"), F.sum("l_linenumber").alias("n2"))
    of = lambda x: F.count_if(F.col("l_returnflag") == x)
    motifs = rows.groupBy("sample_id").agg(of("A").alias("long"), of("N").alias("short"), of("R").alias("none"))
    return H.insertion_counts(counts, motifs).select("sample_id", "name", "n1", "n2")


@query("""WITH p AS (SELECT p_partkey, upper(string_split(p_name, ' ')[1]) AS seen, p_type AS alt, 'R' AS ref FROM part)
SELECT p_partkey, CASE WHEN starts_with(seen, alt) OR starts_with(alt, seen) THEN true WHEN starts_with(seen, ref) OR starts_with(ref, seen) THEN false END AS state FROM p""")
def p10_allele_state(spark, d):
    return table(spark, d, "part").select("p_partkey", S.allele_state(F.get(F.split("p_name", " "), F.lit(0)), F.col("p_type"), F.lit("r")).alias("state"))


# ---- copies ----

_COPIES = "SELECT l_suppkey AS sample_id, l_linenumber AS idx, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, (l_suppkey % 6)::INT AS cn FROM lineitem GROUP BY l_suppkey, l_linenumber"


def _copies(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_linenumber").alias("idx"))
    counts = rows.agg(F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))
    totals = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") % 6).cast("int").alias("total_cn"))
    return counts, totals


@query(f"WITH k AS ({_COPIES}), {poisson_sql('c', 'k', 'sample_id, idx', 0)} SELECT sample_id, idx, ({conversion_sql(0.6)})::INT AS cn FROM c")
def d3_site_copies(spark, d):
    return G.site_copies(*_copies(spark, d)).select("sample_id", "idx", "cn")


@query(f"WITH k AS ({_COPIES}), {poisson_sql('c', 'k', 'sample_id, idx', 4)} SELECT sample_id, 'v' || idx AS name, least({denovo_sql(0.8, 0.65)}, cn - 2)::INT AS cn FROM c JOIN k USING (sample_id, idx)")
def d4_homology_copies(spark, d):
    counts, totals = _copies(spark, d)
    return G.homology_copies(counts.withColumn("name", F.concat(F.lit("v"), F.col("idx").cast("string"))), totals)


_TAG_ROWS = ", ".join(f"('{t}', {n}, {a}, {b}, {c})" for t, n, a, b, c in C.TAG_COPIES)
_TAG_LIST = "[" + ", ".join(f"'{t[0]}'" for t in C.TAG_COPIES) + "]"
_NAMES = {1: C.CLEAN_VARIANTS[0], 2: C.CLEAN_VARIANTS[1], 3: C.NOISY_VARIANTS[0], 4: C.NOISY_VARIANTS[1]}
_NAME_SQL = "CASE idx " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NAMES.items()) + " ELSE 'g.' || idx END"
_KIND_SQL = "CASE WHEN idx <= 2 THEN 'clean' WHEN idx <= 4 THEN 'noisy' ELSE 'other' END"


def _variant_sql() -> str:
    parts = "\nUNION ALL ".join(f"SELECT sample_id, idx, ({denovo_sql(0.8, 0.65, 'cn')})::INT AS cn FROM v_{kind} JOIN k_{kind} USING (sample_id, idx)" for kind in ("clean", "noisy", "other"))
    calls = ",\n".join(f"k_{kind} AS (SELECT sample_id, idx, cn, CASE WHEN off THEN 0 ELSE n1 END AS n1, n2 FROM e WHERE kind = '{kind}'), {poisson_sql(f'v_{kind}', f'k_{kind}', 'sample_id, idx', least)}" for kind, least in (("clean", 2), ("noisy", 7), ("other", 4)))
    return f"""WITH t(tag, total, a, b, c) AS (VALUES {_TAG_ROWS}),
k AS (SELECT l_suppkey AS sample_id, l_linenumber AS idx, ({_TAG_LIST})[1 + l_suppkey % 28] AS tag, {C.EXON9_POS} - 3000 + l_linenumber * 1000 AS pos, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2,
  count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS r FROM lineitem GROUP BY l_suppkey, l_linenumber),
g AS (SELECT *, {_KIND_SQL.replace('idx', 'k.idx')} AS kind FROM k),
x AS (SELECT sample_id, idx, f AS a, r AS b, (CASE WHEN kind = 'noisy' THEN n1 ELSE f + r END // 2) AS c, (CASE WHEN kind = 'noisy' THEN n1 ELSE f + r END // 2) AS d FROM g),
{fisher_sql('y', 'x', 'sample_id, idx')},
e AS (SELECT g.*, CASE WHEN pos <= {C.EXON9_POS} THEN t.a WHEN pos >= {C.INTRON1_POS} THEN t.c ELSE t.b END AS cn,
  CASE kind WHEN 'noisy' THEN p < 0.05 OR f <= 1 OR r <= 1 WHEN 'clean' THEN f + r >= 3 AND p < 0.01 AND least(f, r) = 0 ELSE f + r >= 3 AND p < 0.02 AND least(f, r) <= 1 END AS off FROM g JOIN y USING (sample_id, idx) JOIN t USING (tag)),
{calls}
SELECT sample_id, idx, {_NAME_SQL} AS name, cn FROM ({parts})"""


@query(_variant_sql())
def d5_variant_copies(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_linenumber").alias("idx"))
    flag, status = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    counts = rows.agg(F.count_if(flag).alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"), F.count_if(flag & status).alias("n1_fwd"), F.count_if(flag & ~status).alias("n1_rev"))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _NAMES.items() for x in p]), F.col("idx")), F.concat(F.lit("g."), F.col("idx").cast("string")))
    counts = counts.withColumn("pos", F.lit(C.EXON9_POS - 3000) + F.col("idx") * 1000).withColumn("name", name)
    tags = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.element_at(F.array(*[F.lit(t[0]) for t in C.TAG_COPIES]), (1 + F.col("s_suppkey") % 28).cast("int")).alias("tag"))
    return G.variant_copies(counts, tags, G.Options(strand_bias_all=True))


_EXON9 = "SELECT l_suppkey AS sample_id, 7 + l_linenumber % 2 AS idx, count(*) FILTER (WHERE l_returnflag = 'A') // (1 + l_suppkey % 3) AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, (2 + l_suppkey % 4)::INT AS cn FROM lineitem GROUP BY l_suppkey, 7 + l_linenumber % 2"


@query(f"""WITH k AS ({_EXON9}), {poisson_sql('c', 'k', 'sample_id, idx', 0)},
e AS (SELECT sample_id, idx, {conversion_sql(0.88)} AS c, cn * n1 / (n1 + n2)::DOUBLE AS raw, n1, n2, cn FROM c JOIN k USING (sample_id, idx)),
m AS (SELECT sample_id, round(avg(n1))::BIGINT AS n1, round(avg(n2))::BIGINT AS n2, any_value(cn) AS cn, min(c) AS lo, max(c) AS hi, min(raw) AS rlo, max(raw) AS rhi FROM e GROUP BY 1), {poisson_sql('b', 'm', 'sample_id', 0)}
SELECT sample_id, CASE WHEN lo = hi AND lo = {conversion_sql(0.70)} AND (lo <> 1 OR (rlo < 1.2 AND rhi < 1.3)) THEN lo END::INT AS exon9_cn FROM m JOIN b USING (sample_id)""")
def d8_exon9_copies(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), (7 + F.col("l_linenumber") % 2).alias("idx"))
    counts = rows.agg(F.floor(F.count_if(F.col("l_returnflag") == "A") / (1 + F.first("l_suppkey") % 3)).alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))
    totals = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), (2 + F.col("s_suppkey") % 4).cast("int").alias("total_cn"))
    return G.exon9_copies(counts, totals)


# ---- variants along reads ----

_PATTERNS = """p AS (SELECT l_suppkey AS sample_id, (CASE WHEN l_tax * 100 < l_suppkey % 9 THEN 'x' WHEN l_returnflag = 'A' THEN '1' WHEN l_returnflag = 'R' THEN '2' ELSE 'x' END) || (CASE WHEN l_discount * 100 < l_suppkey % 11 THEN 'x' WHEN l_linestatus = 'F' THEN '1' ELSE '2' END) || (CASE WHEN l_quantity < 20 THEN '1' WHEN l_quantity < 45 THEN '2' ELSE 'x' END) AS pattern FROM lineitem)"""


def _patterns(spark, d) -> DataFrame:
    # the reads of some suppliers see less than those of others
    k = F.col("l_suppkey")
    one = F.when(F.col("l_tax") * 100 < k % 9, "x").when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "R", "2").otherwise("x")
    two = F.when(F.col("l_discount") * 100 < k % 11, "x").when(F.col("l_linestatus") == "F", "1").otherwise("2")
    three = F.when(F.col("l_quantity") < 20, "1").when(F.col("l_quantity") < 45, "2").otherwise("x")
    return table(spark, d, "lineitem").select(k.alias("sample_id"), F.concat(one, two, three).alias("pattern"))


_SUPPLIER_TAGS = f"g AS (SELECT s_suppkey AS sample_id, ({_TAG_LIST})[1 + s_suppkey % 28] AS tag FROM supplier)"


def _tags(spark, d) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(t[0]) for t in C.TAG_COPIES]), (1 + F.col("s_suppkey") % 28).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), tag.alias("tag"))


@query(f"""WITH {_PATTERNS}, k AS (SELECT s_suppkey AS sample_id, (s_acctbal::BIGINT % 30 + 30) % 30 AS n1, s_suppkey % 40 AS n2, (2 + s_suppkey % 5)::INT AS cn FROM supplier), {poisson_sql('c', 'k', 'sample_id', 0)},
n AS (SELECT sample_id, count(*) FILTER (WHERE substr(pattern, 1, 1) = '1' AND substr(pattern, 3, 1) = '2') AS s, count(*) FILTER (WHERE substr(pattern, 2, 1) = '1' AND substr(pattern, 3, 1) = '2') AS g FROM p GROUP BY 1),
z AS (SELECT sample_id, cn, {conversion_sql(0.8)} AS c, coalesce(s, 0) >= 2 AS s, coalesce(g, 0) >= 2 AS g FROM k JOIN c USING (sample_id) LEFT JOIN n USING (sample_id))
SELECT sample_id, CASE WHEN c < cn - 2 AND s THEN cn - 2 - c ELSE 0 END::INT AS copies, coalesce(c < cn - 2 AND s AND g, false) AS cis_938 FROM z""")
def d10_switch_938(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.pmod(F.rint("s_acctbal").cast("long"), F.lit(30)).alias("n1"), (F.col("s_suppkey") % 40).alias("n2"), (2 + F.col("s_suppkey") % 5).cast("int").alias("total_cn"))
    out = H.call_938(rows.select("sample_id", "n1", "n2"), rows.select("sample_id", "total_cn"), _patterns(spark, d))
    return out.select("sample_id", F.col("copies").cast("int").alias("copies"), "cis_938")


@query(f"""WITH t(tag, total, a, b, c) AS (VALUES {_TAG_ROWS}), {_PATTERNS}, {_SUPPLIER_TAGS}, w AS (SELECT s_suppkey AS sample_id, s_suppkey % 30 AS a1, s_suppkey % 17 AS r1, s_suppkey % 23 AS a2, s_suppkey % 13 AS r2 FROM supplier),
k1 AS (SELECT sample_id, a1 AS n1, r1 AS n2, b AS cn FROM w JOIN g USING (sample_id) JOIN t USING (tag)), k2 AS (SELECT sample_id, a2 AS n1, r2 AS n2, b AS cn FROM w JOIN g USING (sample_id) JOIN t USING (tag)),
{poisson_sql('c1', 'k1', 'sample_id', 0)}, {poisson_sql('c2', 'k2', 'sample_id', 0)},
n AS (SELECT sample_id, count(*) FILTER (WHERE pattern = '211') >= 2 AS f, count(*) FILTER (WHERE pattern = '221') >= 2 AS b FROM p GROUP BY 1),
v1 AS (SELECT sample_id, coalesce({conversion_sql(0.6)}, 0) AS v1 FROM c1), v2 AS (SELECT sample_id, coalesce({conversion_sql(0.6)}, 0) AS v2 FROM c2),
z AS (SELECT sample_id, v1, v2, coalesce(f, false) AS f, coalesce(b, false) AS b FROM v1 JOIN v2 USING (sample_id) LEFT JOIN n USING (sample_id))
SELECT sample_id, CASE WHEN f THEN v1 WHEN b THEN least(v1, v2) ELSE 0 END::INT AS n526, CASE WHEN NOT f AND b THEN least(v1, v2) ELSE 0 END::INT AS n556 FROM z""")
def d11_pair_526_556(spark, d):
    k = F.col("s_suppkey")
    counts = table(spark, d, "supplier").select(k.alias("sample_id"), (k % 30).alias("a1"), (k % 17).alias("r1"), (k % 23).alias("a2"), (k % 13).alias("r2"))
    out = H.call_526_556(counts, _tags(spark, d), _patterns(spark, d))
    return out.select("sample_id", F.col("n526").cast("int").alias("n526"), F.col("n556").cast("int").alias("n556"))


@query(f"""WITH {_PATTERNS}, {_SUPPLIER_TAGS}, n AS (SELECT sample_id, count(*) FILTER (WHERE pattern LIKE '12%') >= 2 AND count(*) FILTER (WHERE pattern LIKE '21%') >= 2 AS seen FROM p GROUP BY 1)
SELECT sample_id, tag = 'cn2' AND coalesce(seen, false) AS trans_803 FROM g LEFT JOIN n USING (sample_id)""")
def d12_trans_803(spark, d):
    return H.trans_803(_tags(spark, d), _patterns(spark, d))


@query("""WITH f AS (SELECT s_suppkey AS sample_id, s_suppkey % 4 AS first, s_suppkey % 9 AS second, s_suppkey % 5 AS aa, s_suppkey % 14 AS a FROM supplier)
SELECT sample_id, CASE WHEN second < 5 OR first > 2 THEN 0 WHEN a >= second + aa THEN 1 ELSE 2 END::INT AS copies FROM f""")
def d13_inserted_a(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("sample_id"), (k % 4).alias("first"), (k % 9).alias("second"), (k % 5).alias("aa"), (k % 14).alias("a"))
    return H.call_inserted_a(rows.select("sample_id", "first", "second"), rows.select("sample_id", "aa", "a"))


# ---- decisions ----

_VARIANTS = ["g.42129809T>C", "g.42129819G>T", "g.42127565T>C", "g.42127556T>C", "g.42126611C>G", "g.42130692G>A", "g.42129754G>A", "g.42128945C>T", "exon9gc", "NA"]


def _repair_sql() -> str:
    n = lambda v, names="names": f"len(list_filter({names}, lambda x: x = '{v}'))"
    rep = lambda v, k: f"list_transform(range(greatest({k}, 0)), lambda i: '{v}')"
    hyb = "(contains(tag, 'exon9hyb') AND tag <> 'exon9hyb_star5')"
    top = lambda v, other=None: f"CASE WHEN {hyb} AND {n(v)} BETWEEN 1 AND h" + (f" AND {n(other)} = 0" if other else "") + " THEN 1 ELSE 0 END"
    v809, v819, v565, v556, v611, v692, v754, v945 = _VARIANTS[:8]
    n819 = f"greatest({n(v819)}, {n(v809)})"
    added = [
        rep(v819, f"{n(v809)} - {n(v819)}"), rep(v556, f"{n(v565)} - {n(v556)}"), rep("exon9gc", f"CASE WHEN {hyb} AND {n('exon9gc')} = 0 THEN h ELSE 0 END"), rep(v692, top(v692)), rep(v754, top(v754, v945)), rep(v945, top(v945, v754)), rep(v809, top(v809, v754)),
        rep(v819, f"CASE WHEN {hyb} AND {n819} BETWEEN 1 AND h AND {n(v754)} = 0 THEN 1 ELSE 0 END"),
    ]
    has611 = f"({n(v611)} - CASE WHEN contains(tag, 'star13') AND NOT contains(tag, 'intron1') AND {n(v611)} > 0 THEN 1 ELSE 0 END + CASE WHEN {hyb} AND {n('exon9gc')} = 0 THEN h ELSE 0 END)"
    less = f"CASE WHEN (contains(tag, 'exon9hyb') OR tag = 'cn2') AND e > own AND own <= 1 AND ({has611} = 0 OR low) THEN e - own ELSE 0 END"
    whole = f"list_concat(list_filter(names, lambda x: x <> '{v611}' AND x <> 'NA'), {', '.join(added)}, {rep(v611, has611)}, {rep('exon9gc', less)}, {rep(v611, f'CASE WHEN {has611} = 0 THEN {less} ELSE 0 END')})"
    pick = lambda k: f"v[1 + (o_orderkey // {10**k}) % 10]"
    return f"""WITH o AS (SELECT o_orderkey, [{', '.join(f"'{x}'" for x in _VARIANTS)}] AS v, ({_TAG_LIST})[1 + o_custkey % 28] AS tag, 1 + o_custkey % 3 AS e, (o_custkey % 4)::INT AS own, o_custkey % 5 = 0 AS low FROM orders),
n AS (SELECT *, [{pick(0)}, {pick(1)}, {pick(2)}, {pick(3)}] AS names, len(list_filter(string_split(tag, '_'), lambda x: x = 'exon9hyb')) AS h FROM o)
SELECT o_orderkey, array_to_string(list_sort({whole}), ' ') AS names FROM n"""


@query(_repair_sql())
def d14_repair_variants(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n: F.get(F.array(*map(F.lit, _VARIANTS)), (F.floor(k / 10**n) % 10).cast("int"))
    tag = F.element_at(F.array(*[F.lit(t[0]) for t in C.TAG_COPIES]), (1 + c % 28).cast("int"))
    low = F.when(c % 5 == 0, 1.0).otherwise(1.5)
    names = C.repair_variants(F.col("names"), F.col("tag"), (1 + c % 3).cast("int"), (c % 4).cast("int"), [low, low])
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.array(*map(pick, range(4))).alias("names"), tag.alias("tag"))
    return rows.select("o_orderkey", F.array_join(names, " ").alias("names"))


@query(f"""WITH {_SUPPLIER_TAGS} SELECT sample_id, tag, CASE tag WHEN 'star5_star5' THEN '*5/*5' WHEN 'star13_star13' THEN '*13/*13' WHEN 'star13intron1_star13intron1' THEN '*13/*13' WHEN 'star5_star5_star68' THEN '*5/*68' END AS genotype FROM g""")
def d16_direct_genotype(spark, d):
    tags = _tags(spark, d)
    return tags.select("sample_id", "tag", F.try_element_at(F.create_map(*[F.lit(x) for p in C.DIRECT_GENOTYPES.items() for x in p]), F.col("tag")).alias("genotype"))


# candidates, and what they are: one; one main form; one left without rare alleles; several; none; rare alleles only
_CLASSES = [
    (["*1_*2"], "unique_match", "*1_*2"), (["*1.001_*2", "*1_*2.002"], "unique_star", "*1_*2"), (["*1_*34", "*2_*41"], "pick_common_allele", "*2_*41"), (["*1_*2", "*3_*4"], "more_than_one_match", "*1_*2;*3_*4"),
    ([], "no_match", ""), (["*1_*139", "*2_*39"], "more_than_one_match", ""), (["*10_*4.009", "*10.002_*4", "*10_*4.001"], "unique_star", "*10_*4"),
]


@query("WITH v(k, info, star) AS (VALUES " + ", ".join(f"({k}, '{i}', '{s}')" for k, (_, i, s) in enumerate(_CLASSES)) + ") SELECT p_partkey, info AS call_info, star AS star_call FROM part JOIN v ON p_partkey % 7 = k")
def d17_classify(spark, d):
    candidates = F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<string>") for c, _, _ in _CLASSES]), (F.col("p_partkey") % 7).cast("int"))
    return M.classify(table(spark, d, "part").withColumn("candidates", candidates)).select("p_partkey", "call_info", F.array_join("star_call", ";").alias("star_call"))


_PAIRS = ["*27/*41;*1/*32", "*1/*41;*119/*2", "*1/*2;*3/*4", "*1/*41"]


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS g, o_custkey % 3 = 0 AS cis, o_custkey % 2 = 0 AS trans, o_orderstatus = 'F' AS open FROM orders)
SELECT o_orderkey, CASE WHEN g = 0 AND open THEN CASE WHEN cis THEN '*1/*32' ELSE '*27/*41' END WHEN g = 1 AND open THEN CASE WHEN trans THEN '*119/*2' ELSE '*1/*41' END ELSE (['*27/*41;*1/*32', '*1/*41;*119/*2', '*1/*2;*3/*4', '*1/*41'])[1 + g] END AS genotype FROM o""")
def d21_tie_rules(spark, d):
    o = table(spark, d, "orders")
    genotype = F.get(F.array(*map(F.lit, _PAIRS)), (F.col("o_orderkey") % 4).cast("int"))
    info = F.when(F.col("o_orderstatus") == "F", "more_than_one_match").otherwise("unique_match")
    return o.select("o_orderkey", C.resolve_cn2(genotype, F.lit("cn2"), info, F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 2 == 0).alias("genotype"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 7)::INT WHEN c_acctbal / 1000 > 7.5 THEN round(c_acctbal / 1000)::INT END AS copies FROM customer""")
def d23_fallback_copies(spark, d):
    cn = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 7).cast("int"))
    return table(spark, d, "customer").select("c_custkey", C.fallback_copies(cn, F.col("c_acctbal") / 1000).alias("copies"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 6 AS t, 1 + o_orderkey % 4 AS k, (o_custkey % 10) / 10.0::DOUBLE AS a, (o_orderkey % 10) / 10.0::DOUBLE AS b, o_custkey % 17 AS v, o_orderkey % 19 AS w FROM orders)
SELECT o_orderkey, CASE WHEN k IN (2, 3) AND v >= 10 AND w >= 10 THEN CASE WHEN a - b > 0.20 THEN CASE t WHEN 2 THEN 'star13' WHEN 3 THEN 'dup_star13' END WHEN a - b < -0.20 THEN CASE t WHEN 2 THEN 'star5_star68' WHEN 3 THEN 'star68' WHEN 4 THEN 'star68_star68' END END END AS tag FROM o""")
def d24_changepoint_tag(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", C.changepoint_tag(c % 6, 1 + k % 4, (c % 10) / 10, (k % 10) / 10, c % 17, k % 19).alias("tag"))


_DIFF = ", ".join(f"('{t}', {n})" for t, n in C.SPACER_DIFF.items())


@query(f"""WITH x(tag, d) AS (VALUES {_DIFF}), o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'Fuzzy_match' ELSE 'LowQ_high_CN' END AS f, ({_TAG_LIST})[1 + o_custkey % 28] AS tag, o_custkey % 7 - CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 END AS diff FROM orders)
SELECT o_orderkey, CASE WHEN f <> 'LowQ_high_CN' AND diff <> d THEN 'Spacer_CN_inconsistent' ELSE f END AS filter FROM o LEFT JOIN x USING (tag)""")
def d26_spacer_filter(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    current = F.when(k % 3 == 0, "PASS").when(k % 3 == 1, "Fuzzy_match").otherwise("LowQ_high_CN")
    tag = F.element_at(F.array(*[F.lit(t[0]) for t in C.TAG_COPIES]), (1 + c % 28).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", C.spacer_filter(current, tag, c % 7, F.when(k % 5 != 0, k % 4)).alias("filter"))


_ITEMS = "SELECT translate(n_name, '_', '-') AS name, ['r' || n_regionkey, 'k' || (n_nationkey % 7)] AS parts FROM nation"


def _stars(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("ord"), F.translate("n_name", "_", "-").alias("name"), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("k"), (n % 7).cast("string"))).alias("parts"))


_HALF_EVEN = "CASE WHEN {0} * 100 - floor({0} * 100) = 0.5 AND floor({0} * 100) % 2 = 0 THEN floor({0} * 100) ELSE round({0} * 100) END::BIGINT"


@query(f"""WITH c AS (SELECT s_suppkey AS id, 'NATION-' || (s_suppkey % 25) || '/NATION-' || (s_suppkey * 7 % 25) AS g, ['cn2', 'cn3'][1 + s_suppkey % 2] AS tag, 4 AS total FROM supplier),
i AS ({_ITEMS}), q AS (SELECT l_suppkey AS id, floor(l_quantity / 4)::INT AS idx, count(*) FILTER (WHERE l_returnflag = 'A' AND (l_quantity < 24 OR l_suppkey % 5 > 0 OR l_partkey % 16 = 0)) AS n1,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_suppkey % 3 = 0) AS n2 FROM lineitem GROUP BY 1, 2),
z AS (SELECT id, idx, CASE WHEN n1 + n2 >= 10 THEN n1 / (n1 + n2)::DOUBLE END AS ratio FROM q),
w AS (SELECT id, CASE WHEN count(*) OVER x = 5 AND count(ratio) OVER x >= 3 THEN avg(ratio) OVER x END AS m FROM z WINDOW x AS (PARTITION BY id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
cv AS (SELECT id, count(*) FILTER (WHERE m > 0.35) >= 3 AND count(*) FILTER (WHERE m < 0.15) >= 3 AS ch FROM w GROUP BY 1),
v AS (SELECT l_suppkey AS id, CASE WHEN l_partkey % 2 = 0 THEN 'r' || (l_partkey % 5) ELSE 'k' || (l_partkey % 7) END AS name, count(*) FILTER (WHERE l_returnflag = 'A' AND l_suppkey % 4 < 2) AS alt, count(*) FILTER (WHERE l_returnflag = 'R' AND l_partkey % 3 = 0) AS ref FROM lineitem GROUP BY 1, 2),
d AS (SELECT c.id, h.hap, unnest(i.parts) AS name FROM c, (SELECT unnest([1, 2]) AS hap) h JOIN i ON i.name = string_split(c.g, '/')[h.hap]),
s AS (SELECT d.id, d.hap, d.name, alt + ref AS depth, alt / nullif(alt + ref, 0)::DOUBLE AS vaf FROM d JOIN v ON v.id = d.id AND v.name = d.name),
mm AS (SELECT id, count(*) FILTER (WHERE depth >= 5 AND vaf < 0.05) / nullif(count(*) FILTER (WHERE depth >= 5), 0)::DOUBLE AS rate FROM s GROUP BY 1),
o AS (SELECT id, name, count(DISTINCT hap) AS sides, any_value(depth) AS depth, any_value(vaf) AS vaf FROM s GROUP BY 1, 2),
ba AS (SELECT id, CASE WHEN count(*) FILTER (WHERE sides = 1 AND depth >= 10 AND vaf > 0.05 AND vaf < 0.95) >= 2 THEN avg(abs(vaf - 0.5)) FILTER (WHERE sides = 1 AND depth >= 10 AND vaf > 0.05 AND vaf < 0.95) END AS dev FROM o GROUP BY 1),
f AS (SELECT c.id, CASE WHEN tag = 'cn2' AND ch THEN 'Conversion_map_chimeric_in_cn2' END AS f1, CASE WHEN rate > 0.5 THEN 'Allele_mismatch_rate_' || {_HALF_EVEN.format('rate')} || 'pct' END AS f2,
  CASE WHEN tag = 'cn2' AND total = 4 AND dev > 0.3 THEN 'Allele_balance_deviation_' || {_HALF_EVEN.format('dev')} || 'pct' END AS f3 FROM c LEFT JOIN cv USING (id) LEFT JOIN mm USING (id) LEFT JOIN ba USING (id))
SELECT id AS s_suppkey, f1 AS conversion_flag, f2 AS mismatch_flag, f3 AS balance_flag, coalesce(f1, f2, f3) AS flag, CASE WHEN id % 3 < 2 THEN coalesce(f1, f2, f3, 'PASS') ELSE 'LowQ_high_CN' END AS filter FROM f""")
def d30_consistency(spark, d):
    k = F.col("s_suppkey")
    star = lambda x: F.concat(F.lit("NATION-"), x.cast("string"))
    calls = table(spark, d, "supplier").select("s_suppkey", F.concat_ws("/", star(k % 25), star(k * 7 % 25)).alias("genotype"), F.when(k % 2 == 0, "cn2").otherwise("cn3").alias("tag"), F.lit(4).alias("total_cn"))
    rows = table(spark, d, "lineitem").withColumn("s_suppkey", F.col("l_suppkey"))
    # one supplier of five changes sources along the quantities
    one = (F.col("l_returnflag") == "A") & ((F.col("l_quantity") < 24) | (F.col("l_suppkey") % 5 > 0) | (F.col("l_partkey") % 16 == 0))
    two = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 3 == 0)
    sites = rows.groupBy("s_suppkey", F.floor(F.col("l_quantity") / 4).cast("int").alias("idx")).agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"))
    part = F.col("l_partkey")
    name = F.when(part % 2 == 0, F.concat(F.lit("r"), (part % 5).cast("string"))).otherwise(F.concat(F.lit("k"), (part % 7).cast("string")))
    counts = rows.groupBy("s_suppkey", name.alias("name")).agg(F.count_if((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 4 < 2)).alias("alt"), F.count_if((F.col("l_returnflag") == "R") & (part % 3 == 0)).alias("ref"))
    out = E.consistency_flags(calls, sites, counts, _stars(spark, d), ["s_suppkey"])
    current = F.when(k % 3 < 2, "PASS").otherwise("LowQ_high_CN")
    return out.select("s_suppkey", "conversion_flag", "mismatch_flag", "balance_flag", "flag", E.flagged_filter(current, F.col("flag")).alias("filter"))


_SCORED = """WITH c AS (SELECT s_suppkey AS id, unnest([0, 1]) AS place,
  unnest(['NATION-' || (s_suppkey % 25) || '/NATION-' || (s_suppkey * 7 % 25), 'NATION-' || ((s_suppkey + 3) % 25) || '/NATION-' || (s_suppkey * 11 % 25)]) AS candidate FROM supplier),
o AS (SELECT l_suppkey AS id, l_orderkey % 200 AS f, CASE WHEN l_partkey % 2 = 0 THEN 'r' || (l_partkey % 3) ELSE 'k' || (l_partkey % 3) END AS name, max((l_linenumber <= 2 + l_suppkey % 3)::INT) AS alt FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT id, string_agg(name || ':' || alt, ',' ORDER BY name || ':' || alt) AS p, list({'name': name, 'alt': alt}) AS seen FROM o GROUP BY id, f HAVING count(*) >= 2),
k AS (SELECT id, any_value(seen) AS seen, count(*) AS n FROM m GROUP BY id, p HAVING contains(p, ':1')),
h AS (SELECT c.*, coalesce(a.parts, []) AS v0, coalesce(b.parts, []) AS v1 FROM c LEFT JOIN i a ON a.name = string_split(candidate, '/')[1] LEFT JOIN i b ON b.name = string_split(candidate, '/')[2]),
t AS (SELECT h.id, place, candidate, n, len(list_filter(seen, lambda x: (x.alt = 1) <> list_contains(v0, x.name))) = 0 OR len(list_filter(seen, lambda x: (x.alt = 1) <> list_contains(v1, x.name))) = 0 AS ok FROM h LEFT JOIN k ON h.id = k.id),
g AS (SELECT id, place, candidate, count(*) FILTER (WHERE ok) AS consistent_modes, count(*) FILTER (WHERE NOT ok) AS inconsistent_modes, coalesce(sum(n) FILTER (WHERE ok), 0)::BIGINT AS consistent_reads,
  coalesce(sum(n) FILTER (WHERE NOT ok), 0)::BIGINT AS inconsistent_reads FROM t GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN consistent_reads + inconsistent_reads = 0 THEN 0.0 WHEN inconsistent_reads = 0 THEN 10.0 WHEN consistent_reads = 0 THEN -10.0 ELSE ln(consistent_reads / inconsistent_reads::DOUBLE) END AS score FROM g),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, place))"""


@query(f"""{_SCORED.replace("WITH c AS", f"WITH i AS ({_ITEMS}), c AS")}
SELECT id AS s_suppkey, place, candidate, consistent_modes, inconsistent_modes, consistent_reads, inconsistent_reads, round(score, 6) + 0.0 AS score, rank = 1 AS best,
  CASE WHEN rank = 1 AND score > next + 0.2 AND consistent_reads >= 3 AND place > 0 THEN 'Phasing_prefers_' || replace(candidate, '/', '_') END AS phasing_flag FROM r""")
def d33_phasing_scores(spark, d):
    k, part = F.col("s_suppkey"), F.col("l_partkey")
    star = lambda x: F.concat(F.lit("NATION-"), x.cast("string"))
    options = F.concat_ws(";", F.concat_ws("/", star(k % 25), star(k * 7 % 25)), F.concat_ws("/", star((k + 3) % 25), star(k * 11 % 25)))
    calls = table(spark, d, "supplier").select(k.cast("string").alias("sample_id"), options.alias("genotype"))
    name = F.concat(F.when(part % 2 == 0, "r").otherwise("k"), (part % 3).cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sample_id"), (F.col("l_orderkey") % 200).alias("frag"), name.alias("name"), (F.col("l_linenumber") <= 2 + F.col("l_suppkey") % 3).alias("alt"))
    out = E.phasing_scores(R.phasing_modes(rows, ["sample_id"], "frag", "name", "alt"), calls, _stars(spark, d), lead=0.2)
    return out.select(F.col("sample_id").cast("long").alias("s_suppkey"), *[r6("score").alias("score") if c == "score" else F.col(c) for c in out.columns if c != "sample_id"])


_MARK = "g.42130692G>A"


@query(f"""WITH i AS (SELECT n_nationkey AS ord, '*' || n_nationkey AS name, CASE n_nationkey % 3 WHEN 0 THEN ['r' || n_regionkey] WHEN 1 THEN ['r' || n_regionkey, 'k' || (n_nationkey % 7)]
  ELSE ['k' || (n_nationkey % 7), '{_MARK}'] END AS parts FROM nation),
all_pairs AS (SELECT 'pair' AS t, list_concat(a.parts, b.parts) AS p, [a.name, b.name] AS n FROM i a JOIN i b ON a.ord <= b.ord
  UNION ALL SELECT 'triple_pair', list_concat(a.parts, list_concat(b.parts, b.parts)), [a.name, b.name, b.name] FROM i a, i b),
d AS (SELECT t, array_to_string(list_sort(p), '_') AS key, list_sort(list(DISTINCT array_to_string(list_sort(n), '_'))) AS c FROM all_pairs GROUP BY 1, 2),
o AS (SELECT l_orderkey AS id, ['cn2', 'cn3', 'star68', 'star68_star68'][1 + l_orderkey % 4] AS tag, l_orderkey % 4 AS q,
  list_sort(list(CASE l_partkey % 3 WHEN 0 THEN 'r' || (l_partkey % 5) WHEN 1 THEN 'k' || (l_partkey % 7) ELSE '{_MARK}' END)) AS names FROM lineitem WHERE l_linenumber <= 2 + l_orderkey % 2 GROUP BY 1),
h AS (SELECT *, len(list_filter(names, lambda x: x = '{_MARK}')) AS have, list_filter(names, lambda x: x <> '{_MARK}') AS rest FROM o),
x AS (SELECT id, q, 'drop' AS kind, k, list_sort(list_concat(rest, list_transform(range(0, have - k), lambda z: '{_MARK}'))) AS trial FROM (SELECT *, unnest(range(0, least(greatest(q - 1, 0), have) + 1)) AS k FROM h)
  UNION ALL SELECT id, q, 'add', 0, list_sort(list_append(names, v)) FROM (SELECT id, q, names, unnest(list_distinct(names)) AS v FROM h WHERE q = 1) WHERE len(list_filter(names, lambda x: x = v)) = 1),
m AS (SELECT x.*, coalesce(d.c, []) AS c FROM x LEFT JOIN d ON d.t = CASE WHEN q = 1 THEN 'triple_pair' ELSE 'pair' END AND d.key = array_to_string(trial, '_')),
g AS (SELECT id, count(*) FILTER (WHERE kind = 'drop') AS n, coalesce(any_value(c) FILTER (WHERE kind = 'drop' AND k = 0), []) AS plain,
  coalesce(flatten(list(c ORDER BY k) FILTER (WHERE kind = 'drop' AND len(c) > 0)), []) AS haps, coalesce(list(c) FILTER (WHERE kind = 'add' AND len(c) = 1), []) AS added FROM m GROUP BY 1),
z AS (SELECT *, CASE WHEN n > 1 THEN haps WHEN len(plain) = 0 AND len(added) = 1 THEN added[1] ELSE plain END AS c FROM g)
SELECT id AS l_orderkey, tag, CASE WHEN len(c) = 0 THEN 'no_match' WHEN n > 1 THEN CASE WHEN len(list_distinct(c)) = 1 THEN 'unique_match' ELSE 'pick_common_allele' END WHEN len(c) = 1 THEN 'unique_match' ELSE 'more_than_one_match' END AS call_info,
  array_to_string(c, ';') AS candidates, array_to_string(CASE WHEN n > 1 AND len(c) > 0 THEN [c[len(c)]] ELSE c END, ';') AS star_call FROM z JOIN o USING (id)""")
def d18_trials(spark, d):
    n, part, order = F.col("n_nationkey"), F.col("l_partkey"), F.col("l_orderkey")
    r, k = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("k"), (n % 7).cast("string"))
    parts = F.when(n % 3 == 0, F.array(r)).when(n % 3 == 1, F.array(r, k)).otherwise(F.array(k, F.lit(_MARK)))
    stars = table(spark, d, "nation").select(n.alias("ord"), F.concat(F.lit("*"), n.cast("string")).alias("name"), parts.alias("parts"))
    name = F.when(part % 3 == 0, F.concat(F.lit("r"), (part % 5).cast("string"))).when(part % 3 == 1, F.concat(F.lit("k"), (part % 7).cast("string"))).otherwise(_MARK)
    names = table(spark, d, "lineitem").where(F.col("l_linenumber") <= 2 + order % 2).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(name)).alias("names"))
    tag = F.get(F.array(*map(F.lit, ("cn2", "cn3", "star68", "star68_star68"))), (order % 4).cast("int"))
    observed = names.select(order.cast("string").alias("sample_id"), tag.alias("tag"), "names")
    out = G.match_stars(observed, G.dictionaries(stars), stars, G.Options())
    return out.select(F.col("sample_id").cast("long").alias("l_orderkey"), "tag", "call_info", F.coalesce(F.array_join("candidates", ";"), F.lit("")).alias("candidates"), F.array_join("star_call", ";").alias("star_call"))


_ZONES = ", ".join(f"coalesce(bool_or(bin BETWEEN {a} AND {b} AND n_left + n_right >= 3), false) AS {n}" for n, (a, b) in E.CLIP_ZONES.items())


@query(f"""WITH c AS (SELECT l_suppkey, (42126000 + l_partkey % 400 * 50) // 10 * 10 AS bin, count(*) FILTER (WHERE l_linestatus = 'F') AS n_left, count(*) FILTER (WHERE l_linestatus = 'O') AS n_right FROM lineitem WHERE l_quantity >= 20 GROUP BY 1, 2 HAVING n_left >= 3 OR n_right >= 3)
SELECT l_suppkey, {_ZONES}, count(*) AS n_clusters, max(n_left + n_right) AS most_reads FROM c GROUP BY 1""")
def d32_clip_zones(spark, d):
    clips = table(spark, d, "lineitem").select("l_suppkey", (42126000 + F.col("l_partkey") % 400 * 50).alias("pos"), F.when(F.col("l_linestatus") == "F", "L").otherwise("R").alias("side"), F.col("l_quantity").alias("len"))
    return E.clip_signals(R.clip_clusters(clips, ["l_suppkey"], "pos", "side", "len"), ["l_suppkey"])


_SPANS = {n: b - a for n, (a, b) in E.SUBREGIONS.items()}
# the first and the third part count up to four and two times for some suppliers
_TIMES = (4, 1, 2, 1)


@query(f"""WITH c AS (SELECT l_suppkey, {', '.join(f"coalesce(sum(l_quantity * (1 + l_suppkey % {_TIMES[k]})) FILTER (WHERE l_linenumber = {k + 1}), 0) / {_SPANS[n]}.0::DOUBLE AS {n}" for k, n in enumerate(_SPANS))} FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, CASE WHEN in4_in8 > 0 THEN exon9 / in4_in8 ELSE 1.0 END AS e, CASE WHEN five_prime > 0 THEN three_prime / five_prime ELSE 1.0 END AS p FROM c)
SELECT l_suppkey, round(e, 6) + 0.0 AS exon9_ratio, round(p, 6) + 0.0 AS prime_ratio, e >= 1.25 AND e < 1.75 AS exon9_elevated, p >= 0.40 AND p < 0.80 AS three_prime_depleted FROM r""")
def d32_subregions(spark, d):
    names = F.array(*map(F.lit, E.SUBREGIONS))
    times = 1 + F.col("l_suppkey") % F.get(F.array(*map(F.lit, _TIMES)), F.col("l_linenumber") - 1)
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", F.get(names, F.col("l_linenumber") - 1).alias("name")).agg(F.sum(F.col("l_quantity") * times).alias("count")).where("name is not null")
    out = E.subregion_signals(counts, ["l_suppkey"])
    return out.select("l_suppkey", r6("exon9_ratio").alias("exon9_ratio"), r6("prime_ratio").alias("prime_ratio"), "exon9_elevated", "three_prime_depleted")


@query("""WITH a AS (SELECT l_orderkey, 'a' || (l_partkey % 9) AS allele FROM lineitem), f AS (SELECT unnest(range(0, 8)) AS k), g AS (SELECT 'a' || k AS allele, CASE WHEN k = 7 THEN NULL ELSE k * 0.25::DOUBLE END AS v FROM f)
SELECT l_orderkey, CASE WHEN count(*) = count(v) THEN sum(v) END AS score FROM a LEFT JOIN g USING (allele) GROUP BY 1""")
def d34_activity_score(spark, d):
    alleles = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("a"), (F.col("l_partkey") % 9).cast("string")).alias("allele"))
    k = F.col("id")
    function = spark.range(8).select(F.concat(F.lit("a"), k.cast("string")).alias("haplotype"), F.when(k == 7, "n/a").otherwise((k * 0.25).cast("string")).alias("activity"))
    return C.activity_score(alleles, ["l_orderkey"], function)


@query("""WITH s AS (SELECT c_custkey, abs(c_acctbal) / 150 AS depth, (c_custkey % 40) / 100.0::DOUBLE AS mad, abs(c_acctbal) / 700 AS total, (c_custkey % 100) / 33.0::DOUBLE AS spacer, c_custkey % 6 AS i, c_custkey % 7 AS f FROM customer),
r AS (SELECT *, 1 - 0.8 * greatest(0.0, least(1.0, (depth - 40.0) / (5.0 - 40.0))) AS d1, 1 - 0.7 * greatest(0.0, least(1.0, (mad - 0.10) / (0.30 - 0.10))) AS d2, 1 - 0.7 * greatest(0.0, least(1.0, (abs(total - round(total)) - 0.15) / (0.40 - 0.15))) AS t1, 1 - 0.7 * greatest(0.0, least(1.0, (abs(spacer - round(spacer)) - 0.15) / (0.40 - 0.15))) AS t2,
  CASE i WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.7 WHEN 4 THEN 0.4 ELSE 0.5 END * CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.5 END AS m FROM s)
SELECT c_custkey, round(d1 * d2, 6) + 0.0 AS depth, round((t1 + t2) / 2, 6) + 0.0 AS cn, round(m::DOUBLE, 6) + 0.0 AS match FROM r""")
def d38_component_scores(spark, d):
    k, a = F.col("c_custkey"), F.abs("c_acctbal")
    infos, filters = [None, "no_match", "unique_match", "more_than_one_match", "fuzzy_match(score=1.7)", "unique_star"], ["PASS", "More_than_one_possible_genotype", "Fuzzy_match", "LowQ_high_CN", "Not_assigned_to_haplotypes", "Other", None]
    at = lambda xs, n: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (k % n).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", r6(C.depth_score(a / 150, (k % 40) / 100)).alias("depth"), r6(C.rounding_score(a / 700, (k % 100) / 33)).alias("cn"), r6(C.match_score(at(infos, 6), at(filters, 7))).alias("match")
    )


# ---- evidence of fragments ----

_LOGLIK = """t AS (SELECT DISTINCT event_type AS h FROM events), l AS (SELECT user_id, event_id, h, CASE WHEN event_type = h THEN ln(0.9) ELSE ln(0.05) END AS v, ln(0.2 + (event_id % 3) * 0.2) AS lo, 2 + user_id % 3 AS cn FROM (SELECT DISTINCT user_id, event_id, event_type FROM events), t)"""


def _loglik(spark, d) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type").distinct()
    kinds = table(spark, d, "events").select(F.col("event_type").alias("h")).distinct()
    ll = events.crossJoin(small(kinds))
    return ll.select("user_id", "event_id", "h", F.when(F.col("event_type") == F.col("h"), F.ln(F.lit(0.9))).otherwise(F.ln(F.lit(0.05))).alias("v"), F.ln(0.2 + (F.col("event_id") % 3) * 0.2).alias("lo"), (2 + F.col("user_id") % 3).alias("cn"))


@query(f"""WITH {_LOGLIK}, p AS (SELECT a.user_id, a.event_id, a.h AS a, b.h AS b, a.v AS la, b.v AS lb, a.lo, a.cn FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_id = b.event_id AND a.h <= b.h),
s AS (SELECT *, unnest(CASE WHEN a = b THEN [cn] ELSE range(1, greatest(cn - 1, 1) + 1) END) AS k FROM p),
m AS (SELECT user_id, a, b, k, sum(ln((exp(lo) + k * exp(la) + (cn - k) * exp(lb)) / (cn + 1))) AS total FROM s GROUP BY 1, 2, 3, 4), x AS (SELECT user_id, a, b, max(total) AS total FROM m GROUP BY 1, 2, 3),
w AS (SELECT *, exp(total - max(total) OVER (PARTITION BY user_id)) AS w FROM x)
SELECT user_id, a, b, round(total, 6) + 0.0 AS total, round(w / sum(w) OVER (PARTITION BY user_id), 6) + 0.0 AS posterior FROM w""")
def m18_paralog_mixture(spark, d):
    # fifteen pairs a user, so the best twenty are all of them
    out = R.posteriors(R.paralog_mixture(_loglik(spark, d), ["user_id"], "event_id", "h", "v", "lo", "cn"), ["user_id"], "total")
    return out.select("user_id", "a", "b", r6("total").alias("total"), r6("posterior").alias("posterior"))


@query("""SELECT l_suppkey, l_orderkey FROM lineitem GROUP BY 1, 2 HAVING max(-l_quantity / 4) >= -1.5 * any_value(1 + l_orderkey % 4)""")
def m19_well_mapped(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (-F.col("l_quantity") / 4).alias("v"), (1 + F.col("l_orderkey") % 4).alias("n"))
    return R.well_mapped(rows, ["l_suppkey"], "l_orderkey", "v", "n")


@query(f"""WITH {_LOGLIK} SELECT a.user_id::VARCHAR AS sample_id, a.h AS a, b.h AS b, round(sum(log10((exp(a.v) + exp(b.v)) / 2)), 6) + 0.0 AS score FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_id = b.event_id AND a.h <= b.h GROUP BY 1, 2, 3""")
def a13_vote_pairs(spark, d):
    # fifteen pairs a user, so the best twenty are all of them
    ll = _loglik(spark, d).select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").cast("string").alias("qname"), F.col("h").alias("allele"), (F.col("v") / F.ln(F.lit(10.0))).alias("ll"))
    return E.vote_pairs(ll).select("sample_id", "a", "b", r6("score").alias("score"))


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS next FROM n WINDOW w AS (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority))
SELECT o_custkey, o_orderpriority FROM r WHERE k = 1 AND n >= 3 AND n >= 3 * next""")
def d33_phase_winner(spark, d):
    return R.phase_winner(table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")), ["o_custkey"], "o_orderpriority", "n")


@query("""WITH i AS (SELECT translate(n_name, '_', '-') AS name, ['r' || n_regionkey, 'k' || (n_nationkey % 7)] AS parts FROM nation),
c AS (SELECT p_partkey, o, s, 'NATION-' || x AS name FROM (SELECT p_partkey, 0 AS o, 0 AS s, p_size % 25 AS x FROM part UNION ALL SELECT p_partkey, 0, 1, p_partkey % 25 FROM part UNION ALL SELECT p_partkey, 1, 0, p_size * 3 % 25 FROM part UNION ALL SELECT p_partkey, 1, 1, p_partkey * 7 % 25 FROM part)),
h AS (SELECT DISTINCT p_partkey, o, s, unnest(parts) AS v FROM c JOIN i USING (name)), p AS (SELECT a.p_partkey, a.o, a.v AS a, b.v AS b, bool_or(a.s = b.s) AS cis FROM h a JOIN h b ON a.p_partkey = b.p_partkey AND a.o = b.o AND a.v < b.v GROUP BY 1, 2, 3, 4)
SELECT x.p_partkey, x.a, x.b, x.cis AS cis_first FROM p x JOIN p y ON x.p_partkey = y.p_partkey AND x.a = y.a AND x.b = y.b AND x.o = 0 AND y.o = 1 AND x.cis <> y.cis""")
def d33_phase_pairs(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    star = lambda x: F.concat(F.lit("NATION-"), (x % 25).cast("string"))
    candidates = F.array(F.concat_ws("_", star(s), star(k)), F.concat_ws("_", star(s * 3), star(k * 7)))
    return E.phase_pairs(table(spark, d, "part").select("p_partkey", candidates.alias("candidates")), _stars(spark, d), ["p_partkey"])


@query("""WITH q(a, b, cis_first) AS (VALUES ('A', 'N', true), ('A', 'R', false), ('N', 'R', true)), s AS (SELECT l_suppkey, l_orderkey, l_returnflag AS name, bool_or(l_linestatus = 'F') AS alt FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT x.l_suppkey, q.a, q.b, cis_first, count(*) FILTER (WHERE x.alt AND y.alt) AS cis, count(*) FILTER (WHERE x.alt <> y.alt) AS trans FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.l_orderkey = y.l_orderkey JOIN q ON q.a = x.name AND q.b = y.name GROUP BY 1, 2, 3, 4)
SELECT l_suppkey::VARCHAR AS sample_id, CASE WHEN (cis > trans) = cis_first THEN 0 ELSE 1 END AS option, sum(abs(cis - trans))::BIGINT AS score FROM c WHERE cis + trans >= 2 AND greatest(cis, trans) >= 0.6 * (cis + trans) AND cis <> trans GROUP BY 1, 2""")
def d33_phase_scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_orderkey").alias("qname"), F.col("l_returnflag").alias("name"), (F.col("l_linestatus") == "F").alias("alt"))
    states = rows.groupBy("sample_id", "qname", "name").agg(F.max("alt").alias("alt"))
    pairs = spark.createDataFrame([("A", "N", True), ("A", "R", False), ("N", "R", True)], "a string, b string, cis_first boolean")
    return E.phase_scores(rows.select("sample_id").distinct().crossJoin(F.broadcast(pairs)), states, 2, 0.6)  # three rows


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 AND l_quantity / 50 >= 0.1 AND l_quantity / 50 <= 0.9 THEN round(l_quantity / 50 * l_linenumber)::INT END AS copies FROM lineitem""")
def d33_allele_copies(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("alt"), (50 - F.col("l_quantity")).alias("ref"))
    return R.allele_copies(rows, "alt", "ref", "l_linenumber").select("l_orderkey", "l_linenumber", "copies")


_PROFILES = ", ".join(f"({k}, '{t}', {n}, [{', '.join(f'{x}.0::DOUBLE' for x in f)}])" for k, (t, n, f) in enumerate(E.CN_PROFILES))
_MOVED = "list_transform(f, lambda x: CASE WHEN x > 0.5 THEN x {0} 0.3 ELSE x END)"


@query(f"""WITH b(p, tag, n, f) AS (VALUES {_PROFILES}), r AS (SELECT tag, f, row_number() OVER (ORDER BY p, k) - 1 AS ord, count(*) OVER () AS many FROM b, (SELECT unnest(range(1, 11)) AS k) WHERE k <= n),
e AS (SELECT ord, tag, f FROM r UNION ALL SELECT many + 2 * ord, tag, {_MOVED.format('+')} FROM r UNION ALL SELECT many + 2 * ord + 1, tag, {_MOVED.format('-')} FROM r),
q AS (SELECT o_orderkey, [(2 + o_custkey % 5)::DOUBLE, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END, 2)::DOUBLE, (o_custkey % 4)::DOUBLE, (o_orderkey % 5)::DOUBLE, ((o_custkey + o_orderkey) % 5)::DOUBLE, (o_custkey % 5)::DOUBLE] AS v FROM orders),
u AS (SELECT DISTINCT v FROM q), s AS (SELECT v, tag, ord, round(sqrt(list_sum(list_transform(list_zip(v, f), lambda x: (x[1]::FLOAT - x[2]::FLOAT)::DOUBLE * (x[1]::FLOAT - x[2]::FLOAT)::DOUBLE))), 6) AS dist FROM u, e),
t AS (SELECT v, tag, row_number() OVER (PARTITION BY v ORDER BY dist, ord) AS k FROM s), g AS (SELECT v, tag, count(*) AS votes FROM t WHERE k <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY votes DESC, tag) AS k FROM g)
SELECT o_orderkey, tag AS label, votes / 5.0::DOUBLE AS confidence FROM q JOIN w USING (v) WHERE k = 1""")
def m22_profile_classifier(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (2 + c % 5).alias("total_cn"), F.when(o % 6 != 0, 1 + o % 3).alias("spacer_cn"), (c % 4).alias("exon9"), (o % 5).alias("exon9_intron4"), ((c + o) % 5).alias("intron4_intron1"), (c % 5).alias("intron1_up"))
    return E.classify_profiles(rows, "o_orderkey")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 10)) AS a, list_sort(list(DISTINCT l_partkey % 5)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS covered FROM s""")
def u4_superset(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("a"), F.collect_set(F.col("l_partkey") % 5).alias("b"))
    return sets.select("l_orderkey", M.contains_all(F.col("a"), F.col("b")).alias("covered"))


@query("""WITH k AS (SELECT l_suppkey, l_partkey % 60 AS idx, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2 FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_suppkey, sum(n1) / nullif(sum(n1) + sum(n2), 0)::DOUBLE AS r, 2 + l_suppkey % 4 AS t, ['cn2', 'star68', 'star13', 'exon9hyb_star68', 'star68_star68'][1 + l_suppkey % 5] AS tag FROM k GROUP BY l_suppkey),
e AS (SELECT *, t * coalesce(r, 0.5) AS est, t - 2 + CASE tag WHEN 'star68' THEN -0.5 WHEN 'star13' THEN 0.5 WHEN 'exon9hyb_star68' THEN -0.5 WHEN 'star68_star68' THEN -1.0 ELSE 0.0 END AS want FROM g)
SELECT l_suppkey, round(coalesce(r, 0.5), 6) + 0.0 AS overall_ratio, CASE round(est) WHEN 0 THEN 'deletion_homozygous' WHEN 1 THEN 'deletion' WHEN 2 THEN 'normal' ELSE 'duplication' END AS category, abs(est - want) < 0.7 AS agrees FROM e""")
def d33_kmer_validation(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 60).alias("idx")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))
    k = F.col("s_suppkey")
    tags = F.get(F.array(*map(F.lit, ["cn2", "star68", "star13", "exon9hyb_star68", "star68_star68"])), (k % 5).cast("int"))
    calls = table(spark, d, "supplier").select(k.alias("l_suppkey"), tags.alias("tag"), (2 + k % 4).alias("total_cn")).join(counts.select("l_suppkey").distinct(), "l_suppkey", "left_semi")
    out = E.kmer_validation(counts, calls, ["l_suppkey"])
    return out.select("l_suppkey", r6("overall_ratio").alias("overall_ratio"), "category", "agrees")
