"""Aggregates, joins and models bound to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.functions import scalar as S
from paraloom.operators import aggregates as A
from paraloom.operators import intervals as I
from paraloom.operators import models as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x):
    """Six decimals, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- aggregates ----


@query("""SELECT l_suppkey, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) + 0.0 AS mean, round(median(l_extendedprice), 6) + 0.0 AS median FROM lineitem GROUP BY 1""")
def a2_center(spark, d):
    out = A.center(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", "n", r6("mean").alias("mean"), r6("median").alias("median"))


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, round(any_value(med), 6) + 0.0 AS median, round(median(abs(l_extendedprice - med)) * 1.4826, 6) + 0.0 AS mad FROM lineitem l JOIN m USING (l_suppkey) GROUP BY 1""")
def a4_mad(spark, d):
    out = A.mad(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", r6("median").alias("median"), r6("mad").alias("mad"))


@query("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey, l_quantity, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS k FROM c)
SELECT l_suppkey, CASE WHEN n >= 3 THEN l_quantity END AS l_quantity, n AS support FROM b WHERE k = 1""")
def a5_mode_support(spark, d):
    return A.modal(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 3)


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_linenumber) AS k FROM c)
SELECT l_suppkey, l_linenumber, w AS support FROM b WHERE k = 1""")
def a6_weighted_mode(spark, d):
    return A.modal(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", 1, "l_quantity")


@query("""SELECT l_suppkey, l_shipmode, sum(l_quantity)::DOUBLE AS reads, round(sum(l_quantity) / max(CASE WHEN l_linenumber <= 4 THEN 100.0 * l_linenumber END), 6) + 0.0 AS depth
FROM (SELECT l_suppkey, l_returnflag AS l_shipmode, l_quantity, l_linenumber FROM lineitem) GROUP BY 1, 2""")
def a1_weighted_depth(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("l_shipmode"), "l_quantity", F.lit(100.0).alias("len"),
        F.when(F.col("l_linenumber") <= 4, F.concat(F.lit("r_hapcn"), F.col("l_linenumber").cast("string"))).otherwise("r").alias("name"),
    )
    out = A.region_depth(rows, ["l_suppkey"], "l_shipmode", F.col("name"), "len", "l_quantity")
    return out.select("l_suppkey", "l_shipmode", "reads", r6("depth").alias("depth"))


@query("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2,
round(count(*) FILTER (WHERE l_returnflag = 'A') / nullif(count(*) FILTER (WHERE l_returnflag IN ('A', 'R')), 0)::DOUBLE, 6) + 0.0 AS ratio FROM lineitem GROUP BY 1""")
def a7_fraction(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))
    return rows.select("l_suppkey", "n1", "n2", r6(S.fraction(F.col("n1"), F.col("n2"))).alias("ratio"))


@query("""SELECT l_orderkey, concat(
 CASE WHEN bool_or(l_linenumber = 1 AND l_linestatus = 'F') THEN '2' WHEN bool_or(l_linenumber = 1 AND l_linestatus = 'O') THEN '1' ELSE 'x' END,
 CASE WHEN bool_or(l_linenumber = 2 AND l_linestatus = 'F') THEN '2' WHEN bool_or(l_linenumber = 2 AND l_linestatus = 'O') THEN '1' ELSE 'x' END,
 CASE WHEN bool_or(l_linenumber = 3 AND l_linestatus = 'F') THEN '2' WHEN bool_or(l_linenumber = 3 AND l_linestatus = 'O') THEN '1' ELSE 'x' END) AS pattern
FROM lineitem GROUP BY 1""")
def a8_hap_pattern(spark, d):
    return I.haplotype_patterns(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2, 3], F.col("l_linestatus") == "O", F.col("l_linestatus") == "F")


@query("""SELECT (floor(o_totalprice / 1000) * 1000)::BIGINT AS bin, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_left, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_right
FROM orders GROUP BY 1 HAVING n_left >= 3 OR n_right >= 3""")
def a9_histogram(spark, d):
    rows = table(spark, d, "orders").withColumn("side", F.when(F.col("o_orderstatus") == "O", "L").when(F.col("o_orderstatus") == "F", "R"))
    return A.two_sided_histogram(rows, [], "o_totalprice", "side", 1000, 3)


@query("""SELECT l_suppkey, round(CASE WHEN count(l_discount) >= 10 THEN avg(abs(l_discount * 20 - round(l_discount * 20))) ELSE 0.5 END, 6) + 0.0 AS spread FROM lineitem GROUP BY 1""")
def a15_integer_spread(spark, d):
    out = A.spread_from_integers(table(spark, d, "lineitem").withColumn("v", F.col("l_discount") * 20), ["l_suppkey"], "v")
    return out.select("l_suppkey", r6("spread").alias("spread"))


@query("""SELECT l_orderkey, array_to_string(list_sort(flatten(list(list_transform(range(1 + l_linenumber % 3), lambda i: l_returnflag)))), '_') AS names FROM lineitem GROUP BY 1""")
def a16_multiset(spark, d):
    out = A.repeated(table(spark, d, "lineitem").withColumn("cn", 1 + F.col("l_linenumber") % 3), ["l_orderkey"], "l_returnflag", "cn")
    return out.select("l_orderkey", F.array_join("names", "_").alias("names"))


@query("""SELECT c_custkey, round(exp((0.10 * ln(greatest(a, 0.01)) + 0.20 * ln(greatest(b, 0.01)) + 0.25 * ln(greatest(c, 0.01))) / 0.55), 6) + 0.0 AS score,
CASE WHEN exp((0.10 * ln(greatest(a, 0.01)) + 0.20 * ln(greatest(b, 0.01)) + 0.25 * ln(greatest(c, 0.01))) / 0.55) >= 0.85 THEN 'HIGH'
 WHEN exp((0.10 * ln(greatest(a, 0.01)) + 0.20 * ln(greatest(b, 0.01)) + 0.25 * ln(greatest(c, 0.01))) / 0.55) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS label
FROM (SELECT c_custkey, abs(c_acctbal) / 10000 AS a, c_nationkey / 25.0::DOUBLE AS b, length(c_mktsegment) / 10.0::DOUBLE AS c FROM customer)""")
def a14_geomean(spark, d):
    rows = table(spark, d, "customer")
    score = S.geometric_mean([F.abs("c_acctbal") / 10000, F.col("c_nationkey") / F.lit(25.0), F.length("c_mktsegment") / F.lit(10.0)], [0.10, 0.20, 0.25])
    return rows.select("c_custkey", r6(score).alias("score"), S.confidence_label(score).alias("label"))


@query("""SELECT o_orderkey, round_even(o_totalprice / 7, 3) + 0.0 AS x FROM orders""")
def m12_round3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (S.round3(F.col("o_totalprice") / 7) + F.lit(0.0)).alias("x"))


# ---- joins ----


@query("""SELECT b.k AS band, count(o_orderkey) AS n FROM (SELECT unnest(range(0, 60)) AS k) b
LEFT JOIN orders ON o_totalprice >= b.k * 9000 AND o_totalprice < b.k * 9000 + 4500 GROUP BY 1""")
def j2_interval_counts(spark, d):
    bands = spark.range(60).select(F.col("id").alias("band"), (F.col("id") * 9000).alias("lo"), (F.col("id") * 9000 + 4500).alias("hi"))
    return I.interval_counts(table(spark, d, "orders"), bands, ["band"], "o_totalprice", "lo", "hi", 2000)


@query("""SELECT event_id, b.k AS day FROM events JOIN (SELECT unnest(range(0, 400)) AS k) b
ON floor(epoch(ts))::BIGINT >= (SELECT min(floor(epoch(ts))::BIGINT) FROM events) + b.k * 86400 AND floor(epoch(ts))::BIGINT < (SELECT min(floor(epoch(ts))::BIGINT) FROM events) + b.k * 86400 + 43200""")
def j1_point_in_interval(spark, d):
    events = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("sec"))
    start = events.agg(F.min("sec")).first()[0] or 0
    days = spark.range(400).select(F.col("id").alias("day"), (F.col("id") * 86400 + start).alias("lo"), (F.col("id") * 86400 + start + 43200).alias("hi"))
    return I.point_in_interval(events, days, "sec", "lo", "hi", 21600).select("event_id", "day")


@query("""WITH s AS (SELECT p_partkey AS idx, p_partkey AS p1, p_partkey + p_size AS p2 FROM part), u AS (SELECT idx, p1 AS pos FROM s UNION ALL SELECT idx, p2 FROM s)
SELECT idx, count(DISTINCT l_orderkey) AS n FROM u JOIN lineitem ON l_partkey = pos GROUP BY 1""")
def j3_two_coordinate_union(spark, d):
    parts = table(spark, d, "part")
    sites = I.two_coordinate(parts.select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("p1"), (F.col("p_partkey") + F.col("p_size")).alias("p2")), "p1", "p2")
    return sites.join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("pos")).groupBy("idx").agg(F.count_distinct("l_orderkey").alias("n"))


@query("""SELECT user_id, event_type, count(DISTINCT event_id) FILTER (WHERE value >= 0) AS n1, count(DISTINCT event_id) FILTER (WHERE event_id % 2 = 0) AS n1_fwd, count(DISTINCT event_id) FILTER (WHERE event_id % 2 = 1) AS n1_rev FROM events GROUP BY 1, 2""")
def j4_strand_counts(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("idx"), F.lit(1).alias("allele"), F.when(F.col("event_id") % 2 == 0, "fwd").otherwise("rev").alias("strand"), F.when(F.col("value") >= 0, F.col("event_id")).alias("qname"), F.col("event_id").alias("e"))
    out = I.supporting_counts(rows.withColumn("qname", F.col("e")), ["user_id"])
    ok = rows.groupBy("user_id", "idx").agg(F.count_distinct("qname").alias("n1"))
    return out.drop("n1", "n2").join(ok, ["user_id", "idx"]).select("user_id", F.col("idx").alias("event_type"), "n1", "n1_fwd", "n1_rev")


@query("""SELECT o_custkey, o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1, 2""")
def j5_fragment_bases(spark, d):
    return I.fragment_bases(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus")


@query("""SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS one, max((o_orderstatus = 'O')::INT) AS two, (max((o_orderstatus = 'F')::INT) = 1 AND max((o_orderstatus = 'O')::INT) = 1)::INT AS crossing FROM orders GROUP BY 1""")
def j6_crossing_flags(spark, d):
    return I.crossing_flags(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


# ---- models ----

_MEANS, _PRIORS, _SD2, _SHIFT = {2: 1.0, 3: 1.47}, {2: 0.68, 3: 0.12, 1: 0.12}, 0.08, 1.05
_STATES = M.gmm_states(_SHIFT, _MEANS, _PRIORS, _SD2)
_STATE_ROWS = ", ".join(f"({k}, {m!r}, {sd!r}, {p!r})" for k, m, sd, p in _STATES)


@query(f"""WITH s(k, m, sd, p) AS (VALUES {_STATE_ROWS}),
v AS (SELECT c_custkey, (c_acctbal + 1000) / 2000 AS value FROM customer),
l AS (SELECT c_custkey, value, k::INT AS k, (value / 2 / {_SHIFT} - m) / sd AS z, ln(p) - ln(sd) - (value / 2 / {_SHIFT} - m) * (value / 2 / {_SHIFT} - m) / (2 * sd * sd) AS l FROM v, s),
b AS (SELECT *, l - max(l) OVER (PARTITION BY c_custkey) AS rel, row_number() OVER (PARTITION BY c_custkey ORDER BY l DESC, k) AS pos FROM l),
t AS (SELECT c_custkey, 1 / sum(exp(rel)) AS post FROM b GROUP BY 1)
SELECT c_custkey, CASE WHEN post >= 0.95 AND abs(z) <= {S.TAIL_Z} THEN k END AS cn, round(post, 6) + 0.0 AS posterior FROM b JOIN t USING (c_custkey) WHERE pos = 1""")
def m1_gmm(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 2000).alias("value"))
    return M.gmm_call(rows, "value", _STATES, _SHIFT).select("c_custkey", F.col("cn").cast("int").alias("cn"), r6("posterior").alias("posterior"))


_SITES = """SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, 4 AS cn FROM lineitem GROUP BY 1, 2"""
_POISSON = f"""WITH c AS ({_SITES}),
p AS (SELECT *, unnest(range(0, 5)) AS i, least(n1, n2) AS k, n1 + n2 AS n FROM c WHERE n1 + n2 > 0),
r AS (SELECT *, CASE WHEN i = 0 THEN n * (0.1::DOUBLE / 3) WHEN i = 4 THEN n * 0.9::DOUBLE ELSE n * i / 4.0::DOUBLE END AS rate FROM p),
l AS (SELECT *, k * ln(rate) - rate AS l FROM r),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY l_suppkey, l_linenumber)) AS w FROM l),
q AS (SELECT l_suppkey, l_linenumber, n1, n2, CASE WHEN n2 < n1 THEN 4 - i ELSE i END AS copies, w / sum(w) OVER (PARTITION BY l_suppkey, l_linenumber) AS post FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY post DESC, copies) AS pos FROM q),
t AS (SELECT l_suppkey, l_linenumber, max(n1) AS n1, max(n2) AS n2, max(CASE WHEN pos = 1 THEN copies END) AS c1, max(CASE WHEN pos = 1 THEN post END) AS p1, max(CASE WHEN pos = 2 THEN copies END) AS c2, max(CASE WHEN pos = 2 THEN post END) AS p2 FROM o GROUP BY 1, 2),
calls AS (SELECT c.l_suppkey, c.l_linenumber, c.n1, c.n2,
  CASE WHEN c1 <> 0 AND c.n1 <= 2 AND c.n2 >= 2 THEN 0 ELSE c1 END::INT AS cn1,
  CASE WHEN c1 IS NULL THEN NULL WHEN c1 <> 0 AND c.n1 <= 2 AND c.n2 >= 2 THEN 1.0 WHEN p1 >= 0.9 THEN 1.0 ELSE round_even(p1, 3) END::DOUBLE AS p1,
  CASE WHEN (c1 <> 0 AND c.n1 <= 2 AND c.n2 >= 2) OR p1 >= 0.9 THEN NULL ELSE c2 END::INT AS cn2
  FROM c LEFT JOIN t USING (l_suppkey, l_linenumber))"""


def _calls(spark, d):
    sites = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))
    return M.poisson_call(sites.withColumn("cn", F.lit(4)), "cn", "n1", "n2", 2)


@query(f"""{_POISSON} SELECT l_suppkey, l_linenumber, n1, n2, cn1, p1, cn2 FROM calls""")
def m2_poisson_cn(spark, d):
    return _calls(spark, d).select("l_suppkey", "l_linenumber", "n1", "n2", F.col("cn_call.cn1").alias("cn1"), F.col("cn_call.p1").alias("p1"), F.col("cn_call.cn2").alias("cn2"))


@query(f"""{_POISSON} SELECT l_suppkey, l_linenumber, CASE WHEN cn2 IS NULL OR p1 > 0.6 THEN cn1 END AS kept FROM calls""")
def m4_conversion_filter(spark, d):
    return _calls(spark, d).select("l_suppkey", "l_linenumber", M.conversion_filter(F.col("cn_call"), 0.6).alias("kept"))


@query(f"""{_POISSON} SELECT l_suppkey, l_linenumber, CASE WHEN cn2 IS NULL OR p1 > 0.8 THEN cn1 WHEN (cn1 > 0 AND cn2 > 0) OR cn1 = 4 OR cn2 = 4 THEN CASE WHEN p1 > 0.65 THEN cn1 ELSE least(cn1, cn2) END END AS kept FROM calls""")
def m5_denovo_filter(spark, d):
    return _calls(spark, d).select("l_suppkey", "l_linenumber", M.denovo_filter(F.col("cn_call"), 0.8, 0.65, F.lit(4)).alias("kept"))


_FISHER = """WITH t AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS b,
  count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'O') AS d FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM k),
f AS (SELECT l_suppkey, l_linenumber, a, b, c, d, least(1.0, sum(p) FILTER (WHERE p <= po + 1e-12)) AS p_value FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY l_suppkey, l_linenumber) AS po FROM p) GROUP BY ALL)"""


def _tables(spark, d, reverse=None):
    flag, status = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    reverse = ~status if reverse is None else reverse
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count_if(flag & status).alias("a"), F.count_if(flag & reverse).alias("b"), F.count_if(~flag & status).alias("c"), F.count_if(~flag & ~status).alias("d"))


@query(f"""{_FISHER} SELECT l_suppkey, l_linenumber, a, b, c, d, round(p_value, 6) + 0.0 AS p_value, round(a * d / nullif(b * c, 0)::DOUBLE, 6) + 0.0 AS odds_ratio FROM f""")
def m6_fisher(spark, d):
    return M.fisher_exact(_tables(spark, d), "a", "b", "c", "d").select("l_suppkey", "l_linenumber", "a", "b", "c", "d", r6("p_value").alias("p_value"), r6("odds_ratio").alias("odds_ratio"))


# reverse reads are those of few parts for some suppliers and of none for others, so that strands are empty, uneven and even
_REVERSE_SQL = "l_linestatus = 'O' AND l_partkey % 7 < l_suppkey % 8"
_BIASED = _FISHER.replace("l_returnflag = 'A' AND l_linestatus = 'O'", f"l_returnflag = 'A' AND {_REVERSE_SQL}")


def _reverse():
    return (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 7 < F.col("l_suppkey") % 8)


@query(f"""{_BIASED} SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN p_value < 0.01 AND least(a, b) = 0 ELSE p_value < 0.02 AND least(a, b) <= 1 END AND a + b >= 3 AS biased FROM f""")
def m8_strand_bias(spark, d):
    return M.strand_bias(_tables(spark, d, _reverse()), "a", "b", "c", "d", F.col("l_linenumber") <= 3).select("l_suppkey", "l_linenumber", "biased")


@query("""WITH t AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O' AND l_partkey % 7 < l_suppkey % 8) AS b, count(*) // 2 AS c FROM lineitem GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a - c), least(a + b, a + c) + 1)) AS x FROM t),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(2 * c + 1) + lgamma(a + c + 1) + lgamma(b + c + 1) - lgamma(a + b + 2 * c + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(c - a + x + 1)) AS p FROM k),
f AS (SELECT l_suppkey, a, b, sum(p) FILTER (WHERE p <= po + 1e-12) AS p_value FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY l_suppkey) AS po FROM p) GROUP BY ALL)
SELECT l_suppkey, a, b, p_value < 0.05 OR a <= 1 OR b <= 1 AS noisy FROM f""")
def m7_strand_noise(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(_reverse()).alias("b"), F.count("*").alias("n"))
    return M.strand_noise(rows, "a", "b", "n").select("l_suppkey", "a", "b", "noisy")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS one, greatest(0.001, least(0.5, pow(10.0, -l_quantity / 10))) AS e FROM lineitem),
s AS (SELECT *, unnest(range(0, 3)) AS copies FROM r),
l AS (SELECT l_orderkey, copies, sum(ln(CASE WHEN one THEN copies / 2.0 * (1 - e) + (1 - copies / 2.0) * e ELSE copies / 2.0 * e + (1 - copies / 2.0) * (1 - e) END)) AS l FROM s GROUP BY 1, 2),
w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY l_orderkey)) AS w FROM l)
SELECT l_orderkey, copies::INT AS copies, round(w / sum(w) OVER (PARTITION BY l_orderkey), 6) + 0.0 AS posterior FROM w""")
def m3_quality_posterior(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("one"), "l_quantity", F.lit(2).alias("cn"))
    return M.quality_aware_posterior(rows, ["l_orderkey"], "one", "l_quantity", "cn").select("l_orderkey", "copies", r6("posterior").alias("posterior"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN log10(1 - e) ELSE log10(e / 3) END, 6) + 0.0 AS ll FROM (SELECT p_partkey, p_size, greatest(1e-10, least(0.5, pow(10.0, -p_size / 10.0::DOUBLE))) AS e FROM part)""")
def m17_base_lik(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.log10_base(F.col("p_size").cast("double"), F.col("p_size") % 2 == 0)).alias("ll"))


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice / m, 6) + 0.0 AS relative FROM lineitem JOIN m USING (l_suppkey)""")
def m10_median_correction(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return A.normalized_depth(rows, ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_suppkey", r6("relative").alias("relative"))


@query("""WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS m1, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS v1,
 count(*) FILTER (WHERE l_returnflag = 'N') AS n2, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS m2, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'N') AS v2 FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN n1 < 2 OR n2 < 2 OR sqrt(v1 / n1 + v2 / n2) < 1e-10 THEN 0.0 ELSE (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END, 6) + 0.0 AS t FROM g""")
def m13_welch(spark, d):
    of = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[f(of(x)).alias(f"{n}{k}") for k, x in ((1, "A"), (2, "N")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    return g.select("l_suppkey", r6(M.welch_t(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")])).alias("t"))
