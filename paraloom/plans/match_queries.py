"""Content joins, ordered profiles and decisions bound to the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paraloom.functions import scalar as S
from paraloom.operators import aggregates as A
from paraloom.operators import align
from paraloom.operators import calls as C
from paraloom.operators import match as M
from paraloom.operators import segment as G
from paraloom.operators.sides import small
from paraloom.plans.base_queries import r6, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _items(spark, d):
    """A dictionary of 25 items: nations with their region and name's initial as parts."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("ord"), F.translate("n_name", "_", "-").alias("name"), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("k"), (F.col("n_nationkey") % 7).cast("string"))).alias("parts"))


_ITEMS = "SELECT n_nationkey AS ord, translate(n_name, '_', '-') AS name, ['r' || n_regionkey, 'k' || (n_nationkey % 7)] AS parts FROM nation"
_PAIRS = f"""WITH i AS ({_ITEMS}),
p AS (SELECT array_to_string(list_sort(list_concat(a.parts, b.parts)), '_') AS key, array_to_string(list_sort([a.name, b.name]), '_') AS cand FROM i a JOIN i b ON a.ord <= b.ord),
dict AS (SELECT key, list_sort(list(DISTINCT cand)) AS cands FROM p GROUP BY 1)"""


@query(f"""{_PAIRS} SELECT key, array_to_string(cands, ';') AS candidates FROM dict""")
def j7_pair_dictionary(spark, d):
    out = M.pair_dictionary(_items(spark, d), [(1, 1, True)])
    return out.select("key", F.array_join("candidates", ";").alias("candidates"))


@query(f"""WITH i AS ({_ITEMS}),
p AS (SELECT array_to_string(list_sort(list_concat(a.parts, b.parts, b.parts)), '_') AS key, array_to_string(list_sort([a.name, b.name, b.name]), '_') AS cand FROM i a, i b
UNION ALL SELECT array_to_string(list_sort(list_concat(a.parts, a.parts, b.parts, b.parts)), '_'), array_to_string(list_sort([a.name, a.name, b.name, b.name]), '_') FROM i a JOIN i b ON a.ord <= b.ord)
SELECT key, array_to_string(list_sort(list(DISTINCT cand)), ';') AS candidates FROM p GROUP BY 1""")
def j7_repeated_dictionary(spark, d):
    out = M.pair_dictionary(_items(spark, d), [(1, 2, False), (2, 2, True)])
    return out.select("key", F.array_join("candidates", ";").alias("candidates"))


def _observed(spark, d):
    """Orders as multisets of four parts."""
    o = table(spark, d, "orders")
    part = lambda k, m: F.concat(F.lit(k), (F.col("o_custkey") % m).cast("string"))
    return o.select("o_orderkey", F.array(part("r", 5), part("k", 7), F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string")), F.concat(F.lit("k"), (F.col("o_orderkey") % 7).cast("string"))).alias("names"))


_OBS = "SELECT o_orderkey, ['r' || (o_custkey % 5), 'k' || (o_custkey % 7), 'r' || (o_orderkey % 5), 'k' || (o_orderkey % 7)] AS names FROM orders"


@query(f"""{_PAIRS}, o AS (SELECT o_orderkey, array_to_string(list_sort(names), '_') AS key FROM ({_OBS}))
SELECT o_orderkey, key, CASE WHEN cands IS NULL THEN 'no_match' WHEN len(cands) = 1 THEN 'unique_match' ELSE 'more_than_one_match' END AS call_info, coalesce(array_to_string(cands, ';'), '') AS star_call FROM o LEFT JOIN dict USING (key)""")
def j8_exact_match(spark, d):
    out = M.exact_match(_observed(spark, d), M.pair_dictionary(_items(spark, d), [(1, 1, True)]), "names")
    return out.select("o_orderkey", "key", "call_info", F.array_join("star_call", ";").alias("star_call"))


@query(f"""WITH i AS ({_ITEMS}), o AS (SELECT l_orderkey, list('r' || (l_partkey % 5) ORDER BY l_linenumber) || list('k' || (l_partkey % 7) ORDER BY l_linenumber) AS names FROM lineitem GROUP BY 1 HAVING count(*) = 3),
t AS (SELECT array_to_string(list_sort(list_concat(a.parts, b.parts, c.parts)), '_') AS key, array_to_string(list_sort([a.name, b.name, c.name]), '_') AS cand FROM i a JOIN i b ON a.ord <= b.ord JOIN i c ON b.ord <= c.ord)
SELECT l_orderkey, t.key, array_to_string(list_sort(list(DISTINCT cand)), ';') AS candidates FROM o JOIN t ON t.key = array_to_string(list_sort(names), '_') GROUP BY 1, 2""")
def j7_triples(spark, d):
    part = lambda k, m: F.collect_list(F.concat(F.lit(k), (F.col("l_partkey") % m).cast("string")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.concat(part("r", 5), part("k", 7)).alias("names")).where("n = 3").select("l_orderkey", "names")
    return M.triple_matches(rows, _items(spark, d), ["l_orderkey"]).select("l_orderkey", "key", F.array_join("candidates", ";").alias("candidates"))


@query(f"""{_PAIRS}, o AS (SELECT o_orderkey, names FROM ({_OBS})), oc AS (SELECT o_orderkey, w, count(*) AS n FROM (SELECT o_orderkey, unnest(names) AS w FROM o) GROUP BY 1, 2),
dc AS (SELECT key, w, count(*) AS n FROM (SELECT key, unnest(string_split(key, '_')) AS w FROM dict) GROUP BY 1, 2),
m AS (SELECT o_orderkey, key, sum(least(oc.n, dc.n)) AS shared FROM oc JOIN dc USING (w) GROUP BY 1, 2),
s AS (SELECT o_orderkey, key, round((shared - 0.5 * (4 - shared) - 0.3 * (4 - shared))::DOUBLE, 6) AS score FROM m WHERE 4 - shared <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, key) AS k FROM s WHERE score >= 1)
SELECT o_orderkey, key, score FROM b WHERE k = 1""")
def j9_fuzzy_match(spark, d):
    return M.fuzzy_match(_observed(spark, d), M.pair_dictionary(_items(spark, d), [(1, 1, True)]), ["o_orderkey"], "names")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH c AS (SELECT n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, """ + ", ".join(f"coalesce(max(CASE WHEN o_orderpriority = '{p}' THEN n END)::VARCHAR, 'n/a') AS \"{p}\"" for p in _PRIORITIES) + " FROM c GROUP BY 1")
def j10_lookup_pivot(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.lookup_pivot(rows.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n")), ["n_name"], "o_orderpriority", "n", _PRIORITIES)


@query("""WITH r AS (SELECT DISTINCT user_id, event_id, event_type, value FROM events), t AS (SELECT DISTINCT event_type AS h FROM events),
l AS (SELECT user_id, event_id, h, CASE WHEN event_type = h THEN ln(0.9) ELSE ln(0.05) END AS ll FROM r, t)
SELECT a.user_id, a.h AS a, b.h AS b, round(sum(greatest(a.ll, b.ll) + ln(exp(a.ll - greatest(a.ll, b.ll)) + exp(b.ll - greatest(a.ll, b.ll))) - ln(2.0)), 6) + 0.0 AS total
FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_id = b.event_id AND a.h <= b.h GROUP BY 1, 2, 3""")
def j11_pair_mixture(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type").distinct()
    kinds = table(spark, d, "events").select(F.col("event_type").alias("h")).distinct()
    ll = events.crossJoin(small(kinds)).withColumn("ll", F.when(F.col("event_type") == F.col("h"), F.ln(F.lit(0.9))).otherwise(F.ln(F.lit(0.05))))
    return M.pair_mixture(ll, ["user_id"], "event_id", "h", "ll").select("user_id", "a", "b", r6("total").alias("total"))


@query("""WITH g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(text) - 10), lambda i: substr(text, i, 12))) AS kmer FROM benchmark WHERE length(text) >= 12),
w AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 10), lambda i: substr(text, i, 12))) AS kmer FROM documents WHERE length(text) >= 12)
SELECT doc_id, item_id, count(*) AS n FROM w JOIN g USING (kmer) GROUP BY 1, 2""")
def j12_kmer_join(spark, d):
    return M.shared_kmers(table(spark, d, "documents"), ["doc_id"], "text", table(spark, d, "benchmark"), "item_id", "text", 12)


@query("""WITH q AS (SELECT item_id, o, substr(text, o + 1, 12) AS gram FROM benchmark, (SELECT unnest([0, 12, 24]) AS o) WHERE length(substr(text, o + 1, 12)) = 12),
g AS (SELECT doc_id, unnest(range(0, length(text) - 11)) AS place, text FROM documents WHERE length(text) >= 12), h AS (SELECT doc_id, place, substr(text, place + 1, 12) AS gram FROM g),
k AS (SELECT gram FROM h GROUP BY 1 HAVING count(*) <= 500)
SELECT item_id, doc_id, min(place - o)::INT AS diagonal FROM q JOIN h USING (gram) JOIN k USING (gram) GROUP BY 1, 2, floor((place - o) / 3.0)""")
def j13_qgram_seed(spark, d):
    # seeds of whole benchmark items in whole documents; what stands in over 500 places is no seed, as the operator's default has it
    return M.qgram_seeds(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text", 12, 2)


_SETS = "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 3)) AS a, list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber >= 3)) AS b FROM lineitem GROUP BY 1"


def _sets(spark, d):
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_suppkey"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_linenumber") <= 3).alias("a"), of(F.col("l_linenumber") >= 3).alias("b"))


@query(f"""SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))))), ','), '') AS diff,
len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) = 0 AS covered FROM ({_SETS})""")
def j14_symmetric_diff(spark, d):
    return _sets(spark, d).select("l_orderkey", F.array_join(M.symmetric_difference(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("diff"), M.contains_all(F.col("a"), F.col("b")).alias("covered"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def j15_semi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT l_partkey % 50 AS k, l_returnflag, count(*) AS l FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_partkey % 50 AS k, l_returnflag, count(*) AS r FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT k, sum(least(coalesce(l, 0), coalesce(r, 0)))::BIGINT AS both, sum(greatest(coalesce(l, 0) - coalesce(r, 0), 0))::BIGINT AS only_left, sum(greatest(coalesce(r, 0) - coalesce(l, 0), 0))::BIGINT AS only_right FROM a FULL JOIN b USING (k, l_returnflag) GROUP BY 1""")
def u5_multiset(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 50)
    return M.multiset_overlap(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), ["k"], "l_returnflag")


@query("""WITH t AS (SELECT vec_id AS tid, label, embedding AS te FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT vec_id, label, tid, round(sqrt(list_sum(list_transform(list_zip(embedding, te), lambda x: (x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE))), 6) AS dist FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) e, t),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, tid) AS k FROM s), v AS (SELECT vec_id, label, count(*) AS n FROM n WHERE k <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM v) SELECT vec_id, label, n / 5.0::DOUBLE AS confidence FROM b WHERE k = 1""")
def j16_knn(spark, d):
    # a search: the rows whose id is divisible by 100 ask, all labelled rows answer
    e = table(spark, d, "embeddings")
    return M.nearest(e.where("vec_id % 100 = 0").select("vec_id", "embedding"), "vec_id", "embedding", e.withColumnRenamed("embedding", "t"), "t", "label", "vec_id")


# ---- ordered profiles ----


@query("""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
SELECT user_id, island::BIGINT AS island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def m16_islands(spark, d):
    return G.islands(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("""SELECT user_id, event_id, round(CASE WHEN count(*) OVER w = 5 AND count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) + 0.0 AS window_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def w1_sliding(spark, d):
    return G.sliding_mean(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", r6("window_mean").alias("window_mean"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 20""")
def w5_topk(spark, d):
    return A.top_k(table(spark, d, "lineitem"), ["l_suppkey"], 20, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH p AS (SELECT user_id, event_id, count(value) OVER u AS n1, avg(value) OVER u AS m1, var_samp(value) OVER u AS v1, count(value) OVER w AS n2, avg(value) OVER w AS m2, var_samp(value) OVER w AS v2 FROM events
 WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT user_id, event_id, n1, round(abs(CASE WHEN sqrt(v1 / n1 + v2 / n2) < 1e-10 THEN 0 ELSE (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END), 6) AS t FROM p WHERE n1 >= 5 AND n2 >= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, n1) AS k FROM s) SELECT user_id, event_id AS split, t FROM b WHERE k = 1""")
def m14_best_split(spark, d):
    return G.best_split(table(spark, d, "events"), ["user_id"], "event_id", "value", 5)


# steps of no, medium and large height in the middle third of a month
_CBS = """WITH RECURSIVE d AS (SELECT event_type AS g, ts::DATE AS day, avg(value) + CASE WHEN day(ts::DATE) BETWEEN 11 AND 20 THEN 30 * (length(event_type) % 3) ELSE 0 END AS v FROM events GROUP BY 1, 2), m AS (SELECT g, avg(v) AS mean, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT d.g, row_number() OVER (PARTITION BY d.g ORDER BY day) - 1 AS i, day, v, v - mean AS c FROM d JOIN m USING (g)),
u AS (SELECT g, 0 AS i, 0 AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q FROM m UNION ALL SELECT g, i + 1, count(c) OVER w, coalesce(sum(c) OVER w, 0), coalesce(sum(c * c) OVER w, 0) FROM p WINDOW w AS (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT a.g, a.i AS a, b.i AS b, k.i AS k, k.n - a.n AS n1, b.n - k.n AS n2, k.s - a.s AS s1, b.s - k.s AS s2, k.q - a.q AS q1, b.q - k.q AS q2 FROM u a JOIN u b ON a.g = b.g AND b.i > a.i JOIN u k ON k.g = a.g AND k.i > a.i AND k.i < b.i),
e AS (SELECT g, a, b, k, abs(s1 / n1 - s2 / n2) / sqrt(greatest(q1 - s1 * s1 / n1, 0) / (n1 - 1) / n1 + greatest(q2 - s2 * s2 / n2, 0) / (n2 - 1) / n2) AS t FROM c WHERE n1 >= 5 AND n2 >= 5),
best AS (SELECT g, a, b, arg_max(k, t) AS k, max(t) AS t FROM e GROUP BY 1, 2, 3),
h AS (SELECT m.g, n, CASE WHEN coalesce(t, 0) < 4 AND mean NOT BETWEEN 0.40 AND 0.60 THEN 3.0 ELSE 4.0 END AS least FROM m LEFT JOIN best ON best.g = m.g AND a = 0 AND b = n),
w(g, a, b) AS (SELECT g, 0::BIGINT, n::BIGINT FROM h UNION ALL SELECT w.g, unnest([w.a, best.k::BIGINT]), unnest([best.k::BIGINT, w.b]) FROM w JOIN best ON best.g = w.g AND best.a = w.a AND best.b = w.b JOIN h ON h.g = w.g WHERE t >= least),
f AS (SELECT w.* FROM w JOIN h ON h.g = w.g LEFT JOIN best ON best.g = w.g AND best.a = w.a AND best.b = w.b WHERE coalesce(t, 0) < least)
SELECT f.g AS event_type, (dense_rank() OVER (PARTITION BY f.g ORDER BY f.a) - 1)::INT AS segment, min(day) AS first, max(day) AS last, count(v)::INT AS n_valid, round(avg(v), 6) + 0.0 AS mean FROM f JOIN p ON p.g = f.g AND p.i >= f.a AND p.i < f.b GROUP BY f.g, f.a"""


@query(_CBS)
def m14_cbs(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    step = F.when(F.dayofmonth("day").between(11, 20), 30 * (F.length("event_type") % 3)).otherwise(0)
    daily = daily.withColumn("v", F.col("v") + step)
    out = G.changepoints(daily, ["event_type"], "day", "v")
    return out.select("event_type", "segment", "first", "last", "n_valid", r6("mean").alias("mean"))


_EMIT = "CASE WHEN NOT o.valid THEN 0.0 WHEN s = 0 THEN -0.5 * ln(2 * pi() * 0.15 * 0.15) - o.obs * o.obs / (2 * 0.15 * 0.15) ELSE -0.5 * ln(2 * pi() * 0.09 * s) - (o.obs - s) * (o.obs - s) / (2 * 0.09 * s) END"
# from the fourth line on the level is one, two or three times as high, or a tenth
_VITERBI = f"""WITH RECURSIVE b AS (SELECT l_suppkey AS g, l_linenumber AS idx, avg(l_quantity) / 12 * CASE WHEN l_linenumber < 4 THEN 1.0 WHEN l_suppkey % 4 = 3 THEN 0.1 ELSE (1 + l_suppkey % 4)::DOUBLE END AS obs, count(*) >= 10 AS valid FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY idx) AS k FROM b),
w(g, k, score, paths) AS (SELECT o.g, o.k, list_transform(range(0, 6), lambda s: ({_EMIT} - ln(6))::DOUBLE), list_transform(range(0, 6), lambda s: [s]) FROM o WHERE o.k = 1
  UNION ALL SELECT o.g, o.k, list_transform(range(0, 6), lambda s: (list_max(r[s + 1]) + {_EMIT})::DOUBLE), list_transform(range(0, 6), lambda s: list_append(o.paths[list_position(r[s + 1], list_max(r[s + 1]))], s))
  FROM (SELECT o.*, w.paths, list_transform(range(0, 6), lambda s: list_transform(range(0, 6), lambda q: w.score[q + 1] + CASE WHEN s = q THEN ln(0.995) ELSE ln(0.005 / 5) END)) AS r FROM w JOIN o ON o.g = w.g AND o.k = w.k + 1) o),
z AS (SELECT g, arg_max(paths[list_position(score, list_max(score))], k) AS path FROM w GROUP BY 1)
SELECT o.g AS l_suppkey, o.idx, z.path[o.k]::INT AS state FROM o JOIN z USING (g)"""


@query(_VITERBI)
def m15_viterbi(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("idx")).agg((F.avg("l_quantity") / 12).alias("obs"), (F.count("*") >= 10).alias("valid"))
    level = F.when(F.col("idx") < 4, 1.0).when(F.col("l_suppkey") % 4 == 3, 0.1).otherwise((1 + F.col("l_suppkey") % 4).cast("double"))
    rows = rows.withColumn("obs", F.col("obs") * level)
    return G.viterbi(rows.withColumn("states", F.lit(6)), ["l_suppkey"], "idx", "obs", "valid", "states")


def lowess_sql(name: str, points: str, rounds: int = 3) -> str:
    """CTEs that end in `name` (g, i, fit): local lines through points (g, i, x, y), i counting from 0 in order of x, two thirds of them near each."""
    out = f"""{name}_p AS (SELECT *, greatest(2, floor(2.0::DOUBLE / 3 * count(*) OVER (PARTITION BY g) + 1e-10))::BIGINT AS k, greatest(1.0, (max(x) OVER (PARTITION BY g) - min(x) OVER (PARTITION BY g)) ** 2) AS wide FROM {points}),
{name}_b AS (SELECT a.g, a.x AS ax, b.x AS bx FROM {name}_p a JOIN {name}_p b ON a.g = b.g AND b.i = a.i + a.k),
{name}_s AS (SELECT p.g, p.i, count(b.g) AS first FROM {name}_p p LEFT JOIN {name}_b b ON b.g = p.g AND b.bx - p.x < p.x - b.ax GROUP BY 1, 2),
{name}_n AS (SELECT p.g, p.i, p.x, p.y, p.wide, q.i AS j, q.x AS qx, q.y AS qy, abs(q.x - p.x) AS d, max(abs(q.x - p.x)) OVER (PARTITION BY p.g, p.i) AS reach FROM {name}_p p JOIN {name}_s s ON s.g = p.g AND s.i = p.i JOIN {name}_p q ON q.g = p.g AND q.i >= s.first AND q.i < s.first + p.k),
{name}_w AS (SELECT *, CASE WHEN reach <= 0 OR d <= 0.001 * reach THEN 1.0 WHEN d < 0.999 * reach THEN (1 - (d / reach) ** 3) ** 3 ELSE 0.0 END::DOUBLE AS w FROM {name}_n), {name}_r0 AS (SELECT g, i, 1.0::DOUBLE AS r FROM {name}_p)"""
    for t in range(rounds + 1):
        out += f""",
{name}_a{t} AS (SELECT w.*, w.w * r.r AS u FROM {name}_w w JOIN {name}_r{t} r ON r.g = w.g AND r.i = w.j), {name}_m{t} AS (SELECT g, i, sum(u) AS total, sum(u * qx) / nullif(sum(u), 0) AS mean FROM {name}_a{t} GROUP BY 1, 2),
{name}_v{t} AS (SELECT a.g, a.i, any_value(total) AS total, any_value(mean) AS mean, sum(u * (qx - mean) ** 2) / nullif(any_value(total), 0) AS var FROM {name}_a{t} a JOIN {name}_m{t} m ON m.g = a.g AND m.i = a.i GROUP BY 1, 2),
{name}_f{t} AS (SELECT a.g, a.i, any_value(a.y) AS y, CASE WHEN any_value(total) > 0 THEN sum(u / nullif(total, 0) * (1 + CASE WHEN var > 1e-12 * wide THEN (x - mean) / var ELSE 0 END * (qx - mean)) * qy) ELSE any_value(a.y) END AS fit FROM {name}_a{t} a JOIN {name}_v{t} v ON v.g = a.g AND v.i = a.i GROUP BY 1, 2)"""
        if t < rounds:
            out += f""",
{name}_c{t} AS (SELECT g, 6 * median(abs(y - fit)) AS scale FROM {name}_f{t} GROUP BY 1),
{name}_r{t + 1} AS (SELECT f.g, f.i, CASE WHEN scale < 1e-12 THEN r.r WHEN abs(y - fit) < scale THEN (1 - ((y - fit) / scale) ** 2) ** 2 ELSE 0.0 END AS r FROM {name}_f{t} f JOIN {name}_c{t} c ON c.g = f.g JOIN {name}_r{t} r ON r.g = f.g AND r.i = f.i)"""
    return out + f",\n{name} AS (SELECT g, i, CASE WHEN count(*) OVER (PARTITION BY g) < 3 THEN y ELSE fit END AS fit FROM {name}_f{rounds})"


def corrected_sql(rows: str) -> str:
    """CTEs that end in co (g, o, corrected) of rows (g, o, gc, v)."""
    return f"""md AS (SELECT g, median(v) AS middle FROM {rows} GROUP BY 1), pt AS (SELECT r.g, r.o, row_number() OVER (PARTITION BY r.g ORDER BY gc, o) - 1 AS i, gc AS x, v / nullif(middle, 0) AS y, v, middle FROM {rows} r JOIN md ON md.g = r.g),
{lowess_sql("lo", "(SELECT g, i, x, y FROM pt WHERE middle <> 0)")}, ym AS (SELECT g, median(y) AS ym FROM pt GROUP BY 1),
co AS (SELECT pt.g, pt.o, CASE WHEN middle = 0 THEN v ELSE y + 0.9 * least(y, 2) * (ym - fit) END AS corrected FROM pt JOIN ym USING (g) LEFT JOIN lo ON lo.g = pt.g AND lo.i = pt.i)"""


@query(f"""WITH b AS (SELECT l_suppkey AS g, l_quantity AS o, l_quantity AS gc, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), {corrected_sql("b")}
SELECT g AS l_suppkey, o AS l_quantity, round(corrected, 6) + 0.0 AS corrected FROM co""")
def m9_lowess(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.sum("l_extendedprice").alias("v"))
    return G.gc_corrected(rows.withColumn("o", F.col("l_quantity")), ["l_suppkey"], "l_quantity", "v", "o").select("l_suppkey", F.col("o").alias("l_quantity"), r6("corrected").alias("corrected"))


@query(f"""WITH nr AS (SELECT l_suppkey AS g, l_quantity::INT AS o, l_quantity / 50 AS gc, sum(l_linenumber) / 100.0::DOUBLE AS v FROM lineitem GROUP BY l_suppkey, l_quantity), {corrected_sql("nr")},
cm AS (SELECT g, median(corrected) AS cm FROM co GROUP BY 1), sp AS (SELECT co.g, any_value(cm) AS cm, median(abs(corrected - cm)) * 1.4826 AS spread FROM co JOIN cm USING (g) GROUP BY 1), rb AS (SELECT g, median(v) AS base FROM nr GROUP BY 1),
k AS (SELECT l_suppkey AS g, CASE WHEN l_returnflag = 'N' THEN 'spacer' ELSE 'd67' END AS region_type, sum(l_linenumber) AS reads, max(CASE l_returnflag WHEN 'A' THEN 200 WHEN 'N' THEN 100 END) AS span FROM lineitem GROUP BY 1, 2)
SELECT k.g::VARCHAR AS sample_id, region_type, round(2 * (reads / span::DOUBLE) / base, 6) + 0.0 AS depth, round_even(spread / cm, 3) + 0.0 AS mad, round(base * (100 + k.g % 50), 6) + 0.0 AS median_depth FROM k JOIN sp ON sp.g = k.g JOIN rb ON rb.g = k.g""")
def m11_normalised_depth(spark, d):
    from paraloom.plans import genotype

    rows = table(spark, d, "lineitem").withColumn("sample_id", F.col("l_suppkey").cast("string"))
    shape = [F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("end")]
    norm = rows.groupBy("sample_id", F.col("l_quantity").cast("int").alias("ord")).agg(F.sum("l_linenumber").alias("count"))
    norm = norm.select("sample_id", "ord", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("name"), F.lit("norm").alias("region_type"), *shape, (F.col("ord") / 50).alias("gc"), "count")
    own = rows.groupBy("sample_id", "l_returnflag").agg(F.sum("l_linenumber").alias("count"))
    flag = F.col("l_returnflag")
    own = own.select("sample_id", F.lit(99).alias("ord"), F.when(flag == "A", "x_hapcn2").when(flag == "N", "z_hapcn1").otherwise("y").alias("name"), F.when(flag == "N", "spacer").otherwise("d67").alias("region_type"), *shape, F.lit(0.5).alias("gc"), "count")
    length = rows.select("sample_id", (100 + F.col("l_suppkey") % 50).alias("read_length")).distinct()
    out = genotype.normalised_depth(norm.unionByName(own), length)
    return out.select("sample_id", "region_type", r6("depth").alias("depth"), (F.col("mad") + F.lit(0.0)).alias("mad"), r6("median_depth").alias("median_depth"))


@query("""WITH RECURSIVE q AS (SELECT DISTINCT lower(p_type) AS p, p_name AS t FROM part),
w(p, t, j, col) AS (SELECT p, t, 0::BIGINT, range(0, length(p) + 1) FROM q UNION ALL
  SELECT p, t, j + 1, list_transform(range(0, length(p) + 1), lambda i: list_min(list_transform(range(0, i + 1), lambda k: base[k + 1] + i - k))) FROM (
    SELECT p, t, j, list_transform(range(0, length(p) + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE least(col[greatest(k, 1)] + CASE WHEN substr(p, k, 1) = substr(t, j + 1, 1) THEN 0 ELSE 1 END, col[k + 1] + 1) END) AS base FROM w WHERE j < length(t))),
b AS (SELECT p, t, col[length(p) + 1] AS dist, j, row_number() OVER (PARTITION BY p, t ORDER BY col[length(p) + 1], j) AS k FROM w WHERE j > 0 AND col[length(p) + 1] <= 4)
SELECT p_partkey, dist::INT AS distance, j::INT AS "end" FROM part LEFT JOIN b ON b.p = lower(p_type) AND b.t = p_name AND b.k = 1""")
def m20_semiglobal(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    out = rows.withColumn("h", align.semi_global(F.lower("p_type"), F.col("p_name"), 4))
    return out.select("p_partkey", F.col("h.distance").alias("distance"), F.col("h.end").alias("end"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS a FROM part) SELECT p_partkey, a AS other, levenshtein(p_brand, a)::INT AS distance FROM part, p WHERE levenshtein(p_brand, a) <= 1""")
def m20_global_distance(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    brands = parts.select(F.col("p_brand").alias("other")).distinct()
    near = parts.join(small(brands), F.levenshtein("p_brand", "other", 1) >= 0)
    return near.select("p_partkey", "other", F.levenshtein("p_brand", "other").alias("distance"))


@query()
def m21_local_mapping(spark, d):
    dna = lambda c: F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789#-", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGT")
    parts = table(spark, d, "part").select("p_partkey", dna(F.col("p_name")).alias("q"))
    refs = table(spark, d, "nation").crossJoin(small(table(spark, d, "region"))).select((F.col("n_nationkey") * 5 + F.col("r_regionkey")).alias("ref"), dna(F.concat("n_name", F.lit(" "), "r_name", F.lit(" "), "n_name")).alias("r"))
    return align.map_locally(parts, "p_partkey", "q", refs, "ref", "r", 5, 2)


# ---- decisions ----


@query("""WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), e AS (SELECT user_id, event_id % 50 AS frag, event_type, bool_or(value > m) AS alt FROM events JOIN m USING (user_id) GROUP BY ALL),
f AS (SELECT user_id, frag, array_to_string(list_sort(list(event_type || ':' || alt::INT)), ',') AS pattern FROM e GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, pattern, count(*) AS n FROM f GROUP BY 1, 2""")
def a10_phasing_modes(spark, d):
    from paraloom.operators import reads

    events = table(spark, d, "events")
    middle = A.center(events, ["user_id"], "value").select("user_id", "median")
    rows = events.join(middle, "user_id").select("user_id", (F.col("event_id") % 50).alias("frag"), F.col("event_type").alias("site"), (F.col("value") > F.col("median")).alias("alt"))
    return reads.phasing_modes(rows, ["user_id"], "frag", "site", "alt")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS r FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, a > r AS is_alt FROM v WHERE a <> r""")
def a11_majority(spark, d):
    from paraloom.operators import reads

    return reads.majority(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O").select("o_custkey", "o_orderpriority", "is_alt")


@query("""WITH f AS (SELECT user_id, event_id % 200 AS frag, bool_or(value > 50) FILTER (WHERE event_type = 'click') AS a, bool_or(value > 50) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (WHERE a AND b) AS cis, count(*) FILTER (WHERE a <> b) AS trans FROM f GROUP BY 1""")
def a12_cis_trans(spark, d):
    from paraloom.operators import reads

    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 200).alias("frag"), F.col("event_type").alias("site"), (F.col("value") > 50).alias("alt"))
    return reads.cis_trans(rows, ["user_id"], "frag", "site", "alt", "click", "view")


_TAG_ROWS = ", ".join(f"('{t}', {n}, {a}, {b}, {c})" for t, n, a, b, c in C.TAG_COPIES)
_TAG_LIST = "[" + ", ".join(f"'{t[0]}'" for t in C.TAG_COPIES) + "]"


@query(f"""WITH t(tag, total, a, b, c) AS (VALUES {_TAG_ROWS}), s AS (SELECT o_orderkey, {C.EXON9_POS} - 3000 + o_custkey * 37 AS pos, ({_TAG_LIST})[1 + o_orderkey % 28] AS tag FROM orders)
SELECT o_orderkey, s.tag, (CASE WHEN pos <= {C.EXON9_POS} THEN a WHEN pos >= {C.INTRON1_POS} THEN c ELSE b END)::INT AS expected FROM s JOIN t USING (tag)""")
def d2_expected_copies(spark, d):
    tags = F.array(*[F.lit(t[0]) for t in C.TAG_COPIES])
    sites = table(spark, d, "orders").select("o_orderkey", (F.lit(C.EXON9_POS - 3000) + F.col("o_custkey") * 37).alias("pos"), F.element_at(tags, (1 + F.col("o_orderkey") % 28).cast("int")).alias("tag"))
    return C.expected_copies(sites, "pos", "tag").select("o_orderkey", "tag", "expected")


@query("""WITH v AS (SELECT o_orderkey, 2 AS rep, (o_orderkey % 4)::INT AS e9, ((o_orderkey // 4) % 4)::INT AS mid, ((o_orderkey // 16) % 4)::INT AS far, ((o_orderkey // 64) % 4)::INT AS up FROM orders),
n AS (SELECT *, greatest(far - up, 0) + greatest(mid - far, 0) AS s13i, greatest(up - far, 0) AS s68, greatest(e9 - mid, 0) AS s13, greatest(mid - e9, 0) AS e9h, greatest(rep - e9, 0) AS s5, greatest(e9 - rep, 0) AS dup FROM v),
k AS (SELECT *, s13i + s68 + s13 + e9h + s5 + dup AS tot, CASE WHEN e9h = 1 AND s5 = 1 AND s13i + s68 + s13 + e9h + s5 + dup = 2 THEN 0 ELSE least(e9h, s5) END AS o5, CASE WHEN dup = 1 AND s13 = 1 AND s13i + s68 + s13 + e9h + s5 + dup = 2 THEN 0 ELSE least(dup, s13) END AS o13 FROM n),
w AS (SELECT *, list_concat(list_transform(range(dup - o13), lambda i: 'dup'), list_transform(range(e9h - o5), lambda i: 'exon9hyb'), list_transform(range(s13 - o13), lambda i: 'star13'), list_transform(range(s13i), lambda i: 'star13intron1'), list_transform(range(s5 - o5), lambda i: 'star5'), list_transform(range(s68), lambda i: 'star68')) AS names FROM k)
SELECT o_orderkey, CASE WHEN tot > 0 AND 2 + dup + e9h + s68 - s13 - s13i - s5 = up THEN
  CASE WHEN len(names) > 0 AND len(list_filter(names, lambda x: x <> 'dup')) = 0 THEN 'cn' || (len(names) + 2) WHEN dup = 2 AND e9h = 1 AND s13i = 1 AND tot = 4 THEN 'cn4' ELSE coalesce(array_to_string(names, '_'), '') END
  WHEN mid = 2 AND far = 2 AND up = 2 THEN 'cn2' END AS tag FROM w""")
def d9_event_balance(spark, d):
    o = F.col("o_orderkey")
    digit = lambda k: (F.floor(o / k) % 4).cast("int")
    rows = table(spark, d, "orders").select("o_orderkey", digit(1).alias("exon9"), digit(4).alias("exon9_intron4"), digit(16).alias("intron4_intron1"), digit(64).alias("intron1_up"))
    return C.structural_tag(rows.withColumn("total_cn", F.col("intron1_up") + 2)).select("o_orderkey", "tag")


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN '*1/*2' WHEN o_orderstatus = 'O' THEN '*1/*2;*3/*4' ELSE '*1_*2_*3' END AS g, o_totalprice > 300000 AS high, o_orderpriority = '5-LOW' AS fuzzy FROM orders)
SELECT o_orderkey, CASE WHEN g IS NULL THEN NULL WHEN contains(g, ';') THEN 'More_than_one_possible_genotype' WHEN NOT contains(g, '/') THEN 'Not_assigned_to_haplotypes' WHEN high THEN 'LowQ_high_CN' WHEN fuzzy THEN 'Fuzzy_match' ELSE 'PASS' END AS filter FROM g""")
def d22_filter_chain(spark, d):
    o = table(spark, d, "orders")
    g = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderstatus") == "F", "*1/*2").when(F.col("o_orderstatus") == "O", "*1/*2;*3/*4").otherwise("*1_*2_*3")
    return o.select("o_orderkey", C.call_filter(g, F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "5-LOW").alias("filter"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN NULL ELSE (p_size % 13) * 0.25::DOUBLE END AS s FROM part)
SELECT p_partkey, CASE WHEN s IS NULL THEN 'Indeterminate' WHEN s = 0 THEN 'Poor Metabolizer' WHEN s BETWEEN 0.25 AND 1 THEN 'Intermediate Metabolizer' WHEN s BETWEEN 1.25 AND 2.25 THEN 'Normal Metabolizer' WHEN s > 2.25 THEN 'Ultrarapid Metabolizer' ELSE 'Unknown' END AS band FROM p""")
def d35_band(spark, d):
    s = F.when(F.col("p_size") % 10 == 9, None).otherwise((F.col("p_size") % 13) * 0.25)
    return table(spark, d, "part").select("p_partkey", S.phenotype_band(s).alias("band"))


@query("""SELECT p_partkey, CASE WHEN p_size % 41 > p_partkey % 23 THEN '*' || (p_partkey % 23) || '/*' || (p_size % 41) ELSE '*' || (p_size % 41) || '/*' || (p_partkey % 23) END AS genotype FROM part""")
def d36_pair_sort(spark, d):
    star = lambda x: F.concat(F.lit("*"), x.cast("string"))
    return table(spark, d, "part").select("p_partkey", S.sort_pair(F.concat_ws("/", star(F.col("p_size") % 41), star(F.col("p_partkey") % 23))).alias("genotype"))


@query("""WITH v AS (SELECT l_orderkey, l_discount * 100 AS alt, l_quantity - l_discount * 100 AS ref FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE alt + ref >= 5) AS n_sites,
  round(count(*) FILTER (WHERE alt + ref >= 5 AND alt < 0.05 * (alt + ref)) / nullif(count(*) FILTER (WHERE alt + ref >= 5), 0)::DOUBLE, 6) + 0.0 AS share FROM v GROUP BY 1""")
def d28_mismatch(spark, d):
    alt = F.col("l_discount") * 100
    rows = table(spark, d, "lineitem").select("l_orderkey", alt.alias("alt"), (F.col("l_quantity") - alt).alias("ref"))
    out = C.mismatch_share(rows, ["l_orderkey"], "alt", "ref")
    return out.select("l_orderkey", "n_sites", r6("share").alias("share"))


@query("""SELECT l_orderkey, round(CASE WHEN count(l_tax / nullif(l_tax + l_discount, 0)) >= 2 THEN avg(abs(l_tax / nullif(l_tax + l_discount, 0) - 0.5)) END, 6) + 0.0 AS deviation FROM lineitem GROUP BY 1""")
def d29_balance(spark, d):
    return C.balance_deviation(table(spark, d, "lineitem"), ["l_orderkey"], "l_tax", "l_discount").select("l_orderkey", r6("deviation").alias("deviation"))


@query("""SELECT o_custkey, count(*) AS n_alternatives, count(DISTINCT o_orderstatus) > 1 AS reflex FROM orders GROUP BY 1""")
def d37_ambiguity(spark, d):
    return C.ambiguity(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("""WITH r AS (SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN l_discount * 10 ELSE l_discount END AS ratio FROM lineitem)
SELECT l_suppkey, count(ratio) AS n_sites, count(*) FILTER (WHERE ratio > 0.1 AND ratio < 0.9) AS n_het,
  count(ratio) >= 20 AND count(*) FILTER (WHERE ratio > 0.1 AND ratio < 0.9) <= 2 AS hemizygous FROM r GROUP BY 1""")
def d31_hemizygous(spark, d):
    ratio = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount") * 10).otherwise(F.col("l_discount"))
    return C.hemizygous(table(spark, d, "lineitem").withColumn("ratio", ratio), ["l_suppkey"], "ratio")


@query("""WITH m AS (SELECT user_id, event_id, CASE WHEN count(*) OVER w = 5 AND count(value) OVER w >= 3 THEN avg(value / 100) OVER w END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT user_id, count(*) FILTER (WHERE m > 0.35) AS n_high, count(*) FILTER (WHERE m < 0.15) AS n_low, count(*) FILTER (WHERE m > 0.35) >= 3 AND count(*) FILTER (WHERE m < 0.15) >= 3 AS chimeric FROM m GROUP BY 1""")
def d27_conversion_map(spark, d):
    return C.conversion_map(table(spark, d, "events").withColumn("ratio", F.col("value") / 100), ["user_id"], "event_id", "ratio")


_FORMS = ["*1_*2", "*4_*4", "*1_*1_*1", "*10_*36_*1", "*2_*41"]
_SPELLED = """CASE
  WHEN tag = 'star5_star68' THEN '*68/' || f WHEN tag = 'star13_star68' THEN '*13_' || f || '_*68' WHEN tag IN ('star5', 'star13') THEN f || '/*' || substr(tag, 5)
  WHEN tag = 'cn2' THEN replace(f, '_', '/') WHEN tag = 'star13intron1' THEN CASE k WHEN 0 THEN '*13/*1' WHEN 4 THEN '*13/*41' END
  WHEN tag = 'dup_star13intron1' THEN CASE k WHEN 1 THEN '*13+*4/*4' WHEN 2 THEN '*13+*1/*1' END WHEN tag = 'dup_star13' THEN CASE WHEN sp = 1 THEN f || '_*13' ELSE replace(f, '_', '/') END
  WHEN tag IN ('cn3', 'cn4', 'cn5', 'cn6') THEN CASE k WHEN 0 THEN '*1/*2' WHEN 3 THEN f WHEN 4 THEN '*2/*41' ELSE
    CASE tag WHEN 'cn3' THEN star || '/' || star || 'x2' WHEN 'cn4' THEN star || 'x2/' || star || 'x2' WHEN 'cn5' THEN star || 'x2/' || star || 'x3' ELSE star || 'x3/' || star || 'x3' END END
  WHEN tag = 'exon9hyb_star5' THEN CASE WHEN k = 1 AND sp > 2 THEN '*5/*4.013+*4' ELSE replace(f, '_', '/') END
  WHEN tag IN ('exon9hyb', 'exon9hyb_exon9hyb', 'exon9hyb_exon9hyb_exon9hyb', 'exon9hyb_exon9hyb_exon9hyb_exon9hyb') AND k = 3 THEN '*1/*36+*10'
  WHEN tag IN ('star68', 'star68_star68', 'star68_star68_star68', 'star68_star68_star68_star68') AND k = 1 THEN CASE len(string_split(tag, '_')) WHEN 1 THEN '*4/*68+*4' WHEN 2 THEN '*68+*4/*68+*4' WHEN 3 THEN '*68+*4/*68+*68+*4' ELSE '*68+*68+*4/*68+*68+*4' END
  WHEN contains(tag, 'star68') THEN f || repeat('_*68', len(list_filter(string_split(tag, '_'), lambda x: x = 'star68'))::INT) ELSE f END"""


@query(f"""WITH p AS (SELECT p_partkey, p_size % 5 AS k, ({_FORMS})[1 + p_size % 5] AS f, CASE p_size % 5 WHEN 1 THEN '*4' ELSE '*1' END AS star, ({_TAG_LIST})[1 + p_partkey % 28] AS tag, CASE WHEN round(p_retailprice)::BIGINT % 7 = 0 THEN NULL ELSE round(p_retailprice)::BIGINT % 6 END AS sp FROM part)
SELECT p_partkey, {_SPELLED} AS genotype FROM p""")
def d20_spelled_call(spark, d):
    price = F.round("p_retailprice").cast("long")
    forms = F.array(F.element_at(F.array(*map(F.lit, _FORMS)), (1 + F.col("p_size") % 5).cast("int")))
    tags = F.element_at(F.array(*[F.lit(t[0]) for t in C.TAG_COPIES]), (1 + F.col("p_partkey") % 28).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", forms.alias("forms"), tags.alias("tag"), F.when(price % 7 != 0, price % 6).alias("spacer"))
    return C.spelled_calls(rows, "forms", "tag", "spacer", "genotype").select("p_partkey", "genotype")


@query("""WITH x AS (SELECT o_orderkey, o_custkey % 5 AS k FROM orders) SELECT o_orderkey, CASE WHEN k = 0 THEN NULL ELSE '*' || k || CASE WHEN k > 2 THEN '' ELSE '.00' || k END END AS star, CASE WHEN k = 0 THEN NULL ELSE '*' || k END AS main FROM x""")
def p14_main_allele(spark, d):
    k = F.col("o_custkey") % 5
    star = F.when(k != 0, F.concat(F.lit("*"), k.cast("string"), F.when(k > 2, "").otherwise(F.concat(F.lit(".00"), k.cast("string")))))
    return table(spark, d, "orders").select("o_orderkey", star.alias("star"), S.main_allele(star).alias("main"))


@query("""SELECT p_partkey, upper(reverse(translate(p_brand, 'ACGTacgt', 'TGCATGCA'))) AS rc FROM part""")
def p12_reverse_complement(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(S.reverse_complement(F.col("p_brand"))).alias("rc"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT)::BIGINT AS alt, (l_suppkey)::BIGINT AS ref FROM lineitem""")
def p15_count_strings(spark, d):
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.concat(q, F.lit("("), q, F.lit(":0),"), F.col("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.alt_count(text).alias("alt"), S.ref_count(text).alias("ref"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey + 42120000 WHEN p_size % 3 = 1 THEN p_partkey END AS pos, CASE WHEN p_size % 3 = 0 THEN 'C' WHEN p_size % 3 = 1 THEN 'AG' END AS ref, CASE WHEN p_size % 3 = 0 THEN 'T' WHEN p_size % 3 = 1 THEN '-' END AS alt FROM part""")
def p11_parse_variant(spark, d):
    k, key = F.col("p_size") % 3, F.col("p_partkey")
    name = F.when(k == 0, F.concat(F.lit("g."), (key + 42120000).cast("string"), F.lit("C>T"))).when(k == 1, F.concat(F.lit("g."), key.cast("string"), F.lit("delAG"))).otherwise("g.12insA")
    v = S.parse_variant(name)
    return table(spark, d, "part").select("p_partkey", v["pos"].alias("pos"), v["ref"].alias("ref"), v["alt"].alias("alt"))


@query("""SELECT l_suppkey, l_partkey % 10 AS k, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 10 ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def u6_first_wins(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 10).withColumn("o", F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))
    return A.first_wins(rows, ["l_suppkey", "k"], "l_orderkey", "o")
