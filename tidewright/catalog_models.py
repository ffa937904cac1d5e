"""Queries on selection, events, graphs and records, and SQL for the iterative ones: recursions that do what the operators do."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from . import estimators
from .catalog import DAY, EV, GAP, LI, ORACLES, _numbers, gappy, query, rounded
from .frames import KEY, TIME, daily_orders, events_frame, lineitem_rows, table
from .functions import expressions as ex
from .functions import statistics as st
from .operators import dependence, events, features, graphs, prep, selection
from .plans import discovery
from .sources import plugins, records
from .streaming import events as log
from .streaming import laws, online


@query(f"WITH {LI}, z AS (SELECT l_orderkey, l_linenumber, (d - 0.5) / 0.3 AS z FROM li), e AS (SELECT *, abs(z / sqrt(2)) AS a, 1 / (1 + 0.3275911 * abs(z / sqrt(2))) AS u FROM z) SELECT l_orderkey, l_linenumber, round(exp(-z * z / 2) / (0.3 * sqrt(2 * pi())), 6) AS pdf, round(0.5 * (1 + sign(z) * (1 - (((((1.061405429 * u - 1.453152027) * u) + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-a * a))), 6) AS cdf FROM e")
def normal_distribution(spark, sf_dir):
    return rounded(lineitem_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", st.normal_pdf(F.col("d"), 0.5, 0.3).alias("pdf"), st.normal_cdf(F.col("d"), 0.5, 0.3).alias("cdf")))


PART = ["p_partkey", "p_brand", "p_size", "p_retailprice"]


@query("SELECT p_partkey, round(0.7 * p_retailprice + 0.3 * p_size, 6) AS weighted FROM part")
def weighted_rank(spark, sf_dir):
    return rounded(selection.weighted_rank(table(spark, sf_dir, "part").select(*PART), "p_retailprice", "p_size", "p_partkey", 0.7, 0.3).select("p_partkey", "weighted"))


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part) WHERE r = 1")
def most_parsimonious(spark, sf_dir):
    return selection.most_parsimonious(table(spark, sf_dir, "part").select(*PART), "p_size", "p_partkey", ["p_brand"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))")
def loss_complexity_front(spark, sf_dir):
    return selection.loss_complexity_front(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_size")


@query("WITH p AS (SELECT p_partkey, p_size, p_retailprice, p_partkey % 17 AS s FROM part) SELECT p_partkey FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND b.s >= a.s AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice OR b.s > a.s))")
def stable_front(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 17).alias("s"))
    return selection.stable_front(p, "p_retailprice", "p_size", "s").select("p_partkey")


@query("SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part")
def price_of_complexity(spark, sf_dir):
    return rounded(selection.price_of_complexity(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


@query(f"WITH {EV}, l AS (SELECT series_id, t, x - 50 AS b, lag(x - 50) OVER w AS a, lag(t) OVER w AS s FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, round(t, 6) AS t, round(s + (t - s) * a / (a - b), 5) AS crossed_at FROM l WHERE a < 0 AND b >= 0")
def crossings(spark, sf_dir):
    c = events.crossings(events_frame(spark, sf_dir), "x", 50.0, "rising")
    return c.select(KEY, F.round(TIME, 6).alias(TIME), F.round("crossed_at", 5).alias("crossed_at"))


@query("WITH u AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, event_type FROM events), e AS (SELECT user_id, min(s) AS a, max(s) AS b FROM u GROUP BY 1 HAVING min(s) < max(s)), c AS (SELECT user_id, a AS s FROM e UNION SELECT user_id, b FROM e UNION SELECT user_id, s FROM u JOIN e USING (user_id) WHERE event_type = 'purchase'), l AS (SELECT user_id, s AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS e FROM c) SELECT user_id, start, e AS \"end\" FROM l WHERE e IS NOT NULL")
def split_at_events(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))
    spans = u.groupBy("user_id").agg(F.min("time").alias("start"), F.max("time").alias("end")).where("start < end")
    return events.split_at_events(spans, u.where("event_type = 'purchase'").select("user_id", "time"), ["user_id"])


@query(f"WITH {DAY} SELECT t, CASE WHEN t < 100 THEN 100.0 WHEN t < 250.5 THEN 250.5 WHEN t < 900 THEN 900.0 END AS next_change FROM day")
def next_change(spark, sf_dir):
    return events.next_change(daily_orders(spark, sf_dir).select(TIME), [900, 100, 250.5, 5000], 2000)


@query(f"WITH {DAY} SELECT t, round(CASE CAST(y AS INT) % 2 WHEN 0 THEN 1 + x / 3 ELSE 3 - x / 7 END, 5) AS law FROM day")
def laws_by_regime(spark, sf_dir):
    d = daily_orders(spark, sf_dir).withColumn("regime", F.col("y").cast("int") % 2)
    return rounded(events.laws_by_regime(d, {0: (1.0, 1 / 3), 1: (3.0, -1 / 7)}, "regime", "x").select(TIME, "law"), 5)


@query(f"WITH {DAY} SELECT t, round(CASE WHEN t <= 10 THEN 1.0 WHEN t < 300 THEN 1 + 4 * (t - 10) / 290 WHEN t < 2000 THEN 5 - 3 * (t - 300) / 1700 ELSE 2.0 END, 6) AS u FROM day")
def sampled_control(spark, sf_dir):
    return rounded(events.sampled_control(daily_orders(spark, sf_dir).select(TIME), [10, 300, 2000], [1, 5, 2], "u"))


EDGES = "edges AS (SELECT DISTINCT least(l_suppkey % 12, l_partkey % 12) AS src, greatest(l_suppkey % 12, l_partkey % 12) AS dst FROM lineitem WHERE l_suppkey % 12 != l_partkey % 12 AND (l_suppkey + l_partkey) % 3 = 0)"


def _edges(spark, sf_dir):
    a, b = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    return table(spark, sf_dir, "lineitem").where((a != b) & ((F.col("l_suppkey") + F.col("l_partkey")) % 3 == 0)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


@query(f"WITH {EDGES}, p AS (SELECT p.src AS a, p.dst AS m, q.src AS b FROM edges p JOIN edges q ON p.dst = q.dst AND p.src < q.src) SELECT a AS \"left\", m AS middle, b AS \"right\" FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a))")
def graph_colliders(spark, sf_dir):
    return graphs.colliders(_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges")
def graph_skeleton(spark, sf_dir):
    return graphs.skeleton(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, r(id, layer) AS (SELECT DISTINCT n, 0 FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) UNION SELECT e.dst, r.layer + 1 FROM r JOIN edges e ON e.src = r.id) SELECT id, CAST(max(layer) AS INT) AS layer FROM r GROUP BY 1")
def graph_layers(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graphs.layers(e.select(F.col("src").alias("id")).union(e.select("dst")), e)


@query("WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT k AS partition, k * 7000 AS start, least((k + 1) * 7000, n) AS stop FROM (SELECT n, unnest(range((n + 6999) // 7000)) AS k FROM n)")
def row_partitions(spark, sf_dir):
    return records.plan_row_partitions(spark, table(spark, sf_dir, "lineitem").count(), 7000)


@query("SELECT k AS partition, epoch_us(TIMESTAMP '2024-01-01') + k * 25200000000 AS start, least(epoch_us(TIMESTAMP '2024-01-01') + (k + 1) * 25200000000, epoch_us(TIMESTAMP '2024-01-09')) AS stop FROM (SELECT unnest(range(28)) AS k)")
def time_partitions(spark, sf_dir):
    return records.plan_time_partitions(spark, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC), timedelta(hours=7))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    return records.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)


@query("SELECT c_custkey, round(c_acctbal, 2) AS v FROM customer")
def locale_numbers(spark, sf_dir):
    written = F.translate(F.format_number("c_acctbal", 2), ",.", "x,")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(records.number(F.replace(written, F.lit("x"), F.lit(".")), ",", "."), 2).alias("v"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def zoned_times(spark, sf_dir):
    written = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", records.utc_timestamp(written).alias("us"))


@query(f"WITH {GAP} SELECT 'x' AS field, count(*) FILTER (x IS NULL) AS n FROM gap UNION ALL SELECT 't', count(*) FILTER (t IS NULL) FROM gap")
def missing_by_field(spark, sf_dir):
    rules = [records.FieldRule("x", "double"), records.FieldRule("t", "double")]
    return records.validate_records(gappy(spark, sf_dir), rules, KEY)[1]


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def compare_runs(spark, sf_dir):
    n = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return records.compare_keys(n("F"), n("O"), "k", "n")


@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS amount FROM events GROUP BY 1, 2")
def usage_totals(spark, sf_dir):
    return rounded(records.usage(table(spark, sf_dir, "events"), "user_id", "event_type", "value"), 4)


@query("SELECT round(avg(CAST(l_linestatus = CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS INT)), 6) AS accuracy FROM lineitem")
def label_accuracy(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("guess", F.when(F.col("l_returnflag") == "N", "O").otherwise("F"))
    return rounded(records.agreement(l, "l_linestatus", "guess"))


@query("SELECT round(avg(CAST(l_discount BETWEEN 0.02 AND l_tax AS INT)), 6) AS coverage FROM lineitem")
def interval_coverage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("low", F.lit(0.02))
    return rounded(records.interval_coverage(l, "l_discount", "low", "l_tax"))


@query("SELECT l_linenumber AS time, " + ", ".join(f"round({f}(l_quantity) FILTER (l_returnflag = '{s}'), 6) AS \"{s}_{n}\"" for s in "AN" for n, f in (("lower", "min"), ("median", "avg"), ("upper", "max"))) + " FROM lineitem GROUP BY 1")
def forecast_band_table(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("t"), F.col("l_returnflag").alias("state")).agg(F.min("l_quantity").alias("lower"), F.avg("l_quantity").alias("median"), F.max("l_quantity").alias("upper"))
    return rounded(records.band_table(b, ["A", "N"]))


@query(f"WITH {EV} SELECT series_id, round(t, 6) AS t, round(x * 2.5 - 4, 6) AS x FROM ev WHERE t BETWEEN 1000 AND 900000")
def trim_unscale(spark, sf_dir):
    return rounded(prep.unstandardize(prep.trim(events_frame(spark, sf_dir), 1000, 900_000), "x", -4.0, 2.5))


@query(f"WITH {EV} SELECT series_id, round(t, 6) AS t, round(x, 6) AS x FROM ev")
def drop_constant(spark, sf_dir):
    return rounded(prep.drop_constant(events_frame(spark, sf_dir).withColumn("c", F.lit(3.0))))


@query("WITH RECURSIVE s(scenario, step, x) AS (SELECT n_name, 0, CAST(0.1 + n_nationkey / 50.0 AS DOUBLE) FROM nation UNION ALL SELECT scenario, step + 1, 3.2 * x * (1 - x) FROM s WHERE step < 40) SELECT scenario, CAST(step AS BIGINT) AS step, round(x, 6) AS x FROM s")
def discrete_map(spark, sf_dir):
    world = discovery.World(["x"], {"x": ex.parse("3.2*x*(1 - x)")}, {}, {})
    return rounded(discovery.iterate(world, table(spark, sf_dir, "nation").select(F.col("n_name").alias("scenario"), (0.1 + F.col("n_nationkey") / 50).alias("x")), 40))


def _planted(spark, sf_dir):
    """Daily orders x, and z that follows the x of the day before."""
    from .frames import neighbours

    d = neighbours(daily_orders(spark, sf_dir), ["x"]).where("prev_x IS NOT NULL")
    return d.select(KEY, TIME, "x", (0.7 * F.col("prev_x") + F.col("y") / 40).alias("z"))


def _granger_sql(cause: str, effect: str) -> str:
    return f"""(WITH l AS (SELECT {effect} AS v, lag({effect}) OVER (ORDER BY t) AS a, lag({cause}) OVER (ORDER BY t) AS b FROM pl), r AS (SELECT v, a, b FROM l WHERE a IS NOT NULL),
m AS (SELECT count(*) AS n, var_pop(v) * count(*) AS vv, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, v) * count(*) AS av, covar_pop(b, v) * count(*) AS bv FROM r),
f AS (SELECT n, vv - av * av / aa AS r, vv - (av * (av * bb - bv * ab) + bv * (aa * bv - ab * av)) / (aa * bb - ab * ab) AS u FROM m) SELECT (r - u) / (u / (n - 3)) FROM f)"""


@query(f"WITH {DAY}, pl AS (SELECT t, x, 0.7 * lag(x) OVER (ORDER BY t) + y / 40 AS z FROM day QUALIFY lag(x) OVER (ORDER BY t) IS NOT NULL), f AS (SELECT abs((SELECT corr(x, z) FROM pl)) AS c, {_granger_sql('x', 'z')} AS xz, {_granger_sql('z', 'x')} AS zx) SELECT 'x' AS cause, 'z' AS effect, round(xz, 3) AS f FROM f WHERE c > 0.01 AND xz >= 4 UNION ALL SELECT 'z', 'x', round(zx, 3) FROM f WHERE c > 0.01 AND zx >= 4 AND xz < 4")
def planted_edges(spark, sf_dir):
    e = dependence.dependency_graph(_planted(spark, sf_dir), ["x", "z"], gate=0.01)
    return _numbers(spark, [(a, b, float(f)) for a, b, f in e], "cause string, effect string, f double").withColumn("f", F.round("f", 3))


ORACLES["dmd_operator"] = f"""WITH {DAY}, l AS (SELECT x, y, lead(x) OVER (ORDER BY t) AS u, lead(y) OVER (ORDER BY t) AS v FROM day),
s AS (SELECT sum(x*x) AS a, sum(x*y) AS b, sum(y*y) AS c, sum(x*u) AS xu, sum(y*u) AS yu, sum(x*v) AS xv, sum(y*v) AS yv FROM l WHERE u IS NOT NULL)
SELECT 0 AS i, 0 AS j, round((xu*c - yu*b) / (a*c - b*b), 6) AS v FROM s UNION ALL SELECT 0, 1, round((a*yu - b*xu) / (a*c - b*b), 6) FROM s
UNION ALL SELECT 1, 0, round((xv*c - yv*b) / (a*c - b*b), 6) FROM s UNION ALL SELECT 1, 1, round((a*yv - b*xv) / (a*c - b*b), 6) FROM s"""

_X, _Y = (lambda x, y: f"(1.1*({x}) - 0.4*({x})*({y}))"), (lambda x, y: f"(0.1*({x})*({y}) - 0.4*({y}))")
ORACLES["rk4_scenarios"] = f"""WITH RECURSIVE s(scenario, k, x, y) AS (SELECT n_name, 0, CAST(10 + n_nationkey / 10.0 AS DOUBLE), 5.0::DOUBLE FROM nation UNION ALL
SELECT scenario, k + 1, x + 0.02/6*(ax + 2*bx + 2*cx + {_X('x + 0.02*cx', 'y + 0.02*cy')}), y + 0.02/6*(ay + 2*by_ + 2*cy + {_Y('x + 0.02*cx', 'y + 0.02*cy')}) FROM (
SELECT *, {_X('x + 0.01*bx', 'y + 0.01*by_')} AS cx, {_Y('x + 0.01*bx', 'y + 0.01*by_')} AS cy FROM (
SELECT *, {_X('x + 0.01*ax', 'y + 0.01*ay')} AS bx, {_Y('x + 0.01*ax', 'y + 0.01*ay')} AS by_ FROM (SELECT *, {_X('x', 'y')} AS ax, {_Y('x', 'y')} AS ay FROM s WHERE k < 200))))
SELECT scenario, round(CAST(k * 0.02 AS DOUBLE), 6) AS t, round(x, 6) AS prey, round(y, 6) AS pred FROM s"""

ORACLES["viterbi_states"] = f"""WITH RECURSIVE {DAY}, d AS MATERIALIZED (SELECT t, rn, CAST(y >= 6 AS INT) AS busy FROM day),
f(rn, a, b, pa, pb) AS (SELECT rn, ln(0.5) + ln(CASE busy WHEN 0 THEN 0.8 ELSE 0.2 END), ln(0.5) + ln(CASE busy WHEN 0 THEN 0.3 ELSE 0.7 END), 0, 0 FROM d WHERE rn = 1 UNION ALL
SELECT d.rn, greatest(a + ln(0.9), b + ln(0.1)) + ln(CASE busy WHEN 0 THEN 0.8 ELSE 0.2 END), greatest(a + ln(0.1), b + ln(0.9)) + ln(CASE busy WHEN 0 THEN 0.3 ELSE 0.7 END),
CASE WHEN a + ln(0.9) >= b + ln(0.1) THEN 0 ELSE 1 END, CASE WHEN a + ln(0.1) >= b + ln(0.9) THEN 0 ELSE 1 END FROM f JOIN d ON d.rn = f.rn + 1),
g AS MATERIALIZED (SELECT * FROM f), p(rn, s) AS (SELECT rn, CASE WHEN a >= b THEN 0 ELSE 1 END FROM g WHERE rn = (SELECT max(rn) FROM g) UNION ALL
SELECT p.rn - 1, CASE p.s WHEN 0 THEN g.pa ELSE g.pb END FROM p JOIN g ON g.rn = p.rn WHERE p.rn > 1)
SELECT 'orders' AS series_id, t, busy, CAST(s AS BIGINT) AS state FROM p JOIN d USING (rn)"""

ORACLES["spline_derivative"] = f"""WITH RECURSIVE {DAY}, k AS MATERIALIZED (SELECT rn, n, t, x, t - lag(t) OVER w AS hl, lead(t) OVER w - t AS hr, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS sl, (lead(x) OVER w - x) / (lead(t) OVER w - t) AS sr FROM day WINDOW w AS (ORDER BY rn)),
e AS MATERIALIZED (SELECT rn, n, CASE WHEN hl IS NULL OR hr IS NULL THEN 0 ELSE hl END AS low, CASE WHEN hl IS NULL OR hr IS NULL THEN 1 ELSE 2 * (hl + hr) END AS mid, CASE WHEN hl IS NULL OR hr IS NULL THEN 0 ELSE hr END AS up, CASE WHEN hl IS NULL OR hr IS NULL THEN 0 ELSE 6 * (sr - sl) END AS rhs FROM k),
f(rn, mid, up, rhs) AS (SELECT rn, CAST(mid AS DOUBLE), CAST(up AS DOUBLE), CAST(rhs AS DOUBLE) FROM e WHERE rn = 1 UNION ALL SELECT e.rn, e.mid - e.low / f.mid * f.up, CAST(e.up AS DOUBLE), e.rhs - e.low / f.mid * f.rhs FROM f JOIN e ON e.rn = f.rn + 1),
g AS MATERIALIZED (SELECT * FROM f), b(rn, m) AS (SELECT rn, rhs / mid FROM g WHERE rn = (SELECT max(rn) FROM g) UNION ALL SELECT g.rn, (g.rhs - g.up * b.m) / g.mid FROM b JOIN g ON g.rn = b.rn - 1),
m AS (SELECT rn, m, lag(m) OVER (ORDER BY rn) AS before, lead(m) OVER (ORDER BY rn) AS after FROM b)
SELECT 'orders' AS series_id, t, round(CASE WHEN hr IS NOT NULL THEN sr - hr * (2 * m + after) / 6 ELSE sl + hl * (before + 2 * m) / 6 END, 6) AS d_x FROM k JOIN m USING (rn)"""

ORACLES["backtest_origins"] = f"""WITH {DAY}, k AS MATERIALIZED (SELECT rn - 1 AS r, n, t, x, (lead(x) OVER w - x) / (lead(t) OVER w - t) AS ahead, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS behind, t - lag(t) OVER w AS hl, lead(t) OVER w - t AS hr FROM day WINDOW w AS (ORDER BY rn)),
g AS MATERIALIZED (SELECT *, (hr * behind + hl * ahead) / (hl + hr) AS inner_ FROM k), o AS (SELECT DISTINCT CAST(greatest(3, round(i * (n - 21) / 7.0)) AS BIGINT) AS o FROM (SELECT max(n) AS n FROM day), (SELECT unnest(range(8)) AS i)),
f AS (SELECT o, sum(x * CASE WHEN r = 0 THEN ahead WHEN r = o THEN behind ELSE inner_ END) / sum(x * x) AS rate FROM o JOIN g ON r <= o GROUP BY 1),
e AS (SELECT f.o, a.x - p.x * exp(rate * (a.t - p.t)) AS e, a.x - p.x AS base FROM f JOIN g p ON p.r = f.o JOIN g a ON a.r BETWEEN f.o + 1 AND f.o + 20)
SELECT 'orders' AS series_id, o AS origin, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sqrt(sum(e * e) / sum(base * base)), 6) AS skill FROM e GROUP BY o"""

ORACLES["pelt_segments"] = f"""WITH RECURSIVE {DAY}, p AS MATERIALIZED (SELECT list_prepend(0.0, list(s ORDER BY rn)) AS s, list_prepend(0.0, list(q ORDER BY rn)) AS q, max(n) AS n FROM (SELECT rn, n, sum(x) OVER (ORDER BY rn) AS s, sum(x*x) OVER (ORDER BY rn) AS q FROM day)),
f(e, best, back) AS (SELECT 2, [-0.5::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE], [0::BIGINT, 0, 0] UNION ALL
SELECT e + 1, list_append(best, list_min(c)), list_append(back, list_position(c, list_min(c)) - 1) FROM (SELECT e, best, back, list_transform(range(1, e), lambda i: best[i] + 0.5 + q[e + 2] - q[i] - (s[e + 2] - s[i]) * (s[e + 2] - s[i]) / (e + 2 - i)) AS c FROM f, p WHERE e < n)),
z AS MATERIALIZED (SELECT back, e FROM f ORDER BY e DESC LIMIT 1), b(a, e) AS (SELECT back[e + 1], CAST(e AS BIGINT) FROM z UNION ALL SELECT back[a + 1], a FROM b, z WHERE a > 0)
SELECT 'orders' AS series_id, row_number() OVER (ORDER BY b.e) - 1 AS segment, b.a AS start, b.e AS "end", round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS sse FROM b JOIN day ON rn > b.a AND rn <= b.e GROUP BY b.a, b.e"""

ORACLES["bocpd_run_lengths"] = f"""WITH RECURSIVE {DAY}, p AS MATERIALIZED (SELECT list_prepend(0.0, list(s ORDER BY rn)) AS s, list(x ORDER BY rn) AS x, max(n) AS n FROM (SELECT rn, n, x, sum(x) OVER (ORDER BY rn) AS s FROM day)),
f(k, w) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT k + 1, list_transform(list_prepend(list_sum(j) * 0.02, list_transform(j, lambda v: v * 0.98)), lambda v: v / list_sum(j)) FROM
(SELECT k, list_transform(range(1, k + 2), lambda i: w[i] * exp(-0.5 * pow(x[k + 1] - (s[k + 1] - s[k + 2 - i]) / (0.001 + i - 1), 2) / (1 + 1 / (0.001 + i - 1))) / sqrt(2 * pi() * (1 + 1 / (0.001 + i - 1)))) AS j FROM f, p WHERE k < n))
SELECT 'orders' AS series_id, t, list_position(w, list_max(w)) - 1 AS run_length FROM f JOIN day ON day.rn = f.k"""


def solver_sql(head: str, systems: str, p: int, threshold: float, keep: str, ridge: float = 1e-10, rounds: int = 20) -> str:
    """Thresholded least squares in SQL: systems has (k, g, b): per system the list of rows of the Gram matrix and the right side.

    One step of the recursion clears a column (the matrix is positive definite, so no pivots are looked for); after the last, the
    terms below the threshold go and it begins anew, until none goes.
    """
    masked = lambda act: f"list_transform(range(1, {p + 1}), lambda i: list_append(list_transform(range(1, {p + 1}), lambda j: CASE WHEN {act}[i] AND {act}[j] THEN g[i][j] + CASE WHEN i = j THEN {ridge} ELSE 0 END WHEN i = j THEN 1.0 ELSE 0.0 END), CASE WHEN {act}[i] THEN b[i] ELSE 0.0 END))"
    every = f"list_transform(range({p}), lambda i: true)"
    kept = f"list_transform(range(1, {p + 1}), lambda i: act[i] AND abs(m[i][{p + 1}]) >= {threshold})"
    return f"""WITH RECURSIVE {head}, sys AS MATERIALIZED ({systems}),
st(k, c, round, act, m, done) AS (SELECT k, 1, 1, {every}, {masked(every)}, false FROM sys UNION ALL
SELECT k, CASE WHEN c <= {p} THEN c + 1 ELSE 1 END, CASE WHEN c <= {p} THEN round ELSE round + 1 END, CASE WHEN c <= {p} THEN act ELSE new END,
CASE WHEN c <= {p} THEN list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: CASE WHEN i = c THEN m[c][j] / m[c][c] ELSE m[i][j] - m[i][c] / m[c][c] * m[c][j] END)) WHEN new = act THEN m ELSE {masked('new')} END, c > {p} AND (new = act OR round > {rounds})
FROM (SELECT st.*, g, b, {kept} AS new FROM st JOIN sys USING (k) WHERE NOT done))
{keep} FROM (SELECT k, m FROM st WHERE done)"""


def gram_sql(rows: str, terms: list[str], targets: list[tuple[str, str]]) -> str:
    g = "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in terms) + "]" for a in terms) + "]"
    return " UNION ALL ".join(f"SELECT '{k}' AS k, {g} AS g, [" + ", ".join(f"sum({a} * {y})" for a in terms) + f"] AS b FROM {rows}" for k, y in targets)



def _names(variables: list[str]) -> list[str]:
    return features.monomial_names(variables, 2)


def _sql_terms(variables: list[str]) -> list[str]:
    return ["1.0::DOUBLE" if n == "1" else n for n in _names(variables)]


_SPELLED = _names(["d", "q", "x"])
ORACLES["stlsq_laws"] = solver_sql(LI, gram_sql("li", _sql_terms(["d", "q", "x"]), [("y", "y")]), len(_SPELLED), 0.05, "SELECT unnest([" + ", ".join(f"'{n}'" for n in _SPELLED) + f"]) AS term, unnest(list_transform(m, lambda r: round(r[{len(_SPELLED) + 1}], 6))) AS coefficient, unnest(list_transform(m, lambda r: r[{len(_SPELLED) + 1}] != 0)) AS active")

_TWO = _names(["x", "y"])
_D = "-(tn - t) * {p} / ((t - tp) * (tn - tp)) + ((tn - t) - (t - tp)) * {v} / ((t - tp) * (tn - t)) + (t - tp) * {n} / ((tn - t) * (tn - tp))"
ORACLES["discover_laws"] = "SELECT state, term, coefficient FROM (" + solver_sql(
    f"{DAY}, sc AS (SELECT t / 100 AS t, x, y / 10 AS y FROM day), nb AS (SELECT *, lag(t) OVER w AS tp, lead(t) OVER w AS tn, lag(x) OVER w AS xp, lead(x) OVER w AS xn, lag(y) OVER w AS yp, lead(y) OVER w AS yn FROM sc WINDOW w AS (ORDER BY t)), dv AS (SELECT x, y, {_D.format(p='xp', v='x', n='xn')} AS dx, {_D.format(p='yp', v='y', n='yn')} AS dy FROM nb WHERE tp IS NOT NULL AND tn IS NOT NULL)",
    gram_sql("dv", _sql_terms(["x", "y"]), [("x", "dx"), ("y", "dy")]), len(_TWO), 0.05,
    "SELECT k AS state, unnest([" + ", ".join(f"'{n}'" for n in _TWO) + f"]) AS term, unnest(list_transform(m, lambda r: round(r[{len(_TWO) + 1}], 6))) AS coefficient",
) + ") WHERE coefficient != 0"


_SWITCHED = "sw AS (SELECT n_name AS series_id, i, i * 0.05::DOUBLE AS t, CASE WHEN i < 100 THEN exp((0.1 + n_nationkey / 100.0) * i * 0.05) ELSE exp((0.1 + n_nationkey / 100.0) * 5 - 0.35 * (i - 100) * 0.05) END AS v FROM nation, (SELECT unnest(range(200)) AS i))"


@query(f"""WITH RECURSIVE {_SWITCHED}, d AS (SELECT *, (lead(v) OVER w - lag(v) OVER w) / (lead(t) OVER w - lag(t) OVER w) AS d FROM sw WINDOW w AS (PARTITION BY series_id ORDER BY i)),
j AS (SELECT unnest(range(11)) AS j), w AS MATERIALIZED (SELECT series_id, j, min(t) AS a, max(t) AS b, sum(d * v) FILTER (i > 16 * j AND i < 16 * j + 31) AS dx, sum(v * v) FILTER (i > 16 * j AND i < 16 * j + 31) AS xx, sum(d * d) FILTER (i > 16 * j AND i < 16 * j + 31) AS dd, avg(v * v) AS vv FROM d JOIN j ON i >= 16 * j AND i < 16 * j + 32 GROUP BY 1, 2),
r AS MATERIALIZED (SELECT *, dx / xx AS own, greatest(sqrt(greatest(dd - dx * dx / xx, 0) / 30), 0.001 * greatest(1.0, sqrt(vv))) AS room FROM w),
st(series_id, j, rate, scale, streak, drift, old, hit) AS (SELECT series_id, j, own, room, 0, 0.0::DOUBLE, own, false FROM r WHERE j = 0 UNION ALL
SELECT series_id, j, CASE WHEN hit THEN own ELSE rate END, CASE WHEN hit THEN room ELSE scale END, CASE WHEN hit THEN 0 ELSE streak END, drift, rate, hit FROM (SELECT *, streak >= 2 AS hit FROM (SELECT *, CASE WHEN drift > 3 THEN before + 1 ELSE 0 END AS streak FROM
(SELECT r.*, st.rate, st.scale, st.streak AS before, sqrt(greatest(r.dd - 2 * st.rate * r.dx + st.rate * st.rate * r.xx, 0) / 30) / st.scale AS drift FROM st JOIN r ON r.series_id = st.series_id AND r.j = st.j + 1))))
SELECT st.series_id, CAST(st.j AS BIGINT) AS "window", round(a, 6) AS start_t, round(b, 6) AS end_t, round(drift, 2) AS drift, round(old, 6) AS old_rate, round(rate, 6) AS new_rate FROM st JOIN r USING (series_id, j) WHERE hit""")
def online_switches(spark, sf_dir):
    """Growth that turns into decay, one series a nation: the changes that the online law finds."""
    i, r = F.col("i"), 0.1 + F.col("n_nationkey") / 100
    rows = table(spark, sf_dir, "nation").crossJoin(spark.range(200).withColumnRenamed("id", "i"))  # 200 literal steps for each row
    v = F.when(i < 100, F.exp(r * i * 0.05)).otherwise(F.exp(r * 5 - 0.35 * (i - 100) * 0.05))
    found = online.changes(rows.select(F.col("n_name").alias(KEY), (i * 0.05).alias(TIME), v.alias("x")), "x")
    return rounded(found).withColumn("drift", F.round("drift", 2))


@query(f"WITH {LI} SELECT l_orderkey, l_linenumber, round(q, 6) AS q, round(d, 6) AS d, round(d*d, 6) AS \"d*d\", round(d*q, 6) AS \"d*q\", round(q*q, 6) AS \"q*q\" FROM li")
def feature_constrained(spark, sf_dir):
    terms = features.constrained(features.polynomial(["d", "q", "x"], 2), {"d", "q"}, 3, True)
    return rounded(features.design(lineitem_rows(spark, sf_dir), terms, ["l_orderkey", "l_linenumber"]))


def _numbered_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return log.sequenced(e, "event_type", "us")


_SEQ = "sq AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS sequence, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"WITH {_SEQ} SELECT event_id, event_type, us, sequence FROM sq")
def event_sequence(spark, sf_dir):
    return _numbered_events(spark, sf_dir)


@query(f"WITH {_SEQ} SELECT event_id, event_type, us, sequence FROM sq WHERE event_type = 'click' AND sequence > 500")
def events_after(spark, sf_dir):
    return log.events_after(_numbered_events(spark, sf_dir), "event_type", "click", 500)


@query(f"WITH {_SEQ} SELECT event_id, event_type, us, sequence FROM sq WHERE sequence > n - 20")
def events_retained(spark, sf_dir):
    return log.retained(_numbered_events(spark, sf_dir), "event_type", 20)


@query("WITH s AS (SELECT event_type, epoch_us(ts) AS us, event_id % 100 AS sequence, lag(event_id % 100) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events) SELECT event_type, us, sequence, before FROM s WHERE sequence <= before")
def events_out_of_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 100).alias("sequence"))
    return log.out_of_order(e, "event_type", "us")


@query(f"WITH {LI}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(regr_intercept(y, {c}), 6) AS intercept, round(regr_slope(y, {c}), 6) AS slope, round(regr_r2(y, {c}), 6) AS r2 FROM li" for c in "qdx") + ") SELECT * FROM r ORDER BY r2 DESC LIMIT 1")
def best_predictor(spark, sf_dir):
    return rounded(estimators.best_predictor(lineitem_rows(spark, sf_dir), ["d", "q", "x"], "y"))


@query(f"WITH {LI}, c AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM li) SELECT l_orderkey, l_linenumber, round(a + b * q, 6) AS prediction FROM li, c")
def regression_predictions(spark, sf_dir):
    rows = lineitem_rows(spark, sf_dir)
    model = estimators.Regression(["q"], "y", 1, 0.0).fit(rows)
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "prediction"))


@query("SELECT epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS us, round(avg(o_totalprice), 4) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, round(avg(o_totalprice), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1")
def daily_prices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("o"), F.max("o_totalprice").alias("h"), F.min("o_totalprice").alias("l"), F.avg("o_totalprice").alias("c"), F.count("*").alias("v"))
    named = o.withColumn("w", F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z")))
    return rounded(plugins.daily_prices(named, {"time": "w", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}), 4)


@query()
def law_history(spark, sf_dir):
    """Growth that turns into decay, one series a nation: the laws found, and found anew."""
    i, r = F.col("i"), 0.1 + F.col("n_nationkey") / 100
    rows = table(spark, sf_dir, "nation").crossJoin(spark.range(200).withColumnRenamed("id", "i"))  # 200 literal steps for each row
    v = F.when(i < 100, F.exp(r * i * 0.05)).otherwise(F.exp(r * 5 - 0.35 * (i - 100) * 0.05))
    found = laws.history(rows.select(F.col("n_name").alias(KEY), (i * 0.05).alias(TIME), v.alias("x")), ["x"], window=20, degree=1)
    return rounded(found.drop("revision", "prior_revision", "diff", "max_abs_z"))


@query("WITH r AS (SELECT l_suppkey % 9 AS k, l_linenumber AS term FROM lineitem GROUP BY 1, 2 HAVING avg(l_discount) > 0.05), n AS (SELECT k, list(term) AS s FROM r GROUP BY 1), p AS (SELECT len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM n a JOIN n b ON a.k < b.k) SELECT term, round(count(*) / (SELECT count(*) FROM n), 6) AS frequency, round((SELECT avg(j) FROM p), 6) AS similarity FROM r GROUP BY 1")
def selection_stability(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("k"), F.col("l_linenumber").alias("term")).agg(F.avg("l_discount").alias("m")).where("m > 0.05")
    return rounded(selection.stability_table(l.select("k", "term"), "k", "term"))


@query()
def model_selection(spark, sf_dir):
    """The price by polynomials of quantity, discount and tax, in order of the order's key: degree and threshold by held-out folds."""
    rows = lineitem_rows(spark, sf_dir).select(F.lit("all").alias(KEY), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias(TIME), "d", "q", "x", "y")
    return rounded(selection.select_model(rows, ["d", "q", "x"], ("y", F.col("y")), [1, 2], [0.01, 0.05, 0.2], 3))


@query()
def law_ensemble(spark, sf_dir):
    """How often each term is in the price's law over twenty seeded halves of the rows."""
    rows = lineitem_rows(spark, sf_dir).select(F.lit("all").alias(KEY), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias(TIME), "d", "q", "x", "y")
    return rounded(selection.subsample_ensemble(rows, features.polynomial(["d", "q", "x"], 1), ("y", F.col("y")), 20, 0.5, 7, 0.02))
