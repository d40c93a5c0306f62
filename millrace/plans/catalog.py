"""The registered queries over the operators of this library, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numeric, parse, text
from millrace.operators import aggregates, cleaning, cohort, columns, compare, filters, geo, joins, kernels, market, metrics, ordering, profiling, saletext, sampling, scoring, sets, textrules, timeseries, windows
from millrace.plans import products
from millrace.plans.registry import ORACLES, QUERIES, query, table
from millrace.sources import sinks
from millrace.storage import written
from millrace.streaming import feed

FLAGSHIP = "agg4_grouping_sets"


# ---- cleaning and parsing


@query(
    """SELECT l_linenumber, count(*) AS n, count(v) AS present FROM (
  SELECT l_linenumber, CASE WHEN lower(trim(s)) IN ('', 'null', 'nan', 'na', 'n/a', 'none', '-', '--') THEN NULL ELSE trim(s) END AS v FROM (
    SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN ' N/A ' WHEN 2 THEN '-' WHEN 3 THEN 'NULL' ELSE ' ' || l_returnflag || ' ' END AS s FROM lineitem)) GROUP BY 1"""
)
def cln1_norm_missing(spark, d):
    s = F.when(F.col("l_linenumber") == 1, " N/A ").when(F.col("l_linenumber") == 2, "-").when(F.col("l_linenumber") == 3, "NULL").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")))
    rows = table(spark, d, "lineitem").select("l_linenumber", text.norm_missing(s, text.MISSING_MODEL).alias("v"))
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("present"))


@query(
    """SELECT doc_id, CAST(length(f) AS BIGINT) AS n_folded, md5(f) AS digest FROM (
  SELECT doc_id, replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd') AS f FROM documents WHERE lang IN ('fr', 'es', 'de', 'en'))"""
)
def fn_fold_accents(spark, d):
    rows = table(spark, d, "documents").filter(F.col("lang").isin("fr", "es", "de", "en")).select("doc_id", text.fold(F.col("text")).alias("f"))
    return rows.select("doc_id", F.length("f").cast("long").alias("n_folded"), F.md5("f").alias("digest"))


@query(
    """SELECT k, count(*) AS n, count(v) AS parsed, round(sum(v), 2) AS total FROM (
  SELECT k, CASE
    WHEN regexp_full_match(s, '[+-]?\\d{1,3}(,\\d{3})+\\.\\d+') THEN TRY_CAST(replace(s, ',', '') AS DOUBLE)
    WHEN regexp_full_match(s, '[+-]?\\d{1,3}(\\.\\d{3})+,\\d+') THEN TRY_CAST(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)
    WHEN regexp_full_match(s, '[+-]?\\d{1,3},\\d{3}') THEN NULL
    WHEN regexp_full_match(s, '[+-]?\\d+,\\d+') THEN TRY_CAST(replace(s, ',', '.') AS DOUBLE)
    WHEN regexp_full_match(s, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') THEN TRY_CAST(s AS DOUBLE) END AS v
  FROM (SELECT k, CASE k WHEN 0 THEN CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
      WHEN 1 THEN CAST(c // 100000 + 1 AS VARCHAR) || '.' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
      WHEN 2 THEN CAST(c // 100000 + 1 AS VARCHAR) || ',' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0')
      ELSE CAST(c AS VARCHAR) || 'd' END AS s
    FROM (SELECT l_orderkey % 4 AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem))) GROUP BY 1"""
)
def cln12_locale_number(spark, d):
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    whole, cents, thousand = F.floor(c / 100), c % 100, F.floor(c / 100) % 1000
    big = (F.floor(c / 100000) + 1).cast("string")
    s = F.when(F.col("k") == 0, F.concat(whole.cast("string"), F.lit(","), pad(cents, 2))).when(F.col("k") == 1, F.concat(big, F.lit("."), pad(thousand, 3), F.lit(","), pad(cents, 2)))
    s = s.when(F.col("k") == 2, F.concat(big, F.lit(","), pad(thousand, 3))).otherwise(F.concat(c.cast("string"), F.lit("d")))
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 4).select("k", parse.locale_number(s).alias("v"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("parsed"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN NULL ELSE o_orderdate END AS parsed FROM orders")
def cln18_parse_date(spark, d):
    o = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(o, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(o, "d/M/yyyy")).otherwise(F.date_format(o, "yyyy/MM/dd HH:mm"))
    return table(spark, d, "orders").select("o_orderkey", parse.parse_date(s).alias("parsed"))


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS dd, isodow(ts) - 1 AS dow FROM events")
def cln24_date_parts(spark, d):
    p = cleaning.date_parts(F.col("ts"))
    return table(spark, d, "events").select("event_id", *[p[k].cast("long").alias(a) for k, a in (("year", "y"), ("month", "m"), ("day", "dd"), ("day_of_week", "dow"))])


@query("SELECT event_type, user_id, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def cln7_drop_repeats(spark, d):
    rows = table(spark, d, "events").select("event_type", "user_id", F.col("event_id").alias("_row"))
    return cleaning.drop_repeats(rows).select("event_type", "user_id", F.col("_row").alias("first_event"))


@query(
    """WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t FROM events),
m AS (SELECT quantile_cont(v, 0.5) AS med FROM g),
t AS (SELECT t AS common FROM g WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, min(event_id) LIMIT 1)
SELECT coalesce(t, common) AS kind, count(*) AS n, round(sum(coalesce(v, med)), 2) AS total FROM g, m, t GROUP BY 1"""
)
def cln9_impute(spark, d):
    g = table(spark, d, "events").select(F.col("event_id").alias("_row"), F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).alias("v"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind"))
    filled, _ = cleaning.impute(g, ["v"], ["kind"])
    return filled.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS r, CASE WHEN o_totalprice > 0 THEN round(o_totalprice / (o_orderkey + 1), 6) END AS unit FROM orders")
def fn_round_and_unit_price(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numeric.round_even(F.col("o_totalprice") / 7, 2).alias("r"), F.round(numeric.unit_price(F.col("o_totalprice"), F.col("o_orderkey") + 1), 6).alias("unit"))


@query("SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '^\\s*[=+\\-@]')) AS guarded FROM conversations GROUP BY role")
def snk2_guard_formula(spark, d):
    rows = table(spark, d, "conversations").select("role", (text.guard_formula(F.col("text")) != F.coalesce("text", F.lit(""))).alias("g"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("guarded"))


# ---- filters

FUNNEL_SQL = "CASE WHEN l_quantity < 5 THEN 'small_quantity' WHEN l_discount > 0.08 THEN 'high_discount' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'too_early' ELSE 'kept' END"


@query(f"SELECT {FUNNEL_SQL} AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def flt2_funnel(spark, d):
    c = F.col
    reasons = [("small_quantity", c("l_quantity") < 5), ("high_discount", c("l_discount") > 0.08), ("returned", c("l_returnflag") == "R"), ("too_early", c("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))]
    return filters.funnel_counts(table(spark, d, "lineitem"), reasons)


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 THEN 'repeat'
  WHEN o_totalprice < 50000 THEN 'small' ELSE 'kept' END AS reason FROM orders) GROUP BY 1"""
)
def flt4_funnel_with_repeats(spark, d):
    rows = filters.mark_repeats(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")
    return filters.funnel_counts(rows, [("repeat", F.col("is_repeat")), ("small", F.col("o_totalprice") < 50000)])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'N') AND l_shipdate >= TIMESTAMP '2000-01-01'")
def flt1_range_filter(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 12) & F.col("l_returnflag").isin("A", "N") & (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, min(o_orderkey) AS only_order FROM orders GROUP BY 1 HAVING count(*) = 1")
def flt11_unique_ids(spark, d):
    return cleaning.unique_ids(table(spark, d, "orders"), "o_custkey").select("o_custkey", F.col("o_orderkey").alias("only_order"))


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'que') AND lang = 'fr'")
def flt10_search(spark, d):
    return filters.search(table(spark, d, "documents"), ["text"], "Qué", lang="fr").select("doc_id")


@query(
    """SELECT 'price_positive' AS "check", count(*) FILTER (NOT (o_totalprice > 1000)) AS n FROM orders
UNION ALL SELECT 'known_status', count(*) FILTER (NOT (o_orderstatus IN ('O', 'F'))) FROM orders
UNION ALL SELECT 'repeated_key', count(*) - count(DISTINCT o_custkey) FROM orders"""
)
def o_chk_constraints(spark, d):
    checks = {"price_positive": F.col("o_totalprice") > 1000, "known_status": F.col("o_orderstatus").isin("O", "F")}
    return filters.violations(table(spark, d, "orders"), checks, ["o_custkey"])


# ---- joins


@query(
    """SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN '' ELSE coalesce(min(l_returnflag), '') END AS flag FROM lineitem GROUP BY 1"""
)
def jn1_conflicting_lookup(spark, d):
    return joins.resolve_conflicts(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").withColumnRenamed("l_returnflag", "flag")


@query(
    """SELECT c.c_custkey, coalesce(a.n, 0) AS n_recent, coalesce(a.total, 0) AS total, CASE WHEN e.o_custkey IS NULL THEN 0 ELSE 1 END AS ever_urgent
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1) a ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') e ON e.o_custkey = c.c_custkey"""
)
def jn2_jn3_activity_and_existence(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    recent = orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_recent"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    with_activity = joins.left_fill(table(spark, d, "customer").select("c_custkey"), recent, ["c_custkey"])
    return joins.exists_flag(with_activity, orders.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"], "ever_urgent")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def jn4_semi(spark, d):
    often = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count().filter("count > 12")
    return joins.semi(table(spark, d, "customer"), often, ["c_custkey"]).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def jn5_anti(spark, d):
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return joins.anti(table(spark, d, "part"), gone, ["p_partkey"]).select("p_partkey")


@query("SELECT s_suppkey, coalesce(n_name, 'Unknown') AS n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 10")
def jn6_dictionary_lookup(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup(table(spark, d, "supplier"), nation, ["s_nationkey"], "n_name").select("s_suppkey", "n_name")


GEO_SQL = "SELECT n_nationkey AS region, (n_nationkey * 7) % 50 - 10.0 AS lat, (n_nationkey * 13) % 90 + 20.0 AS lon FROM nation"


def _centers(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("region"), ((k * 7) % 50 - F.lit(10.0)).alias("lat"), ((k * 13) % 90 + F.lit(20.0)).alias("lon"))


def _segment_sizes(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH c AS ({GEO_SQL}), s AS (SELECT c_nationkey AS region, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1, 2),
k AS (SELECT DISTINCT kind FROM s), j AS (
  SELECT a.region, k.kind, b.region AS donor, s.n, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
  FROM c a, k, c b, s WHERE s.region = b.region AND s.kind = k.kind AND a.region <> b.region AND s.n >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY region, kind ORDER BY km, donor) AS rk FROM j WHERE km <= 2500), f AS (SELECT *, count(*) OVER (PARTITION BY region, kind) AS m FROM r WHERE rk <= 3)
SELECT region, kind, donor, rk AS "rank", round(km, 3) AS km, n FROM f WHERE m >= 2"""
)
def jn8_nearest_donors(spark, d):
    centers, sizes = _centers(spark, d), _segment_sizes(spark, d)
    points = centers.crossJoin(joins.small(sizes.select("kind").distinct()))
    donors = sizes.join(joins.small(centers), "region")
    near = joins.nearest_donors(points, donors, "kind", "region", most_km=2500.0, least_n=3)
    return near.withColumn("km", F.round("km", 3)).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), a AS (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n, quantile_cont(c_acctbal, 0.5) AS v FROM customer GROUP BY 1, 2),
b AS (SELECT c_nationkey AS k, count(*) AS n, quantile_cont(c_acctbal, 0.5) AS v FROM customer GROUP BY 1), r AS (SELECT n_regionkey AS k, count(*) AS n, quantile_cont(c_acctbal, 0.5) AS v FROM customer JOIN n ON n_nationkey = c_nationkey GROUP BY 1)
SELECT c_custkey, CASE WHEN a.n >= 15 THEN 'SEGMENT' WHEN b.n >= 60 THEN 'NATION' WHEN r.n >= 30 THEN 'REGION' ELSE 'NONE' END AS resolution_level,
round(CASE WHEN a.n >= 15 THEN a.v WHEN b.n >= 60 THEN b.v WHEN r.n >= 30 THEN r.v END, 4) AS resolved_value, CASE WHEN a.n >= 15 THEN a.n WHEN b.n >= 60 THEN b.n WHEN r.n >= 30 THEN r.n END AS resolved_n
FROM customer c JOIN n ON n_nationkey = c_nationkey LEFT JOIN a ON a.k = c_nationkey AND a.seg = c_mktsegment LEFT JOIN b ON b.k = c_nationkey LEFT JOIN r ON r.k = n_regionkey"""
)
def jn9_fallback_resolution(spark, d):
    c = table(spark, d, "customer").join(joins.small(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    stat = lambda *keys: c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("c_acctbal", 0.5).alias("v"))
    levels = [("SEGMENT", stat("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 15), ("NATION", stat("c_nationkey"), ["c_nationkey"], 60), ("REGION", stat("n_regionkey"), ["n_regionkey"], 30)]
    out = joins.resolve_levels(c, levels, "v")
    return out.select("c_custkey", "resolution_level", F.round("resolved_value", 4).alias("resolved_value"), "resolved_n")


@query("SELECT s_suppkey, o AS matched FROM supplier LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1 HAVING count(*) = 1) ON o_custkey = s_suppkey")
def jn10_exactly_one(spark, d):
    dim = table(spark, d, "orders").select(F.col("o_custkey").alias("s_suppkey"), F.col("o_orderkey").alias("matched"))
    return joins.exactly_one(table(spark, d, "supplier").select("s_suppkey"), dim, ["s_suppkey"], "matched")


@query(
    """SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) a
FULL JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 'X' ELSE n_name END AS v FROM nation WHERE n_nationkey > 4) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""
)
def jn11_conformance(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return joins.conformance(n.filter("k < 20"), n.filter("k > 4").withColumn("v", F.when(F.col("k") % 6 == 0, "X").otherwise(F.col("v"))), ["k"], "v")


@query(
    """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)
SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY b HAVING count(*) = 1)"""
)
def jn12_one_to_one(spark, d):
    p = table(spark, d, "lineitem").filter("l_quantity = 50 AND l_linenumber = 7").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return joins.one_to_one(p, "a", "b")


# ---- aggregates


def _agg1(how, sql):
    def run(spark, d):
        return aggregates.grouped(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", how)

    run.__name__ = f"agg1_{how}"
    value = "count(o_totalprice)" if how == "count" else f"round({sql}(o_totalprice), 2)"
    query(f"SELECT o_orderpriority, {value} AS value FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")(run)


for _how, _sql in (("mean", "avg"), ("sum", "sum"), ("count", "count"), ("min", "min"), ("max", "max")):
    _agg1(_how, _sql)

_POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(
    f"""SELECT CASE WHEN grouping(l_returnflag) = 1 AND grouping(l_linestatus) = 1 THEN 'all' WHEN grouping(l_returnflag) = 0 AND grouping(l_linestatus) = 1 THEN 'l_returnflag' WHEN grouping(l_returnflag) = 1 THEN 'l_linestatus' ELSE 'l_returnflag_and_l_linestatus' END AS scope,
l_returnflag, l_linestatus, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS undefined_count, count(*) FILTER (NOT isfinite(value)) AS nonfinite_count, count(*) FILTER (isfinite(value)) AS finite_count, min(value) AS min_value, max(value) AS max_value,
{", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in _POINTS)}
FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 2 THEN l_extendedprice / l_quantity END AS value FROM lineitem) GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))"""
)
def agg4_grouping_sets(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 2, F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    out = aggregates.scoped_distribution(rows, "l_returnflag", "l_linestatus", "value", _POINTS)
    return out.withColumns({f"p{round(p * 100)}": F.round(f"p{round(p * 100)}", 6) for p in _POINTS})


_LEVEL = "SELECT '{name}' AS level, {keys}, count(*) AS n, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, CASE WHEN count(*) >= 1000 THEN 'HIGH' WHEN count(*) >= 200 THEN 'MEDIUM' WHEN count(*) >= 30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS coverage FROM j GROUP BY ALL"


@query(
    "WITH j AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) "
    + " UNION ALL ".join(_LEVEL.format(name=n, keys=k) for n, k in (("REGION", "r_name, '' AS n_name, '' AS c_mktsegment"), ("NATION", "r_name, n_name, '' AS c_mktsegment"), ("SEGMENT", "r_name, n_name, c_mktsegment")))
)
def agg6_hierarchical_stats(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = table(spark, d, "customer").join(joins.small(n.join(r, F.col("r_regionkey") == F.col("n_regionkey"))), F.col("n_nationkey") == F.col("c_nationkey"))
    out = aggregates.level_stats(j, [("REGION", ["r_name"]), ("NATION", ["r_name", "n_name"]), ("SEGMENT", ["r_name", "n_name", "c_mktsegment"])], "c_acctbal")
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75")})


@query(
    """SELECT p_size, CASE WHEN grouping(p_brand) = 1 THEN '' ELSE p_brand END AS p_brand, CASE WHEN grouping(p_type) = 1 THEN '' ELSE p_type END AS p_type, count(*) AS n, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS p75
FROM part GROUP BY GROUPING SETS ((p_size), (p_size, p_brand), (p_size, p_type), (p_size, p_brand, p_type)) HAVING count(*) >= 5"""
)
def agg8_cube_with_blank(spark, d):
    out = aggregates.cube_with_blank(table(spark, d, "part"), "p_size", "p_brand", "p_type", "p_retailprice")
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75")})


@query(
    """WITH w AS (SELECT s_nationkey, s_acctbal, sum(1.0 / (1 + s_suppkey % 7)) AS w FROM supplier GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) / sum(w) OVER (PARTITION BY s_nationkey) AS c FROM w)
SELECT s_nationkey, min(s_acctbal) FILTER (c >= 0.25 - 1e-12) AS q25, min(s_acctbal) FILTER (c >= 0.5 - 1e-12) AS q50, min(s_acctbal) FILTER (c >= 0.75 - 1e-12) AS q75 FROM c GROUP BY 1"""
)
def agg10_weighted_quantiles(spark, d):
    rows = table(spark, d, "supplier").withColumn("w", 1.0 / (1 + F.col("s_suppkey") % 7))
    return aggregates.weighted_quantiles(rows, ["s_nationkey"], "s_acctbal", "w")


@query("SELECT count(*) AS n_groups, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS excess_rows, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows_in_groups, max(n) AS max_group_size FROM (SELECT md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def agg13_duplicate_groups(spark, d):
    return aggregates.duplicate_stats(table(spark, d, "documents"), F.md5(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")))


@query("SELECT size, count(*) AS n_groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def agg14_size_distribution(spark, d):
    return aggregates.size_distribution(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT count(*) FILTER (a > 1) AS l_returnflag, count(*) FILTER (b > 1) AS l_linestatus FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)")
def agg14_disagreements(spark, d):
    return aggregates.disagreements(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, min(t) AS first_time, max(t) AS last_time, count(*) AS n_inner, round(sum(a), 2) AS amount FROM (SELECT o_custkey, o_orderkey, min(l_shipdate) AS t, sum(l_extendedprice) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def agg15_two_level(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return aggregates.two_level(j, "o_custkey", "o_orderkey", "l_shipdate", "l_extendedprice").withColumn("amount", F.round("amount", 2))


@query("SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percentage FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def agg29_percentages(spark, d):
    return aggregates.with_percent(aggregates.frequency(table(spark, d, "events"), "event_type")).withColumn("percentage", F.round("percentage", 6))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def agg28_month_counts(spark, d):
    return aggregates.month_counts(table(spark, d, "orders"), "o_orderdate", "o_orderstatus")


@query("SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(28,10))) AS DOUBLE), 2) AS total FROM lineitem")
def agg17_exact_sum(spark, d):
    return table(spark, d, "lineitem").agg(F.round(aggregates.exact_sum(F.col("l_extendedprice")), 2).alias("total"))


@query("SELECT count(*) FILTER (r = 1) AS n_1, count(*) FILTER (r = 2) AS n_2, count(*) FILTER (r = 3) AS n_3, count(*) FILTER (r = 4) AS n_4, count(*) FILTER (r = 5) AS n_5, count(*) FILTER (r BETWEEN 1 AND 5) AS n, round(avg(r) FILTER (r BETWEEN 1 AND 5), 6) AS average, round(count(*) FILTER (r <= 2) / count(*) FILTER (r BETWEEN 1 AND 5), 6) AS low_ratio, round(count(*) FILTER (r IN (4, 5)) / count(*) FILTER (r BETWEEN 1 AND 5), 6) AS high_ratio FROM (SELECT l_linenumber AS r FROM lineitem WHERE l_linenumber > 0)")
def agg25_rating_summary(spark, d):
    return aggregates.rating_summary(table(spark, d, "lineitem"), "l_linenumber")


@query(
    """SELECT h AS hypothesis, count(*) AS n, t AS tolerance, count(*) FILTER (abs(l_extendedprice * f - l_quantity * 1000) / (l_quantity * 1000) <= t) AS matches
FROM lineitem, (VALUES ('unit', 1.0::DOUBLE), ('half', 0.5::DOUBLE), ('tenth', 0.1::DOUBLE)) x(h, f), (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) y(t) WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY h, t"""
)
def agg31_match_matrix(spark, d):
    return aggregates.match_matrix(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000, {"unit": 1.0, "half": 0.5, "tenth": 0.1}, (0.02, 0.05, 0.1))


@query("SELECT CASE WHEN abs(r / 0.5 - 1) <= 0.02 THEN '0.5' WHEN abs(r - 1) <= 0.02 THEN '1.0' WHEN abs(r / 2 - 1) <= 0.02 THEN '2.0' ELSE 'other' END AS factor, count(*) AS n FROM (SELECT l_extendedprice / (l_quantity * 1500) AS r FROM lineitem) GROUP BY 1")
def agg32_ratio_bins(spark, d):
    return aggregates.ratio_bins(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1500, (0.5, 1.0, 2.0))


@query("SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, count(DISTINCT (o_custkey, o_orderstatus)) FILTER (o_totalprice > 100000) AS pairs FROM orders GROUP BY 1")
def agg12_count_distinct(spark, d):
    pair = F.when(F.col("o_totalprice") > 100000, F.struct("o_custkey", "o_orderstatus"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(pair).alias("pairs"))


@query("SELECT n_nationkey, n, round(lo, 6) AS low, round(hi, 6) AS high FROM (SELECT n_nationkey, n, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS lo, (p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS hi FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS p FROM customer GROUP BY 1))")
def agg30_wilson(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("h"))
    low, high = numeric.wilson(F.col("h").cast("double"), F.col("n").cast("double"))
    return g.select("n_nationkey", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# ---- windows, order, sets, samples


@query(
    """SELECT t, y, lag(y, 1) OVER o AS lag_1, lag(y, 7) OVER o AS lag_7, CASE WHEN t >= 3 THEN round(avg(y) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) END AS rolling_mean_3,
CASE WHEN t >= 7 THEN round(stddev_pop(y) OVER (ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) END AS rolling_std_7
FROM (SELECT row_number() OVER (ORDER BY p) - 1 AS t, y FROM (SELECT date_trunc('month', o_orderdate) AS p, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)) WINDOW o AS (ORDER BY t)"""
)
def win2_lag_and_rolling(spark, d):
    s = timeseries.densify(timeseries.period_sums(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "monthly"), "monthly").select("t", F.round("y", 2).alias("y"))
    out = windows.lag_features(s, "y", "t", [1, 7], [3], [7])
    return out.withColumns({"rolling_mean_3": F.round("rolling_mean_3", 6), "rolling_std_7": F.round("rolling_std_7", 4)})


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM (SELECT * FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)) GROUP BY 1")
def win1_last_by_time(spark, d):
    return cleaning.last_by_time(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("SELECT event_type, event_id, r AS sample_rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) AS r FROM events) WHERE r <= 20")
def win8_top_hashed(spark, d):
    out = windows.top_hashed(table(spark, d, "events").select("event_type", "event_id"), "event_type", F.col("event_id").cast("string"), 20)
    return out.withColumn("sample_rank", F.col("sample_rank").cast("long"))


@query("SELECT CAST(epoch(t) - epoch(p) AS BIGINT) AS delta, count(*) AS n, min(t) AS first_seen FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT o_orderdate AS t FROM orders)) WHERE p IS NOT NULL GROUP BY 1")
def win10_time_deltas(spark, d):
    return windows.time_deltas(table(spark, d, "orders"), "o_orderdate").withColumnRenamed("first_seen", "first_seen")


@query("WITH s AS (SELECT CAST(epoch(date_trunc('day', ts)) // 86400 AS BIGINT) AS t, value AS y FROM events), e AS (SELECT max(t) AS m FROM s) SELECT round(sum(y) FILTER (t > m - 7), 2) AS current, round(sum(y) FILTER (t <= m - 7 AND t > m - 14), 2) AS previous FROM s, e")
def win13_block_change(spark, d):
    s = table(spark, d, "events").select(F.unix_date(F.to_date("ts")).cast("long").alias("t"), F.col("value").alias("y"))
    return windows.block_change(s, "t", "y", 7).select(F.round("current", 2).alias("current"), F.round("previous", 2).alias("previous"))


@query("(SELECT 'price' AS metric, l_extendedprice AS value, l_orderkey, l_linenumber FROM lineitem ORDER BY 2 DESC, 3, 4 LIMIT 5) UNION ALL (SELECT 'unit' AS metric, l_extendedprice / l_quantity AS value, l_orderkey, l_linenumber FROM lineitem ORDER BY 2 DESC, 3, 4 LIMIT 5)")
def ord2_extremes(spark, d):
    m = {"price": F.col("l_extendedprice"), "unit": F.col("l_extendedprice") / F.col("l_quantity")}
    return ordering.extremes(table(spark, d, "lineitem"), m, ["l_orderkey", "l_linenumber"])


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def ord4_top_values(spark, d):
    return ordering.top_values(table(spark, d, "lineitem"), "l_suppkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def ord7_page(spark, d):
    return ordering.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 25)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set3_difference(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return sets.set_difference(a, b)


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def set1_concat(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return sets.concat(a, b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(('0x' || md5(CAST(event_id AS VARCHAR))[1:8])::BIGINT % 2 AS BIGINT) AS part FROM events")
def smp9_parity_split(spark, d):
    return sampling.parity_split(table(spark, d, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h")), "h").select("event_id", "part")


@query("WITH g AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderdate, sum(n) OVER (ORDER BY o_orderdate) - n AS b, n, floor((SELECT count(*) FROM orders) * 0.75) AS k FROM g), x AS (SELECT o_orderdate AS cut FROM c WHERE b <= k AND b + n > k) SELECT o_orderkey, o_orderdate >= cut AS is_test FROM orders, x")
def smp6_temporal_cut(spark, d):
    return sampling.temporal_cut(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "is_test")


@query(
    "WITH h AS (SELECT o_orderkey, o_orderpriority AS k, CAST(('0x' || md5('42|' || CAST(o_orderkey AS VARCHAR))[1:13])::BIGINT AS DOUBLE) AS h FROM orders), c AS (SELECT k, quantile_cont(h, 0.25) AS cut FROM h GROUP BY k) SELECT o_orderkey, h <= cut AS is_test FROM h JOIN c ON h.k = c.k"
)
def smp5_stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey")).select("o_orderkey", "is_test")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM orders")
def smp7_folds(spark, d):
    return sampling.folds(table(spark, d, "orders"), F.col("o_orderkey"), 5, "o_orderstatus").select("o_orderkey", "fold")


# ---- profiles

_PROFILE = "SELECT '{c}' AS name, count({c}) AS n_valid, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, round(CAST(sum(CAST({c} AS DECIMAL(28, 10))) AS DOUBLE) / count({c}), 6) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem"


@query(" UNION ALL ".join(_PROFILE.format(c=c) for c in ("l_quantity", "l_discount", "l_linenumber")))
def prf1_numeric_profile(spark, d):
    return profiling.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi, least(30, ceil(sqrt(count(*)))) AS b FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / b)), b - 1) AS INT) AS bin, count(*) AS n FROM events, s GROUP BY 1")
def prf2_histogram(spark, d):
    return profiling.histogram(table(spark, d, "events"), "value")


@query("SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1")
def prf3_date_distribution(spark, d):
    return profiling.date_distribution(table(spark, d, "orders"), "o_orderdate")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def prf4_frequency(spark, d):
    return aggregates.frequency(table(spark, d, "events"), "event_type")


@query()
def prf6_model_profile(spark, d):
    o = table(spark, d, "orders")
    return profiling.model_profile(o.select(*[F.col(c).cast("string").alias(c) for c in o.columns]), o.columns)


def _leakage_sql(source: str, target: str, features: tuple[str, ...], late: tuple[str, ...] = ()) -> str:
    one = (
        "SELECT '{f}' AS feature, s.same AS is_copy, s.n >= 10 AND s.k <= least(30, s.n // 5) AND s.most = 1 AND s.ys > 1 AS decides_target, s.r AS correlation, {late} AS suspicious_name FROM ("
        "SELECT bool_and(x = y) AS same, count(*) AS n, count(DISTINCT x) AS k, count(DISTINCT y) AS ys, max(d) AS most,"
        " CASE WHEN count(a) FILTER (b IS NOT NULL) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS r FROM ("
        "SELECT *, TRY_CAST(x AS DOUBLE) AS a, TRY_CAST(y AS DOUBLE) AS b, 0 AS o FROM (SELECT CAST({f} AS VARCHAR) AS x, CAST({t} AS VARCHAR) AS y FROM src) WHERE x IS NOT NULL AND y IS NOT NULL)"
        " JOIN (SELECT CAST({f} AS VARCHAR) AS x, count(DISTINCT {t}) AS d FROM src GROUP BY 1) USING (x)) s"
    )
    rows = " UNION ALL ".join(one.format(f=f, t=target, late=str(f in late).lower()) for f in features)
    return (
        f"WITH src AS ({source}) SELECT *, CASE WHEN is_copy THEN 'hard' WHEN decides_target OR coalesce(abs(correlation) >= 0.995, false) OR suspicious_name THEN 'warning' ELSE 'none' END AS severity FROM ({rows})"
    )


@query(_leakage_sql("SELECT *, o_orderstatus AS copy_of_status FROM orders", "o_orderstatus", ("copy_of_status", "o_orderpriority", "o_totalprice")))
def prf7_leakage_audit(spark, d):
    o = table(spark, d, "orders").withColumn("copy_of_status", F.col("o_orderstatus"))
    return columns.leakage_audit(o, "o_orderstatus", ["copy_of_status", "o_orderpriority", "o_totalprice"])


_LEAK = "SELECT *, CAST(l_quantity * 3 + l_tax AS DOUBLE) AS nearly, 'q' || CAST(CAST(l_quantity AS INT) % 7 AS VARCHAR) AS post_code, CASE WHEN l_linenumber < 5 THEN l_linenumber END AS sparse FROM lineitem"


@query(_leakage_sql(_LEAK, "l_quantity", ("l_extendedprice", "l_discount", "nearly", "post_code", "sparse"), late=("post_code",)))
def prf7_leakage_of_numbers(spark, d):
    line = table(spark, d, "lineitem")
    code = F.concat(F.lit("q"), (F.col("l_quantity").cast("int") % 7).cast("string"))
    line = line.withColumns({"nearly": F.col("l_quantity") * 3 + F.col("l_tax"), "post_code": code, "sparse": F.when(F.col("l_linenumber") < 5, F.col("l_linenumber"))})
    return columns.leakage_audit(line, "l_quantity", ["l_extendedprice", "l_discount", "nearly", "post_code", "sparse"])


#: Orders as a raw file of texts: missing tokens, blanks, three date formats, words among numbers.
_RAW = {
    "id": "CAST(o_orderkey % 1000 AS {text})",
    "status": "CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END",
    "sold_day": "CASE o_orderkey % 5 WHEN 0 THEN {dmy} WHEN 1 THEN {ymdhms} WHEN 2 THEN {ymd} WHEN 3 THEN 'on request' END",
    "amount": "CASE WHEN o_custkey % 9 = 0 THEN '-' || CAST(o_custkey AS {text}) WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN 'about 5' ELSE CAST(o_custkey AS {text}) END",
    "place": "'Street ' || CAST(o_custkey % 50 AS {text}) || ', ' || o_orderpriority",
}
_RAW_NAMES = list(_RAW)
_RAW_DUCK = "SELECT " + ", ".join(
    f"{e} AS {k}".format(text="VARCHAR", dmy="strftime(o_orderdate, '%d/%m/%Y %H:%M')", ymdhms="strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", ymd="strftime(o_orderdate, '%Y-%m-%d')") for k, e in _RAW.items()
) + " FROM orders"
_RAW_CELLS = f"WITH raw AS ({_RAW_DUCK}), cells AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, {c} AS value FROM raw" for i, c in enumerate(_RAW_NAMES)) + ")"
_PLAIN = r"'\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*'"


def _raw_orders(spark, d):
    forms = {"text": "STRING", "dmy": "date_format(o_orderdate, 'dd/MM/yyyy HH:mm')", "ymdhms": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", "ymd": "date_format(o_orderdate, 'yyyy-MM-dd')"}
    return table(spark, d, "orders").select(*[F.expr(e.format(**forms)).alias(k) for k, e in _RAW.items()])


@query(
    _RAW_CELLS + ", p AS (SELECT *, value IS NOT NULL AND lower(trim(value)) NOT IN ('', 'nan', 'null', 'none', 'n/a') AS ok FROM cells),"
    f" q AS (SELECT *, CASE WHEN ok AND regexp_full_match(value, {_PLAIN}) THEN TRY_CAST(trim(value) AS DOUBLE) END AS x, CASE WHEN ok THEN try_strptime(value, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M']) END AS t FROM p)"
    " SELECT name, count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_missing, count(DISTINCT value) FILTER (ok) AS n_distinct, count(*) FILTER (ok) - count(DISTINCT value) FILTER (ok) AS n_repeated,"
    " count(x) AS n_numeric, count(*) FILTER (ok AND x IS NULL) AS n_not_numeric, count(*) FILTER (x <= 0) AS n_nonpositive, min(x) AS least, max(x) AS greatest,"
    " count(t) AS n_dates, min(t) AS first_date, max(t) AS last_date, min(value) FILTER (ok) AS least_text, max(value) FILTER (ok) AS greatest_text FROM q GROUP BY name"
)
def prf11_file_profile(spark, d):
    return columns.file_profile(columns.cell_counts(_raw_orders(spark, d), _RAW_NAMES), _RAW_NAMES)


@query(f"WITH raw AS ({_RAW_DUCK}), r AS (SELECT CASE WHEN id::INT % 3 = 0 THEN NULL ELSE status END AS status, CASE WHEN id::INT % 3 > 0 THEN place END AS place FROM raw) SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(status, '')) = '' AND trim(coalesce(place, '')) = '') AS n_blank_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, place FROM r)) AS n_repeated_rows FROM r")
def prf11_table_profile(spark, d):
    third = F.col("id").cast("int") % 3 == 0
    raw = _raw_orders(spark, d).select(F.when(~third, F.col("status")).alias("status"), F.when(~third, F.col("place")).alias("place"))
    return columns.table_profile(raw, ["status", "place"])


@query(_RAW_CELLS + " SELECT name, value, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value ASC NULLS LAST) AS \"rank\" FROM cells GROUP BY name, value QUALIFY \"rank\" <= 30")
def prf11_top_values(spark, d):
    return columns.top_values(columns.cell_counts(_raw_orders(spark, d), _RAW_NAMES))


@query(_RAW_CELLS + " SELECT trim(split_part(value, ',', -1)) AS value, count(*) AS n FROM cells WHERE name = 'place' GROUP BY 1")
def prf11_last_tokens(spark, d):
    return columns.derived_counts(columns.cell_counts(_raw_orders(spark, d), ["place"]), "place", columns.last_token)


@query(
    _RAW_CELLS + ", s AS (SELECT place, name, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND regexp_matches(value, '^\\d+[-/]\\d')) AS dates, count(*) FILTER (ok AND regexp_full_match(value, '-?\\d+')) AS numbers"
    " FROM (SELECT *, value IS NOT NULL AND lower(trim(value)) NOT IN ('', 'null', 'nan', 'na', 'n/a', 'none', '-', '--') AS ok FROM cells) GROUP BY place, name),"
    " t AS (SELECT place, name, CASE WHEN dates / n > 0.7 THEN 'datetime' WHEN numbers / n > 0.7 THEN 'numeric' ELSE 'text' END AS type, dates / n + (name = 'sold_day')::INT AS date_score, numbers / n + (name = 'amount')::INT AS target_score FROM s),"
    " best AS (SELECT name FROM t ORDER BY date_score DESC, place LIMIT 1), goal AS (SELECT name FROM t WHERE name NOT IN (FROM best) ORDER BY target_score DESC, place LIMIT 1)"
    " SELECT name, type, date_score, target_score, false AS ambiguous_dates, CASE WHEN name IN (FROM best) AND date_score > 0.5 THEN 'time' WHEN name IN (FROM goal) THEN 'target' END AS suggested FROM t"
)
def prf8_inspection(spark, d):
    return columns.inspection(columns.cell_counts(_raw_orders(spark, d), _RAW_NAMES), _RAW_NAMES)


@query("SELECT count(*) FILTER (v IS NULL) AS v_missing, count(*) FILTER (v <= 0) AS v_nonpositive, CAST(0 AS BIGINT) AS v_nonfinite, count(DISTINCT (l_suppkey, l_returnflag)) AS l_suppkey_l_returnflag_keys FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN -l_quantity ELSE l_quantity END AS v FROM lineitem)")
def prf9_quality_row(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").withColumn("v", F.when(n == 6, -F.col("l_quantity")).when(n != 7, F.col("l_quantity")))
    return profiling.quality_row(rows, ["v"], [["l_suppkey", "l_returnflag"]])


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus <> 'O') AS other, true AS adds_up FROM orders")
def prf16_cross_totals(spark, d):
    return profiling.cross_totals(table(spark, d, "orders"), {"open": F.col("o_orderstatus") == "O", "other": F.col("o_orderstatus") != "O"})


@query("SELECT min(v) >= 0 AND max(v) > 0 AS pie, min(v) >= 0 AND max(v) > 0 AS doughnut, min(v) >= 0 AND max(v) > 0 AS treemap, min(v) >= 0 AND max(v) > 0 AS polar, count(*) BETWEEN 3 AND 12 AS radar FROM (SELECT round(avg(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment)")
def prf13_chart_gates(spark, d):
    return profiling.chart_gates(aggregates.grouped(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


# ---- series

_HOURS = "WITH s AS (SELECT date_trunc('hour', ts) AS p, sum(value) AS y FROM events GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(p) FROM s), (SELECT max(p) FROM s), INTERVAL 1 HOUR)) AS p), x AS (SELECT CAST(row_number() OVER (ORDER BY g.p) - 1 AS BIGINT) AS t, g.p AS period, coalesce(y, 0) AS y, y IS NULL AS is_missing FROM g LEFT JOIN s ON s.p = g.p)"


def _hourly(spark, d):
    return timeseries.densify(timeseries.period_sums(table(spark, d, "events"), "ts", "value", "hourly"), "hourly")


@query(f"{_HOURS} SELECT t, period, round(y, 4) AS y, is_missing FROM x")
def ts4_dense_grid(spark, d):
    return _hourly(spark, d).withColumn("y", F.round("y", 4))


@query(f"{_HOURS} SELECT round(regr_slope(y, t), 6) AS slope, round(regr_intercept(y, t), 4) AS intercept, count(*) AS n, CASE WHEN regr_slope(y, t) * (count(*) - 1) > 0.05 * avg(abs(y)) THEN 'Increasing' WHEN regr_slope(y, t) * (count(*) - 1) < -0.05 * avg(abs(y)) THEN 'Decreasing' ELSE 'Stable' END AS direction FROM x")
def ts5_trend(spark, d):
    return timeseries.trend(_hourly(spark, d)).select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n", "direction")


@query(f"{_HOURS}, l AS (SELECT regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM x), e AS (SELECT t, y - (i + s * t) AS e FROM x, l), k AS (SELECT 24 AS lag UNION ALL SELECT 168) SELECT CAST(lag AS INT) AS lag, round(corr(a.e, b.e), 6) AS correlation, corr(a.e, b.e) >= 0.5 AS detected FROM k, e a, e b WHERE b.t = a.t - lag GROUP BY 1 HAVING count(*) >= 2 * lag")
def ts6_season_correlations(spark, d):
    return timeseries.season_correlations(_hourly(spark, d), "hourly")


@query(f"{_HOURS}, l AS (SELECT regr_slope(y, t) AS s, regr_intercept(y, t) AS i FROM x), e AS (SELECT t, y - (i + s * t) AS e FROM x, l), m AS (SELECT quantile_cont(e, 0.5) AS m FROM e), a AS (SELECT quantile_cont(abs(e - m), 0.5) AS mad FROM e, m) SELECT t FROM e, m, a WHERE mad > 0 AND abs(e - m) > greatest(3.5 * 1.4826 * mad, 1e-9)")
def ts7_spikes(spark, d):
    return timeseries.spikes(_hourly(spark, d)).select("t")


@query(f"{_HOURS} SELECT t, year(period) AS y1, month(period) AS m1, quarter(period) AS q1, isodow(period) - 1 AS dow, weekofyear(period) AS w1, CASE WHEN isodow(period) >= 6 THEN 1 ELSE 0 END AS we, hour(period) AS h1 FROM x")
def ts9_calendar_features(spark, d):
    f = timeseries.calendar_features(_hourly(spark, d))
    return f.select("t", *[F.col(a).cast("long").alias(b) for a, b in (("year", "y1"), ("month", "m1"), ("quarter", "q1"), ("day_of_week", "dow"), ("week_of_year", "w1"))], F.col("is_weekend").alias("we"), F.col("hour").cast("long").alias("h1"))


@query()
def ts8_quality(spark, d):
    return timeseries.quality(_hourly(spark, d))


@query()
def ts14_backtest_ranking(spark, d):
    s = _hourly(spark, d)
    return timeseries.rank_models(timeseries.backtest(s, timeseries.plan_for(s, 24), 24))


@query()
def ts13_recursive_forecast(spark, d):
    daily = timeseries.densify(timeseries.period_sums(table(spark, d, "events"), "ts", "value", "daily", ["event_type"]), "daily", ["event_type"])
    return timeseries.forecast_linear(daily, ["event_type"], "daily", 7, ridge=10.0)


@query()
def ts16_intervals(spark, d):
    s = _hourly(spark, d)
    forecast = timeseries.naive(s, spark.range(1, 13).select(F.col("id").cast("int").alias("step")), 24)
    residuals = s.select("t", "y").join(s.select((F.col("t") + 24).alias("t"), F.col("y").alias("p")), "t").select((F.col("y") - F.col("p")).alias("residual"))
    return timeseries.intervals(forecast, residuals, 24)


# ---- cohorts, scores, metrics

_COHORT = """WITH tx AS (SELECT o_custkey AS customer, o_orderkey AS order_id, o_orderdate AS ts, l_partkey AS product, floor(l_extendedprice) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
k AS (SELECT unnest([TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01']) AS cutoff), o AS (SELECT cutoff, customer, order_id, min(ts) AS ts FROM tx, k WHERE ts < cutoff GROUP BY ALL),
l AS (SELECT cutoff, customer, min(ts) AS f, max(ts) AS x, count(*) AS n FROM o GROUP BY ALL), a AS (SELECT cutoff, customer, count(DISTINCT order_id) AS o90, round(sum(amount), 1) AS m90, count(DISTINCT product) AS p90 FROM tx, k WHERE ts < cutoff AND ts >= cutoff - INTERVAL 90 DAY GROUP BY ALL),
r AS (SELECT DISTINCT cutoff, customer FROM tx, k WHERE ts >= cutoff AND ts < cutoff + INTERVAL 60 DAY)
SELECT l.customer, l.cutoff, CAST(floor(epoch(l.cutoff - x) / 86400) AS BIGINT) AS recency_days, CAST(floor(epoch(l.cutoff - f) / 86400) AS BIGINT) AS tenure_days, coalesce(o90, 0) AS orders_90d, coalesce(m90, 0) AS monetary_90d, coalesce(p90, 0) AS products_90d,
CASE WHEN n > 1 THEN round_even(epoch(x - f) / 86400 / (n - 1), 4) ELSE 0 END AS avg_purchase_gap_days, CASE WHEN r.customer IS NULL THEN 0 ELSE 1 END AS returned_60d
FROM l LEFT JOIN a ON a.cutoff = l.cutoff AND a.customer = l.customer LEFT JOIN r ON r.cutoff = l.cutoff AND r.customer = l.customer"""


def _cohort(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    tx = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"), F.col("l_partkey").alias("product"), F.floor("l_extendedprice").cast("double").alias("amount"))
    return cohort.cohort(tx, ["1999-01-01", "2000-01-01"])


@query(_COHORT)
def ml20_cohort(spark, d):
    return _cohort(spark, d).drop("label_end_exclusive").withColumn("monetary_90d", F.round("monetary_90d", 1))


@query(
    "SELECT cutoff, count(*) AS n, round(avg(returned_60d), 6) AS share, "
    + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {c}_q{round(100 * q)}" for c in ("recency_days", "monetary_90d") for q in (0.1, 0.5, 0.9))
    + f" FROM ({_COHORT}) GROUP BY cutoff"
)
def agg27_drift(spark, d):
    found = cohort.drift(_cohort(spark, d).withColumn("monetary_90d", F.round("monetary_90d", 1)), ["recency_days", "monetary_90d"])
    return found.select("cutoff", "n", "share", *[F.round(F.col(c)[i], 4).alias(f"{c}_q{q}") for c in ("recency_days", "monetary_90d") for i, q in enumerate((10, 50, 90))])


_LOGIT = {"intercept": -0.4, "features": {"o_totalprice": {"coefficient": 0.8, "mean": 250000.0, "scale": 140000.0, "median": 240000.0}, "m": {"coefficient": -0.5, "mean": 6.0, "scale": 3.5, "median": 6.0}}}
_SCORED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-(-0.4 + 0.8 * (o_totalprice - 250000.0) / 140000.0 - 0.5 * (month(o_orderdate) - 6.0) / 3.5))) AS p FROM orders"


def _scored(spark, d):
    p, _ = scoring.logistic(_LOGIT, {"m": F.month("o_orderdate")})
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("y"), p.alias("p"))


@query(f"SELECT o_orderkey, round(p, 8) AS p, CASE WHEN p < 1.0 / 3 THEN 'LOW' WHEN p < 2.0 / 3 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM ({_SCORED})")
def ml10_logistic_score(spark, d):
    return _scored(spark, d).select("o_orderkey", F.round("p", 8).alias("p"), scoring.band(F.col("p"), 1 / 3, 2 / 3).alias("band"))


_TREE = {"left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "feature": [0, -1, 1, -1, -1], "threshold": [0.25, 0, -0.1, 0, 0], "value": [0.0, -0.6, 0.3, 0.1, 0.7]}
_BOOSTED = {"init": 0.1, "learning_rate": 0.5, "features": [{"log": True, "mean": 12.2, "scale": 0.8}, {"mean": 6.5, "scale": 3.4}], "trees": [_TREE, _TREE]}


@query(
    """SELECT o_orderkey, round(1 / (1 + exp(-(0.1 + v))), 8) AS p FROM (SELECT o_orderkey, CASE WHEN CAST((ln(1 + o_totalprice) - 12.2) / 0.8 AS FLOAT) <= CAST(0.25 AS FLOAT) THEN -0.6 WHEN CAST((month(o_orderdate) - 6.5) / 3.4 AS FLOAT) <= CAST(-0.1 AS FLOAT) THEN 0.1 ELSE 0.7 END AS v FROM orders)"""
)
def ml11_boosted_score(spark, d):
    p = scoring.boosted(_BOOSTED, [F.col("o_totalprice"), F.month("o_orderdate")])
    return table(spark, d, "orders").select("o_orderkey", F.round(p, 8).alias("p"))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM ({_SCORED}) GROUP BY 1")
def agg19_calibration_bins(spark, d):
    return metrics.calibration_bins(_scored(spark, d), "y", "p")


@query(f"WITH s AS ({_SCORED}), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum(pow(p - y, 2)) AS se, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS sl FROM s GROUP BY 1) SELECT round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(se) / sum(n), 6) AS brier, round(sum(sl) / sum(n), 6) AS log_loss FROM b")
def agg24_calibration(spark, d):
    return metrics.calibration(_scored(spark, d), "y", "p")


@query(f"SELECT y AS actual, CASE WHEN p >= 0.4 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM ({_SCORED}) GROUP BY ALL")
def agg20_confusion(spark, d):
    return metrics.confusion(_scored(spark, d).withColumn("q", (F.col("p") >= 0.4).cast("int")), "y", "q")


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.4) AS tp, count(*) FILTER (y = 0 AND p >= 0.4) AS fp, count(*) FILTER (y = 1 AND p < 0.4) AS fn, count(*) FILTER (y = 0 AND p < 0.4) AS tn FROM s),
m AS (SELECT *, tp / (tp + fp) AS p1, tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0, tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n FROM c), f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0 FROM m)
SELECT round((tp + tn) / n, 6) AS accuracy, round((p1 + p0) / 2, 6) AS macro_precision, round((p1 * s1 + p0 * s0) / n, 6) AS weighted_precision, round((r1 + r0) / 2, 6) AS macro_recall, round((r1 * s1 + r0 * s0) / n, 6) AS weighted_recall, round((f1 + f0) / 2, 6) AS macro_f1, round((f1 * s1 + f0 * s0) / n, 6) AS weighted_f1 FROM f"""
)
def agg20_classification_summary(spark, d):
    return metrics.classification_summary(metrics.confusion(_scored(spark, d).withColumn("q", (F.col("p") >= 0.4).cast("int")), "y", "q"))


@query(
    f"""WITH s AS (SELECT y, p FROM ({_SCORED})), g AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM s GROUP BY 1), c AS (SELECT p, sum(a) OVER o AS tp, sum(b) OVER o AS fp, sum(a) OVER () AS pn, sum(b) OVER () AS nn FROM g WINDOW o AS (ORDER BY p DESC)),
l AS (SELECT *, coalesce(lag(tp) OVER o, 0) AS t0, coalesce(lag(fp) OVER o, 0) AS f0, coalesce(lag(tp / (tp + fp)) OVER o, 1.0) AS q0 FROM c WINDOW o AS (ORDER BY p DESC))
SELECT round(sum((fp - f0) * (tp + t0) / 2) / (max(pn) * max(nn)), 6) AS roc_auc, round(sum((tp - t0) * (tp / (tp + fp) + q0) / 2) / max(pn), 6) AS pr_auc, round(sum((tp - t0) * tp / (tp + fp)) / max(pn), 6) AS average_precision FROM l"""
)
def agg21_ranking_scores(spark, d):
    return metrics.ranking_scores(_scored(spark, d), "y", "p")


#: The score of each class, in both dialects.
_ONE_VS_REST = {"view": "value", "signup": "-value", "error": "abs(value - 50)", "purchase": "value * value - 60 * value", "click": "CAST(event_id % 97 AS DOUBLE)"}
_PER_CLASS = (
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS class, {v} AS s, CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END AS y FROM events" for k, v in _ONE_VS_REST.items()) + """),
g AS (SELECT class, s, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY s DESC) AS tp, sum(q) OVER (PARTITION BY class ORDER BY s DESC) AS fp FROM g),
r AS (SELECT class, CAST(sum(p) AS BIGINT) AS n, sum(q * (2 * tp - p) / 2) / (sum(p) * sum(q)) AS roc_auc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM c GROUP BY class)"""
)


def _classes(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("y"), *[F.expr(v).alias(f"s_{k}") for k, v in _ONE_VS_REST.items()])


@query(f"{_PER_CLASS} SELECT class, n, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM r")
def agg21_one_vs_rest(spark, d):
    return metrics.one_vs_rest(_classes(spark, d), "y", {k: f"s_{k}" for k in _ONE_VS_REST}).drop("pr_auc")


@query(f"{_PER_CLASS} SELECT round(avg(roc_auc), 6) AS roc_auc_ovr, count(*) AS classes FROM r")
def agg21_macro_auc(spark, d):
    return metrics.macro_ranking_scores(_classes(spark, d), "y", {k: f"s_{k}" for k in _ONE_VS_REST})


@query("SELECT l_returnflag, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) AS r2, round(100 * avg(abs(e / a)), 6) AS mape, round(100 * avg(2 * abs(e) / (abs(a) + abs(p))), 6) AS smape FROM (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1450 AS p, l_extendedprice - l_quantity * 1450 AS e FROM lineitem) GROUP BY 1")
def agg22_regression_scores(spark, d):
    return metrics.regression_scores(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1450), "l_extendedprice", "p", ["l_returnflag"])


@query(
    f"""WITH s AS ({_SCORED}), g AS (SELECT k, CAST(round(0.1 + k * 0.01, 4) AS DOUBLE) AS threshold FROM range(81) t(k)), c AS (SELECT threshold, count(*) FILTER (y = 1 AND floor((p - 0.1) / 0.01 + 1e-9) >= k) AS tp, count(*) FILTER (y = 0 AND floor((p - 0.1) / 0.01 + 1e-9) >= k) AS fp, count(*) FILTER (y = 1 AND floor((p - 0.1) / 0.01 + 1e-9) < k) AS fn, count(*) FILTER (y = 0 AND floor((p - 0.1) / 0.01 + 1e-9) < k) AS tn FROM s, g GROUP BY 1)
SELECT threshold, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 6) AS macro_f1 FROM c"""
)
def ml18_threshold_grid(spark, d):
    return metrics.threshold_grid(_scored(spark, d), "y", "p")


@query(f"SELECT count(*) AS total, count(p) AS eligible, count(*) - count(p) AS insufficient, count(*) FILTER (p >= 0.5) AS returning, count(*) FILTER (p < 0.5) AS not_returning, round(count(*) FILTER (p >= 0.5) / count(p), 6) AS return_ratio, round(avg(p), 6) AS average_probability, count(*) FILTER (p >= 2.0 / 3) AS band_high, count(*) FILTER (p >= 1.0 / 3 AND p < 2.0 / 3) AS band_medium, count(*) FILTER (p < 1.0 / 3) AS band_low FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN p END AS p FROM ({_SCORED}))")
def agg26_score_summary(spark, d):
    return scoring.score_summary(_scored(spark, d).withColumn("p", F.when(F.col("o_orderkey") % 10 != 0, F.col("p"))), "p")


@query()
def agg33_bootstrap(spark, d):
    rows = _scored(spark, d).withColumn("base", F.lit(0.5))
    return metrics.bootstrap_difference(rows, "y", "p", "base", "o_orderkey", resamples=200)


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN recency_days > tenure_days THEN 'recency_exceeds_tenure' WHEN recency_days > 90 AND orders_90d > 0 THEN 'active_without_recent_order' WHEN recency_days <= 90 AND orders_90d = 0 THEN 'recent_without_order' WHEN (orders_90d = 0) <> (monetary_90d = 0) OR (orders_90d = 0) <> (products_90d = 0) THEN 'zeros_disagree' END AS reason FROM ("""
    + _COHORT
    + ")) GROUP BY 1"
)
def ml13_input_rules(spark, d):
    return _cohort(spark, d).select(scoring.input_reason().alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT o_orderdate AS t FROM orders), u AS (SELECT t, sum(count(*)) OVER (ORDER BY t) AS upto, row_number() OVER (ORDER BY t) AS place FROM o GROUP BY t),
cut AS (SELECT max(place) AS groups, max(place) // 6 AS size FROM u WHERE upto <= (SELECT count(*) * 3 // 4 FROM o)),
parts AS (SELECT 'fold ' || i AS part, groups - (5 - i) * size AS a, groups - (4 - i) * size AS b FROM cut, range(5) x(i) UNION ALL SELECT 'holdout', groups, NULL FROM cut)
SELECT part, count(*) FILTER (place <= a) AS n_train, count(*) FILTER (place > a AND (b IS NULL OR place <= b)) AS n_rows, min(t) FILTER (place > a) AS begins, max(t) FILTER (b IS NULL OR place <= b) AS ends
FROM o JOIN u USING (t), parts GROUP BY part"""
)
def ml1_temporal_plan(spark, d):
    """What each fold and the holdout of an evaluation in time order learn from and judge."""
    o = table(spark, d, "orders")
    return compare.temporal_parts(o, "o_orderdate", compare.temporal_plan(o, "o_orderdate", "o_orderstatus"))


@query()
def ml5_model_comparison(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("target"), F.month("o_orderdate").alias("m"), (F.col("o_totalprice") + F.pmod(F.xxhash64("o_orderkey", F.lit(3)), F.lit(200000))).alias("noisy"), "o_orderpriority")
    found = compare.compare_models(rows, "target", ["m", "noisy"], ["o_orderpriority"], "o_orderkey", names=["Logistic Regression", "Decision Tree"])
    return spark.createDataFrame([(r["model"], r["rank"], float(r["cv_score"]), float(r["test_score"]), r["overfit"]) for r in found], "model string, rank int, cv_score double, test_score double, overfit string")


@query(
    """WITH q AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) * 20 AS a, p_retailprice AS b, p_type AS l FROM part), d AS (
  SELECT x.k, t.l, row_number() OVER (PARTITION BY x.k ORDER BY (x.a - t.a) * (x.a - t.a) + (x.b - t.b) * (x.b - t.b), t.k) AS r FROM q x, q t),
v AS (SELECT k, l, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL)
SELECT k AS p_partkey, arg_min(l, struct_pack(n := -n, l := l)) AS label FROM v GROUP BY k"""
)
def ml5_nearest_neighbours(spark, d):
    """The commonest type of the five parts nearest in size and price, of every part."""
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("double") * 20).alias("a"), F.col("p_retailprice").alias("b"), "p_type")
    return compare.nearest_neighbours(parts, parts, "p_partkey", ["a", "b"], "p_type")


@query()
def ml5_kernel_machine(spark, d):
    """A kernel machine fitted to a band of balances, which no line can tell apart: its confusion counts on the customers."""
    rows = table(spark, d, "customer").select("c_custkey", (F.abs(F.col("c_acctbal") - 4500) < 2700).cast("int").alias("target"), "c_acctbal", "c_nationkey")
    prep = compare.fit_preprocessor(rows, ["c_acctbal", "c_nationkey"], [])
    encoded = compare.transform(rows, prep, "target")
    return metrics.confusion(kernels.KernelMachine("classification").fit(encoded).transform(encoded), "label", "prediction")


# ---- texts

_FOLDED = "replace(strip_accents(lower(coalesce({c}, ''))), 'đ', 'd')"
_LISTING_SQL = """(SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Bán nhà mặt tiền' WHEN 1 THEN 'Cho thuê căn hộ' WHEN 2 THEN 'Cần mua đất' WHEN 3 THEN 'Bán nhà đang cho thuê' WHEN 4 THEN 'Bán hoặc cho thuê' WHEN 5 THEN 'Nhà đẹp 15 triệu/tháng' ELSE 'Nhà phố' END AS title, CASE o_orderkey % 3 WHEN 0 THEN 'Cho thuê gấp' WHEN 1 THEN 'Chính chủ bán nhà' ELSE 'Liên hệ' END AS description FROM orders)"""


def _listings(spark, d):
    k = F.col("o_orderkey")
    titles = ["Bán nhà mặt tiền", "Cho thuê căn hộ", "Cần mua đất", "Bán nhà đang cho thuê", "Bán hoặc cho thuê", "Nhà đẹp 15 triệu/tháng", "Nhà phố"]
    heads = ["Cho thuê gấp", "Chính chủ bán nhà", "Liên hệ"]
    pick = lambda words, n: F.array(*map(F.lit, words))[F.pmod(k, F.lit(n)).cast("int")]
    return table(spark, d, "orders").select(k.alias("id"), pick(titles, 7).alias("title"), pick(heads, 3).alias("description"))


def _intent_sql() -> str:
    m = lambda c, p: f"regexp_matches({c}, '{p}')"
    r = textrules
    flags = f"SELECT id, {m('t', r.SALE)} AS sale, ({m('t', r.RENT)} OR {m('t', r.MONTHLY)}) AND NOT {m('t', r.CASHFLOW)} AS rent, {m('t', r.CASHFLOW)} AS cash, {m('t', r.WANTED)} AS wanted, {m('t', r.DUAL)} OR {m('x', r.DUAL)} AS dual, {m('x', r.RENT_OPEN)} AS dr, {m('x', r.SALE_OPEN)} AS ds FROM (SELECT id, {_FOLDED.format(c='title')} AS t, {_FOLDED.format(c='left(description, 240)')} AS x FROM {_LISTING_SQL})"
    reason = "CASE WHEN wanted THEN 'wanted_or_negated_offer' WHEN dual THEN 'dual_sale_rent_offer' WHEN sale AND (rent OR dr) THEN 'sale_title_conflicts_with_rent_offer' WHEN rent AND ds THEN 'rent_title_conflicts_with_sale_opening' WHEN sale AND cash THEN 'explicit_sale_title_with_rental_cashflow_context' WHEN sale THEN 'explicit_sale_title_no_opposing_primary_offer' WHEN rent THEN 'explicit_rent_or_monthly_title_no_sale_opening' ELSE 'insufficient_primary_intent_in_title' END"
    return f"WITH f AS ({flags}), g AS (SELECT id, {reason} AS rule_reason FROM f) SELECT CASE WHEN rule_reason LIKE 'explicit_sale%' THEN 'SALE_HIGH_CONFIDENCE' WHEN rule_reason LIKE 'explicit_rent%' THEN 'RENT_HIGH_CONFIDENCE' ELSE 'AMBIGUOUS' END AS rule_label, rule_reason, count(*) AS n FROM g GROUP BY ALL"


@query(_intent_sql())
def txt1_intent(spark, d):
    return textrules.intent(_listings(spark, d), "title", "description").groupBy("rule_label", "rule_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') || '|' || lang) AS near_keys, count(DISTINCT text || '|' || lang || '|' || source) AS exact_keys FROM documents")
def txt12_near_keys(spark, d):
    rows = table(spark, d, "documents")
    return rows.select(textrules.near_key(["text"], ["lang"]).alias("a"), textrules.row_key(rows, ["text", "lang", "source"]).alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("a").alias("near_keys"), F.count_distinct("b").alias("exact_keys"))


#: The titles state one price, of one decimal place, in billions; half of the descriptions add a rate per m2, and a deposit that is no price.
_PRICED = "SELECT o_orderkey AS id, CAST(round(o_totalprice / 1e5, 1) AS DOUBLE) * 1e9 AS titled, o_orderkey % 2 = 0 AS rated, 85e6::DOUBLE * (o_orderkey % 90 + 30) AS by_rate FROM orders"


@query(f"SELECT id, CAST(titled > 0 AS INT) + CAST(rated AS INT) AS n_prices, CASE WHEN titled > 0 THEN titled WHEN rated THEN by_rate END AS reference, CASE WHEN titled > 0 THEN 'title' WHEN rated THEN 'description' ELSE 'no_supported_price' END AS reason FROM ({_PRICED})")
def txt4_price_mentions(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("Bán nhà giá "), F.round(F.col("o_totalprice") / 1e5, 1).cast("string"), F.lit(" tỷ")).alias("title"), F.when(k % 2 == 0, "đặt cọc 200 triệu; 85 triệu/m2").alias("description"), (k % 90 + 30).cast("double").alias("area"))
    found = textrules.extract_prices(rows, "title", "description", "area")
    return found.select("id", F.size("prices").alias("n_prices"), textrules.reference_price(F.col("prices"))["value"].alias("reference"), textrules.reference_price(F.col("prices"))["reason"].alias("reason"))


@query("SELECT lang, kind, count(*) AS n FROM (SELECT lang, CASE WHEN contains(t, 'thoa thuan') THEN 'negotiable' WHEN regexp_matches(t, '/\\s*m\\s*(2|²)') THEN 'per_m2' WHEN regexp_matches(t, '\\d\\s*ty\\b') THEN 'billion' WHEN regexp_matches(t, '\\d\\s*(trieu|tr)\\b') THEN 'million' ELSE 'other' END AS kind FROM (SELECT lang, " + _FOLDED.format(c="text") + " AS t FROM documents)) GROUP BY ALL")
def txt17_price_text_class(spark, d):
    rows = table(spark, d, "documents").select("lang", textrules.price_text_class(F.col("text")).alias("kind"))
    return rows.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_custkey, CASE WHEN n >= 12 THEN concat_ws('|', c_nationkey, c_mktsegment) ELSE '__province__' || c_nationkey END AS region FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)"
)
def ml21_region_key(spark, d):
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return market.region_key(c, "c_nationkey", "c_mktsegment", 12).select("c_custkey", "region")


@query()
def agg10_jn8_regional_quantiles(spark, d):
    values = table(spark, d, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value"))
    return market.regional_quantiles(values, _centers(spark, d), "region", "kind", "value", most_km=2500.0, least_n=3)


@query("SELECT n_nationkey, CAST(round(6 * (1 + n_nationkey % 3), 6) AS DOUBLE) AS area FROM nation")
def geo_ring_area(spark, d):
    k = (1 + F.col("n_nationkey") % 3).cast("double")
    point = lambda x, y: F.array(x, y)
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(k * 3, F.lit(0.0)), point(k * 3, F.lit(2.0)), point(F.lit(0.0), F.lit(2.0)), point(F.lit(0.0), F.lit(0.0)))
    return table(spark, d, "nation").filter(geo.valid_ring(ring)).select("n_nationkey", F.round(geo.signed_area(ring), 6).alias("area"))


# ---- more parsers, filters and scores


@query("SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders")
def cln8_symbol_number(spark, d):
    s = F.concat(F.lit(" $ "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" %"))
    return table(spark, d, "orders").select("o_orderkey", F.round(parse.symbol_number(s), 2).alias("v"))


@query("SELECT o_orderkey, c / 100.0::DOUBLE AS as_comma, CASE WHEN o_orderkey % 2 = 0 THEN c / 100.0::DOUBLE END AS as_dot FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)")
def cln14_convention_number(spark, d):
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    part = lambda sep: F.concat(F.floor(c / 100).cast("string"), F.lit(sep), F.lpad((c % 100).cast("string"), 2, "0"))
    mixed = F.when(F.col("o_orderkey") % 2 == 0, part(".")).otherwise(part(","))
    return table(spark, d, "orders").select("o_orderkey", parse.convention_number(part(","), "decimal_comma").alias("as_comma"), parse.convention_number(mixed, "decimal_dot").alias("as_dot"))


@query("SELECT o_orderkey, CAST(c AS DOUBLE) * 1e7 AS money, CAST(o_orderkey % 900 + 10 AS DOUBLE) AS area FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS c FROM orders)")
def cln16_vn_money(spark, d):
    c = F.floor(F.col("o_totalprice") / 1000)
    s = F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"), F.lit(" tỷ"))
    area = F.concat((F.col("o_orderkey") % 900 + 10).cast("string"), F.lit(" m²"))
    return table(spark, d, "orders").select("o_orderkey", F.round(parse.vn_money(s), 0).alias("money"), parse.vn_area(area).alias("area"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax / 1.27, 8) AS amount FROM lineitem")
def cln26_line_amount(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.line_amount(F.col("l_quantity"), F.col("l_tax"), 1.27), 8).alias("amount"))


@query("SELECT count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS before, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY) AS recent FROM orders")
def flt9_snapshot(spark, d):
    at = F.lit("2000-01-01").cast("timestamp")
    return table(spark, d, "orders").agg(F.count_if(filters.between_snapshot(F.col("o_orderdate"), at)).alias("before"), F.count_if(filters.between_snapshot(F.col("o_orderdate"), at, 90)).alias("recent"))


def _feed(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.when(k % 50 != 0, k.cast("string")).alias("listing_id"), F.when(k % 11 == 0, "RENT").otherwise("SALE").alias("transaction_type"), F.when(k % 13 == 0, "USD").otherwise("VND").alias("currency"), F.lit("m2").alias("area_unit"),
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("total_price_vnd"), (k % 7).cast("double").alias("area_m2"), F.col("o_orderstatus").alias("province"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("area_name"), F.lit("house").alias("property_type"), F.col("o_orderdate").alias("date"),
    )


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'missing_id' WHEN o_orderkey % 11 = 0 THEN 'transaction_type' WHEN o_orderkey % 13 = 0 THEN 'currency' WHEN o_orderkey % 17 = 0 THEN 'price' WHEN o_orderkey % 7 = 0 THEN 'area' WHEN o_orderdate > TIMESTAMP '2000-06-01' THEN 'date' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def flt6_feed_validator(spark, d):
    return filters.funnel_counts(_feed(spark, d), feed.feed_reasons("2000-06-01"))


@query("SELECT province, area_name, '' AS property_type, count(*) AS n, round(quantile_cont(p, 0.5), 4) AS median FROM (SELECT o_orderstatus AS province, o_orderpriority AS area_name, o_totalprice / (o_orderkey % 7) AS p, o_orderkey % 4 = 0 AS blank FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate <= TIMESTAMP '2000-06-01') WHERE NOT blank GROUP BY ALL HAVING count(*) >= 5")
def agg7_market_feed_stats(spark, d):
    stats = feed.market_stats(feed.valid_records(_feed(spark, d), now="2000-06-01"))
    return stats.filter("area_name <> '' AND property_type = ''").select("province", "area_name", "property_type", "n", F.round("median", 4).alias("median"))


@query("(SELECT 'price' AS metric, l_extendedprice AS value, l_orderkey, l_linenumber FROM lineitem ORDER BY 2, 3, 4 LIMIT 5)")
def ord3_smallest(spark, d):
    return ordering.extremes(table(spark, d, "lineitem"), {"price": F.col("l_extendedprice")}, ["l_orderkey", "l_linenumber"], largest=False)


@query("SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY avg(c_acctbal) DESC, c_mktsegment) AS INT) AS rank FROM customer GROUP BY 1")
def win7_rank_rows(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return windows.rank_rows(g, F.desc("v"), F.col("c_mktsegment")).select("c_mktsegment", "rank")


@query("SELECT o_orderstatus, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def agg34_first_last(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"), F.max("o_orderdate").alias("latest"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st1_windowed_counts(spark, d):
    out = feed.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"{_HOURS}, m AS (SELECT max(t) AS m FROM x) SELECT CAST(s AS INT) AS step, round(x.y, 4) AS prediction FROM range(1, 31) k(s), m, x WHERE x.t = m - (23 - (s - 1) % 24)")
def ts11_seasonal_naive(spark, d):
    future = spark.range(1, 31).select(F.col("id").cast("int").alias("step"))
    return timeseries.naive(_hourly(spark, d), future, 24).withColumn("prediction", F.round("prediction", 4))


@query("SELECT CAST(s AS INT) AS step, m + to_months(CAST(s AS INT)) AS period FROM range(1, 13) t(s), (SELECT CAST(max(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS m FROM orders)")
def ts17_future_calendar(spark, d):
    """The twelve months behind the last one with an order."""
    last = timeseries.period_sums(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "monthly").agg(F.max("period")).first()[0]
    return timeseries.future_calendar(spark, last, "monthly", 12)


@query("SELECT 'hourly' AS frequency, count(*) AS n FROM (SELECT DISTINCT date_trunc('hour', ts) FROM events)")
def ts1_infer_frequency(spark, d):
    hours = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("h")).distinct()
    return hours.agg(F.count(F.lit(1)).alias("n")).select(F.lit(timeseries.infer_frequency(hours, "h")["frequency"]).alias("frequency"), "n")


@query(f"SELECT o_orderkey, round(p * 1000) / 10 AS yes, (1000 - round(p * 1000)) / 10 AS no FROM (SELECT o_orderkey, round(p, 6) AS p FROM ({_SCORED}))")
def ml16_complement_percent(spark, d):
    yes, no = numeric.complement_percent(F.round("p", 6))
    return _scored(spark, d).select("o_orderkey", yes.alias("yes"), no.alias("no"))


@query(
    """SELECT o_orderkey, CAST(CASE WHEN low THEN -0.6 ELSE 0.3 END AS DOUBLE) AS c_price, CAST(CASE WHEN low THEN 0.0 WHEN early THEN -0.2 ELSE 0.4 END AS DOUBLE) AS c_month FROM (SELECT o_orderkey, CAST(o_totalprice / 1e6 AS FLOAT) <= CAST(0.25 AS FLOAT) AS low, CAST(month(o_orderdate) / 10.0 - 0.7 AS FLOAT) <= CAST(-0.1 AS FLOAT) AS early FROM orders)"""
)
def ml12_tree_contributions(spark, d):
    c = scoring.tree_contributions(_TREE, [F.col("o_totalprice") / 1e6, F.month("o_orderdate") / 10.0 - 0.7], ["price", "month"])
    return table(spark, d, "orders").select("o_orderkey", *[F.round(v, 8).cast("double").alias(f"c_{k}") for k, v in c.items()])


@query("SELECT p_partkey, round(p_size * 900.5::DOUBLE, 4) AS low, round(p_size * 1000.25::DOUBLE, 4) AS value, round(p_size * 1100.75::DOUBLE, 4) AS high FROM part")
def ml23_market_estimate(spark, d):
    e = market.estimate(F.col("p_size"), F.lit(900.5), F.lit(1000.25), F.lit(1100.75))
    return table(spark, d, "part").select("p_partkey", *[F.round(v, 4).alias(k) for k, v in e.items()])


@query()
def ml22_shapley(spark, d):
    parts = {"price": F.col("o_totalprice") / 1e6, "month": F.month("o_orderdate") / 12.0, "open": (F.col("o_orderstatus") == "O").cast("double")}
    values = scoring.shapley(list(parts), lambda s: numeric.sigmoid(sum((parts[k] for k in sorted(s)), F.lit(-1.0))))
    return table(spark, d, "orders").select("o_orderkey", *[F.round(v, 8).alias(k) for k, v in values.items()])


@query()
def ml17_calibrators(spark, d):
    rows = _scored(spark, d)
    slope, intercept = scoring.calibrate_sigmoid(rows.withColumn("m", F.log(F.col("p") / (1 - F.col("p")))), "m", "y")
    beta = scoring.calibrate_beta(rows, "p", "y")
    return spark.createDataFrame([("sigmoid", slope, intercept), ("beta", beta["a"], beta["c"])], "kind string, slope double, intercept double")


@query(
    f"""SELECT count(*) AS n, count(*) FILTER (regexp_matches(t, '\\b(ban|chuyen nhuong)\\b') AND NOT regexp_matches(t, '\\b(cho thue|tim nguoi thue|can thue|tim thue|gia thue)\\b')
  AND NOT regexp_matches(t, '\\b(khong ban|chua ban|can mua|tim mua|ban va cho thue|ban hoac cho thue)\\b')) AS strict FROM (SELECT {_FOLDED.format(c="title")} AS t FROM {_LISTING_SQL})"""
)
def txt3_strict_sale(spark, d):
    return _listings(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(saletext.strict_sale(F.col("title"))).alias("strict"))


@query(
    f"""WITH x AS (SELECT {_FOLDED.format(c="title")} AS t, left({_FOLDED.format(c="description")}, 300) AS d FROM {_LISTING_SQL}), f AS (SELECT t, d,
  regexp_matches(t, '\\b(can ban|chinh chu ban|ban gap|ban nhanh|gia ban|chuyen nhuong|rao ban|ban (nha|can ho|chung cu|dat|biet thu|lo|nen|shophouse|khach san|toa nha|mat tien|kho|xuong|trang trai|van phong))\\b') AS sale,
  regexp_matches(t, '\\b(dang cho thue|hien (dang )?cho thue|hop dong (cho )?thue|dong tien|thu nhap|doanh thu|khai thac cho thue)\\b') AS cash,
  regexp_matches(t, '\\b(cho thue|gia thue|can cho thue)\\b') OR regexp_matches(t, '(/\\s*thang\\b|\\b(trieu|tr|trd)\\s*/\\s*thang\\b)') AS rents,
  regexp_matches(t, '\\b(can mua|tim mua|can thue|tim thue|khong ban|chua ban)\\b') AS wanted,
  regexp_matches(t || chr(1) || d, '\\b(ban\\s*(hoac|va|hay|/)\\s*(cho )?thue|vua ban vua cho thue|cho thue (hoac|va) ban)\\b') AS dual,
  regexp_matches(t, '^\\W*((chinh chu |can |gap )*cho thue\\b|(villa )?for\\s*rent\\b)') AS t_opens, regexp_matches(d, '^\\W*((chinh chu |can |gap )*cho thue\\b|(villa )?for\\s*rent\\b)') AS d_opens,
  regexp_matches(d, '^\\W*(chinh chu |can |gap )?(ban\\b|chuyen nhuong\\b)') AS d_sells FROM x), r AS (SELECT *, rents AND NOT cash AS rent FROM f)
SELECT CASE WHEN wanted THEN 'wanted_or_negated_title' WHEN dual THEN 'dual_offer' WHEN sale AND (rent OR d_opens) THEN 'sale_title_rental_offer_conflict' WHEN rent AND d_sells THEN 'rent_title_sale_opening_conflict'
  WHEN sale AND cash THEN 'explicit_sale_with_cashflow' WHEN sale THEN 'explicit_sale_title' WHEN rent AND (t_opens OR d_opens) THEN 'explicit_rental_title' WHEN rent THEN 'rental_context_without_primary_rental_offer'
  ELSE 'insufficient_primary_title_intent' END AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def txt2_later_intent(spark, d):
    return _listings(spark, d).select(saletext.intent(F.col("title"), F.col("description"))["reason"].alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def txt8_target_basis(spark, d):
    """What the stored price of each order's listing is, by the prices that its texts state."""
    k, price = F.col("o_orderkey"), F.round(F.col("o_totalprice") / 100).cast("long").cast("string")
    title = F.when(k % 3 == 0, F.concat(F.lit("Bán nhà giá "), price, F.lit(" triệu"))).when(k % 3 == 1, F.concat(F.lit("Bán đất "), price, F.lit(" triệu/m²"))).otherwise("Bán đất")
    body = F.when(k % 5 == 0, F.concat(F.lit("giá "), price, F.lit(" triệu/sào"))).when(k % 5 == 1, F.concat(F.lit("Giá bán: "), price, F.lit(" tr, khoảng 9 tỷ 500"))).otherwise(F.concat(F.lit("Giá "), price, F.lit(" triệu")))
    rows = table(spark, d, "orders").select("o_orderkey", title.alias("t"), body.alias("d"), F.round(F.col("o_totalprice") / 100).alias("p"))
    prices = saletext.listing_prices(F.col("t"), F.col("d"), F.lit(40.0))
    return rows.select("o_orderkey", saletext.target_basis(F.col("p"), prices).alias("b")).select("o_orderkey", "b.*")


_TITLES = (
    "Bán nhà mặt phố Huế", "BÁN  NHÀ MẶT TIỀN, trong ngõ", "Chuyển nhượng nhà riêng", "Bán gấp lô đất nền", "Cần bán biệt thự liền kề", "Bán shophouses ven sông", "Không bán nhà riêng",
    "Bán/cho thuê nhà mặt đường", "Bán và thuê biệt thự", "Cho thuê nhà riêng", "Nhà riêng giá tốt", "Bán khách sạn, đất vàng", "Bánh mì lô 5", "Bán căn hẻm 12", "Bán đấtnền",
)
_SOURCES = ("Nhà", "Biệt thự/Nhà liền kề", "Đất", "Shophouse", "Căn hộ")


def _type_sql() -> str:
    edge = lambda words: f"(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])"  # noqa: E731 - SQL's \\b knows ASCII letters only
    says = lambda words: f"regexp_matches(t, '{edge(words)}')"
    street, private = says("nhà (?:mặt phố|mặt tiền|mặt đường)"), says("nhà riêng|hẻm|ngõ")
    kind = (
        f"CASE source WHEN 'Nhà' THEN CASE WHEN {street} AND {private} THEN NULL WHEN {street} THEN 'STREET_HOUSE' WHEN {private} THEN 'HOUSE' END"
        f" WHEN 'Biệt thự/Nhà liền kề' THEN CASE WHEN {says('biệt thự|liền kề')} THEN 'VILLA' END WHEN 'Đất' THEN CASE WHEN {says('đất|lô|nền')} THEN 'LAND' END"
        " WHEN 'Shophouse' THEN CASE WHEN contains(t, 'shophouse') THEN 'SHOPHOUSE' END END"
    )
    offered = f"{says('bán|chuyển nhượng')} AND NOT {says('cho thuê|cần thuê|tìm thuê|cần mua|tìm mua|không bán|chưa bán')} AND NOT {says('bán (?:hoặc|và|hay) thuê|bán/cho thuê|nhà xưởng|khách sạn|nhà máy')}"
    pick = f"list_value({', '.join(repr(x) for x in _TITLES)})[o_orderkey % {len(_TITLES)} + 1] AS title, list_value({', '.join(repr(x) for x in _SOURCES)})[o_custkey % {len(_SOURCES)} + 1] AS source"
    return f"SELECT title, source, CASE WHEN {offered} THEN {kind} END AS kind, count(*) AS n FROM (SELECT *, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS t FROM (SELECT {pick} FROM orders)) GROUP BY ALL"


@query(_type_sql())
def txt10_property_type(spark, d):
    pick = lambda words, key: F.array(*map(F.lit, words))[F.pmod(F.col(key), F.lit(len(words))).cast("int")]
    rows = table(spark, d, "orders").select(pick(_TITLES, "o_orderkey").alias("title"), pick(_SOURCES, "o_custkey").alias("source"))
    return rows.withColumn("kind", textrules.property_type(F.col("title"), F.col("source"))).groupBy("title", "source", "kind").agg(F.count(F.lit(1)).alias("n"))


_PHRASES = "CASE o_orderkey % 6 WHEN 0 THEN 'hôm nay' WHEN 1 THEN NULL WHEN 2 THEN CAST(o_orderkey % 9 AS {text}) || ' ngày trước' WHEN 3 THEN CAST(o_orderkey % 40 AS {text}) || ' phút trước' WHEN 4 THEN CAST(o_orderkey % 3 AS {text}) || ' năm trước' ELSE 'đăng 2 ngày trước' END"
_APART = "CASE o_orderkey % 6 WHEN 2 THEN o_orderkey % 9 * 86400 WHEN 3 THEN o_orderkey % 40 * 60 ELSE o_orderkey % 3 * 31536000 END + o_custkey % 91"


def _phrased(spark, d):
    rows = table(spark, d, "orders").withColumn("phrase", F.expr(_PHRASES.format(text="STRING"))).withColumn("apart", F.expr(_APART))
    return rows.withColumn("stated", F.timestamp_seconds(F.unix_timestamp("o_orderdate") - F.col("apart")))


@query(
    f"WITH p AS (SELECT {_PHRASES.format(text='VARCHAR')} AS phrase, o_custkey % 91 AS err FROM orders), s AS (SELECT *, regexp_matches(phrase, '^\\d+ (ngày|phút|năm) trước$') AS ok FROM p)"
    " SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_supported, count(*) FILTER (ok AND err <= 60) AS n_matching, quantile_cont(err::DOUBLE, 0.5) FILTER (ok) AS median_seconds FROM s"
)
def cln28_relative_times(spark, d):
    return profiling.relative_time_check(_phrased(spark, d), "phrase", "o_orderdate", "stated")


@query(f"SELECT phrase, count(*) AS n FROM (SELECT {_PHRASES.format(text='VARCHAR')} AS phrase FROM orders) WHERE phrase IN ('hôm nay', 'đăng 2 ngày trước') GROUP BY 1")
def cln28_unsupported_phrases(spark, d):
    return profiling.unsupported_phrases(_phrased(spark, d), "phrase")


@query("SELECT 'x' AS fold_check, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def set2_distinct(spark, d):
    return sets.distinct(table(spark, d, "events"), "user_id", "event_type").agg(F.lit("x").alias("fold_check"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS v FROM orders")
def snk5_finite_or_null(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("o_totalprice", 2)).alias("v"))
    return sinks.finite_or_null(rows)


@query()
def smp12_envelope(spark, d):
    return sampling.envelope(_hourly(spark, d), "t", "y", 100)


@query()
def smp8_group_split(spark, d):
    return sampling.group_split(table(spark, d, "orders"), ["o_custkey"]).select("o_orderkey", "is_test")


# ---- product flows


@query("SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def p1_analyze_table(spark, d):
    e = table(spark, d, "events").select(F.col("event_type"), F.col("event_id").cast("string").alias("id"), F.col("value").cast("string").alias("value"))
    return products.analyze_table(e)["table"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def p3_forecast_sales(spark, d):
    return products.forecast_sales(_hourly(spark, d), "hourly", 24, floor_at_zero=True)["forecast"]


@query("WITH t AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS ts FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') SELECT CAST(c AS VARCHAR) AS customer, CAST(floor(epoch(TIMESTAMP '2000-01-01' - max(ts)) / 86400) AS BIGINT) AS recency_days, count(DISTINCT k) FILTER (ts >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY) AS orders_90d FROM t GROUP BY c")
def p4_customer_features(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("string").alias("order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("1").alias("quantity"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"), F.lit("VN").alias("country"), F.col("o_orderpriority").alias("product"))
    tx, _ = products.prepare_transactions(raw)
    return products.customer_features(tx, F.lit("2000-01-01")).select("customer", "recency_days", "orders_90d")


@query(f"SELECT o_orderkey, round(1 / (1 + exp(-(-0.4 + 0.8 * (coalesce(x, 240000.0) - 250000.0) / 140000.0))), 8) AS risk FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS x FROM orders)")
def p6_health_risk(spark, d):
    model = {"intercept": -0.4, "features": {"x": _LOGIT["features"]["o_totalprice"]}}
    raw = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "?").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("x"))
    return products.health_risk(raw, model).select("o_orderkey", F.round("risk", 8).alias("risk"))


_CUSTOMER_MODEL = {
    "init": -0.2,
    "learning_rate": 0.4,
    "features": [{"log": True, "mean": 3.4, "scale": 1.1}, {"log": True, "mean": 5.0, "scale": 0.9}, {"mean": 1.5, "scale": 1.5}],
    "trees": [{**_TREE, "feature": [0, -1, 2, -1, -1]}, {**_TREE, "feature": [1, -1, 0, -1, -1]}],
}


@query()
def p4_batch_scoring(spark, d):
    """Every line of every order as a raw transaction: read, clean, aggregate, score, summarise."""
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,2)").cast("string")
    raw = lines.select(
        F.concat(F.lit("C"), "o_custkey").alias("customer"), F.concat(F.lit("O"), "o_orderkey").alias("order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"), price.alias("value"), F.lit("VN").alias("country"), F.concat(F.lit("P"), "l_partkey").alias("product"),
    )
    tx, _ = products.prepare_transactions(raw)
    features = products.customer_features(written(tx, "transactions"), F.lit("2000-01-01"))
    p = scoring.boosted(_CUSTOMER_MODEL, [F.col("recency_days"), F.col("tenure_days"), F.col("orders_90d")])
    return products.score_customers(features, p)[1]


@query()
def prf15_treemap(spark, d):
    """Customers of each region by nation, as tiles."""
    nations = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return profiling.treemap(nations, "n_name", "n", 300.0, 200.0, ["n_regionkey"]).select("n_regionkey", "n_name", *[F.round(c, 6).alias(c) for c in "xywh"])


from millrace.plans import forecast_queries  # noqa: E402, F401  (registers its queries here)
