"""Queries over the relational tables: selection, sorting, sets, aggregates, relabelling, dates and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, strings
from ..operators import order, prepare, sets
from .registry import Registry

REGISTRY = query = Registry()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 20")
def kleast_global(read, spark):
    return order.k_least(read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, ["l_extendedprice", "l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def kgreatest_global(read, spark):
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def kgreatest_per_group(read, spark):
    return order.k_per_group(read("orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), 5, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS position FROM part")
def argsort_positions(read, spark):
    return order.positions(read("part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def reverse_order(read, spark):
    return read("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")).limit(50)


@query("SELECT bool_and(ok) AS sorted FROM (SELECT coalesce(o_totalprice >= lag(o_totalprice) OVER (ORDER BY o_orderkey), true) AS ok FROM orders)")
def check_sorted(read, spark):
    return prepare.is_sorted(read("orders"), "o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_suppkey) - count(*) AS BIGINT) AS first FROM lineitem GROUP BY l_suppkey")
def sort_classes(read, spark):
    return order.class_offsets(read("lineitem"), "l_suppkey")


@query("SELECT p_partkey, floor(p_retailprice / 100) AS a, p_size AS b, row_number() OVER (ORDER BY floor(p_retailprice / 100), p_size, p_partkey) - 1 AS position FROM part")
def sort_discrete_vectors(read, spark):
    d = read("part").select("p_partkey", F.floor(F.col("p_retailprice") / 100).cast("double").alias("a"), F.col("p_size").alias("b"))
    return order.positions(d, ["a", "b", "p_partkey"])


@query("SELECT p_brand, p_type, p_size, dense_rank() OVER (ORDER BY p_brand, p_type, p_size) - 1 AS number FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)")
def unify_vectors(read, spark):
    p = read("part").select("p_partkey", "p_brand", "p_type", "p_size")
    return sets.unify([p.where(F.col("p_partkey") % 3 == k).drop("p_partkey") for k in range(3)])


@query("SELECT p_size, count(*) AS n FROM (SELECT p_size FROM part WHERE p_partkey % 2 = 0 INTERSECT ALL SELECT p_size FROM part WHERE p_partkey % 2 = 1) GROUP BY p_size")
def list_intersection(read, spark):
    p = read("part")
    return p.where("p_partkey % 2 = 0").select("p_size").intersectAll(p.where("p_partkey % 2 = 1").select("p_size")).groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT p_size, count(*) AS n FROM (SELECT p_size FROM part WHERE p_partkey % 3 <> 0 EXCEPT ALL SELECT p_size FROM part WHERE p_partkey % 3 = 0) GROUP BY p_size")
def list_difference(read, spark):
    p = read("part")
    return p.where("p_partkey % 3 <> 0").select("p_size").exceptAll(p.where("p_partkey % 3 = 0").select("p_size")).groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.095)")
def unmatched_suppliers(read, spark):
    return read("supplier").select("s_suppkey").join(read("lineitem").where("l_quantity > 49.5 and l_discount > 0.095").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_anti")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS weight, count(*) AS n FROM lineitem GROUP BY ALL")
def dedup_weighted(read, spark):
    d = prepare.remove_duplicates(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return d.select("l_returnflag", "l_linestatus", F.round("l_quantity", 6).alias("weight"), "n")


@query("SELECT c_custkey, c_nationkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS new_label FROM (SELECT c_custkey, c_nationkey * 3 + 1 AS c_nationkey FROM customer)")
def compress_labels(read, spark):
    return prepare.compress_labels(read("customer").select("c_custkey", (F.col("c_nationkey") * 3 + 1).alias("c_nationkey")), "c_nationkey")


@query("SELECT CASE WHEN c_nationkey IN (0, 5) THEN 0 WHEN c_nationkey IN (7, 9, 11) THEN 1 ELSE -1 END AS label, count(*) AS n FROM customer GROUP BY 1")
def partition_labels(read, spark):
    return read("customer").select(prepare.partition_labels(F.col("c_nationkey"), [[0, 5], [7, 9, 11]]).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT CAST(least(greatest(floor((l_quantity - 5) / 40 * 8), 0), 7) AS INTEGER) AS cls, count(*) AS n FROM lineitem GROUP BY 1")
def discretize_linear(read, spark):
    return read("lineitem").select(prepare.discretise(F.col("l_quantity"), 5, 45, 8).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN b >= 0 AND b < 6 THEN CAST(b AS INTEGER) ELSE -1 END AS cls, count(*) AS n FROM (SELECT floor((ln(o_totalprice) - ln(2000)) / (ln(300000) - ln(2000)) * 6) AS b FROM orders) GROUP BY 1")
def discretize_geometric(read, spark):
    return read("orders").select(prepare.discretise(F.col("o_totalprice"), 2000, 300000, 6, geometric=True, open_ended=False).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_acctbal >= 5000 AS INTEGER) AS cls, count(*) AS n FROM customer GROUP BY 1")
def binary_threshold(read, spark):
    return read("customer").select((F.col("c_acctbal") >= 5000).cast("int").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 3, 7)")
def select_classes(read, spark):
    return read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal").where(F.col("s_nationkey").isin(1, 3, 7))


@query("SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE c_acctbal > -900")
def find_minmax(read, spark):
    return read("customer").where("c_acctbal > -900").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("SELECT count(DISTINCT p_type) AS entries, count(*) - count(DISTINCT p_type) AS duplicates FROM part")
def symbol_entries(read, spark):
    return read("part").agg(F.count_distinct("p_type").alias("entries"), (F.count("*") - F.count_distinct("p_type")).alias("duplicates"))


@query("SELECT count(DISTINCT user_id) AS nonzero FROM events")
def bits_nonzero(read, spark):
    return sets.bits_set(read("events"), "user_id")


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem")
def pearson_pair(read, spark):
    return read("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


@query("SELECT p_partkey, p_type, round(median(l_quantity), 6) AS typical FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def k_selection_median(read, spark):
    parts = read("part").select("p_partkey", "p_type")
    return read("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity").join(parts, "p_partkey").groupBy("p_partkey", "p_type").agg(F.round(F.median("l_quantity"), 6).alias("typical"))


@query("""
    SELECT p.p_partkey, coalesce(m3.m, m2.m, m1.m) AS found, CASE WHEN m3.m IS NOT NULL THEN 3 WHEN m2.m IS NOT NULL THEN 2 WHEN m1.m IS NOT NULL THEN 1 ELSE 0 END AS prefix
    FROM part p
    LEFT JOIN (SELECT p_brand, p_type, p_size, min(p_partkey) AS m FROM part WHERE p_retailprice > 1200 GROUP BY ALL) m3 USING (p_brand, p_type, p_size)
    LEFT JOIN (SELECT p_brand, p_type, min(p_partkey) AS m FROM part WHERE p_retailprice > 1200 GROUP BY ALL) m2 USING (p_brand, p_type)
    LEFT JOIN (SELECT p_brand, min(p_partkey) AS m FROM part WHERE p_retailprice > 1200 GROUP BY ALL) m1 USING (p_brand)""")
def prefix_match(read, spark):
    from ..operators.joins import prefix_match as match

    p = read("part").select("p_partkey", "p_brand", "p_type", "p_size")
    out = match(p, read("part").where("p_retailprice > 1200").select(F.col("p_partkey").alias("_id"), "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], "_id")
    return out.select("p_partkey", "found", "prefix")


@query("""
    SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, dayofyear(o_orderdate) - 1 + 0.0::DOUBLE AS doy, isodow(o_orderdate) AS dow,
        epoch_us(o_orderdate) / 86400000000 - epoch_us(TIMESTAMP '1900-01-01') / 86400000000 AS days FROM orders""".replace("year(o_orderdate) AS", "CAST(year(o_orderdate) AS INTEGER) AS").replace("month(o_orderdate) AS", "CAST(month(o_orderdate) AS INTEGER) AS").replace(" day(o_orderdate) AS", " CAST(day(o_orderdate) AS INTEGER) AS").replace("isodow(o_orderdate) AS", "CAST(isodow(o_orderdate) AS INTEGER) AS"))
def date_parts(read, spark):
    t = F.col("o_orderdate")
    return read("orders").select("o_orderkey", F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.round(dates.day_of_year(t), 9).alias("doy"), dates.day_of_week(t).alias("dow"), dates.days_between(t, F.lit("1900-01-01").cast("timestamp_ntz")).alias("days"))


@query("SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000 AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff_days(read, spark):
    j = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", dates.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("SELECT event_id, ts + INTERVAL 36 HOUR AS later, ts < TIMESTAMP '2024-01-05' AS early FROM events")
def date_arithmetic(read, spark):
    d = read("events")
    return d.select("event_id", dates.add_days(F.col("ts"), F.lit(1.5)).alias("later"), (F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")).alias("early"))


@query("SELECT event_id, date_trunc('second', ts) AS parsed, strftime(ts, '%Y/%m/%d-%H:%M:%S') AS text FROM events")
def date_text_round_trip(read, spark):
    t = F.date_format("ts", "yyyy/MM/dd-HH:mm:ss")
    return read("events").select("event_id", dates.parse(t).alias("parsed"), t.alias("text"))


@query("SELECT CAST(n AS BIGINT) AS n, TIMESTAMP '2024-01-01' + n * INTERVAL 6 HOUR AS t FROM range(40) r(n)")
def time_axis(read, spark):
    return spark.range(40).select(F.col("id").alias("n"), dates.add_days(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("id") / 4).alias("t"))


@query("SELECT p_partkey, substring(p_name, 1, 1) AS first, substring(p_name, 3, 4) AS mid, string_split(p_name, ' ')[1] AS word, length(p_name) AS n, p_name || '/' || p_brand AS joined, coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS number FROM part")
def string_functions(read, spark):
    s = F.col("p_name")
    return read("part").select("p_partkey", strings.element(s, 0).alias("first"), strings.middle(s, 2, 4).alias("mid"), F.get(strings.separate(s, " "), F.lit(0)).alias("word"), F.length(s).cast("long").alias("n"), F.concat(s, F.lit("/"), "p_brand").alias("joined"), strings.number(s).alias("number"))


@query("SELECT c_custkey, CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 17, 16) AS UBIGINT) % 5 AS BIGINT) AS fold FROM customer")
def fold_by_hash(read, spark):
    return sets.md5_fold(read("customer"), "c_custkey", 5)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_margins(read, spark):
    return read("customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w) * 2 - 1, 9) AS q FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def renormalise_steps(read, spark):
    d = read("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("q"))
    return order.renormalise(d, ["l_suppkey"], "q").withColumn("q", F.round("q", 9))


@query("SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS INTEGER) AS part FROM customer")
def split_parts(read, spark):
    return order.split_even(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 4).select("c_custkey", "part")


@query("SELECT event_id, make_timestamp(2020, month(ts), 1, hour(ts), 30, 0.0) AS changed FROM events")
def date_setter(read, spark):
    return read("events").select("event_id", dates.with_fields(F.col("ts"), year=2020, day=1, minute=30, second=0).alias("changed"))


@query("SELECT o_orderkey, round(exp(ln(o_totalprice)), 4) AS q, round(exp(ln(o_totalprice)) * (2 / o_totalprice), 6) AS err FROM orders")
def exp_measurements(read, spark):
    q, err = prepare.exp_with_error(*prepare.log_with_error(F.col("o_totalprice"), F.lit(2.0)))
    return read("orders").select("o_orderkey", F.round(q, 4).alias("q"), F.round(err, 6).alias("err"))
