"""The queries of the engine's own operators, each with its SQL. Statements go through the engine: rewriting, guard, pruning and all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex.functions import compat
from veridex.operators import search
from veridex.operators.engine import Engine
from veridex.plans import guard, typing
from veridex.sources import catalog
from veridex.sources.shared import work_dir

SQL: dict[str, str] = {
    "scan_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "projection_alias": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders",
    "qualified_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'",
    "filter_compare": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus <> 'P'",
    "filter_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "filter_not_in": "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P')",
    "filter_null": "SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND NULLIF(o_orderstatus, 'P') IS NULL",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%zz%'",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_brand ILIKE 'BRAND%1'",
    "filter_bool_tree": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 OR l_discount = 0.05) AND NOT (l_returnflag = 'R')",
    "typed_literals": "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= '1996-08-01' AND o_orderdate < DATE '1996-09-01'",
    "cte_filter": "WITH t AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM t GROUP BY o_custkey",
    "derived_table": "SELECT s, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 1000) t GROUP BY s",
    "scalar_subquery_recent": "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)",
    "semi_join": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "inner_join_multi": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "left_join_reference": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000",
    "full_join_balance": "SELECT coalesce(a.k, b.k) AS k, a.n AS orders_n, b.n AS customers_n FROM (SELECT o_custkey % 50 AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT c_custkey % 70 AS k, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1) b ON a.k = b.k",
    "right_join": "SELECT r.r_name, n.n_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_name LIKE '%A%'",
    "cross_join_share": "WITH total AS (SELECT sum(o_totalprice) AS t FROM orders) SELECT o_orderstatus, round(100.0 * sum(o_totalprice) / max(t), 6) AS pct FROM orders CROSS JOIN total GROUP BY o_orderstatus",
    "using_join": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)",
    "self_join_revision": "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey < b.o_orderkey AND a.o_totalprice <> b.o_totalprice",
    "latest_revision": "WITH m AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) SELECT o.o_custkey, o.o_totalprice FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderkey = m.k",
    "comma_join": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "group_ordinals": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2",
    "global_agg": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem",
    "agg_min_max_avg": "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    "count_distinct": "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    "cond_agg": "SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem",
    "filter_agg": "SELECT CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS n FROM lineitem",
    "stddev": "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
    "median": "SELECT o_orderstatus, round(median(o_totalprice), 6) AS m FROM orders GROUP BY o_orderstatus",
    "percentile_cont": "SELECT round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 6) AS p FROM orders",
    "having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_of_agg": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT round(avg(s), 4) AS mean, round(max(s), 4) AS top FROM t",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL",
    "mean_power_from_totals": "SELECT event_type, round(sum(value) / count(DISTINCT ts), 6) AS mean_power FROM events GROUP BY event_type",
    "row_number_peak": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
    "running_total_window": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM events",
    "lag_delta": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events",
    "lead_first_last": "SELECT event_id, lead(value) OVER w AS nxt, first_value(value) OVER w AS fst, last_value(value) OVER w AS lst FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer",
    "ranks": "SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS c FROM customer",
    "frame_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM events",
    "frame_range": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS s FROM lineitem",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "page_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 11 OFFSET 20",
    "order_nulls_last": "SELECT k FROM (SELECT NULLIF(o_custkey % 7, 3) AS k, o_orderkey FROM orders) t ORDER BY k ASC NULLS LAST, o_orderkey LIMIT 25",
    "union_all_unpivot": "SELECT l_returnflag AS flag, 'quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem",
    "union_distinct": "SELECT o_orderstatus AS s FROM orders UNION SELECT l_linestatus FROM lineitem",
    "except_rows": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    "intersect_rows": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "round_abs_greatest": "SELECT c_custkey, round(abs(c_acctbal), 1) AS a, greatest(c_acctbal, 0) AS g FROM customer",
    "ceil_floor_sqrt": "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(sqrt(abs(c_acctbal)), 6) AS s FROM customer",
    "ratio_nullif": "SELECT l_orderkey, l_linenumber, round(l_tax / NULLIF(l_discount, 0), 6) AS r FROM lineitem",
    "case_bands": "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END AS band FROM orders",
    "string_fns": "SELECT p_partkey, upper(trim(p_name)) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r FROM part",
    "concat_key": "SELECT l_orderkey || '-' || l_linenumber AS k FROM lineitem",
    "modulo_cast": "SELECT o_orderkey % 7 AS m, CAST(floor(o_totalprice) AS BIGINT) % 10 AS t FROM orders",
    "md5_repeat": "SELECT n_nationkey, md5(n_name) AS h, repeat(n_name, 2) AS twice FROM nation",
    "coalesce_try_cast": "SELECT p_partkey, coalesce(TRY_CAST(substr(p_brand, 7) AS INTEGER), -1) AS b, TRY_CAST('' AS DOUBLE) AS missing FROM part",
    "interval_shift": "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS due FROM orders",
    "current_date_filter": "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= current_date",
    "dialect_nulls_last": "SELECT k FROM (SELECT NULLIF(o_custkey % 7, 3) AS k, o_orderkey FROM orders) t ORDER BY k, o_orderkey LIMIT 25",
    "dialect_window_nulls_last": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY NULLIF(o_custkey % 7, 3), o_orderkey) AS BIGINT) AS r FROM orders",
    "dialect_zero_division": "SELECT l_orderkey, l_linenumber, l_quantity / l_discount > 100000000000 AS endless, (l_quantity - l_quantity) / (l_discount - l_discount) = 0 AS odd FROM lineitem",
    "dialect_dayofweek": "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS BIGINT) AS a, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS b, CAST(date_part('dow', o_orderdate) AS BIGINT) AS c, CAST(extract(isodow FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "dialect_datediff": "SELECT event_id, " + ", ".join(f"datediff('{u}', TIMESTAMP '2023-12-31 23:30:15', ts) AS {u}s" for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")) + " FROM events",
    "dialect_strftime": "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "dialect_date_trunc": "SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "dialect_strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents",
    "dialect_integer_division": "SELECT o_orderkey, o_custkey // 7 AS q FROM orders",
    "dialect_lists": "SELECT o_orderkey, list_contains([1, 2, 3], CAST(o_orderkey % 5 AS INTEGER)) AS c, o_custkey::VARCHAR AS k FROM orders",
    "qualify_top": "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "lateral_join": "SELECT n.n_name, t.m FROM nation n, LATERAL (SELECT max(c.c_acctbal) AS m FROM customer c WHERE c.c_nationkey = n.n_nationkey) t",
    "arg_max_min": "SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice * 100000 + o_orderkey % 1000) AS top, arg_min(o_orderkey, o_totalprice * 100000 + o_orderkey % 1000) AS low FROM orders GROUP BY 1",
    "string_agg_names": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "mode_any_count_if": "SELECT l_linestatus, mode(l_returnflag) AS m, CAST(count_if(l_quantity > 25) AS BIGINT) AS n FROM lineitem GROUP BY 1",
    "approx_distinct_is_near": "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.2 * count(DISTINCT o_custkey) AS near FROM orders",
    "unnest_rows": "SELECT n_nationkey, unnest([1, 2, 3]) AS x FROM nation",
    "series_rows": "SELECT CAST(g AS BIGINT) * 2 AS x FROM generate_series(1, 100) t(g) WHERE g % 3 = 0",
    "share_of_total": "SELECT o_orderstatus, round(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS pct FROM orders GROUP BY o_orderstatus",
}


def _view_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(sql)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(x: str) -> Column:
    """Money as whole cents: sums don't depend on their order."""
    return F.round(F.col(x) * 100).cast("long")


def group_monthly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy(compat.trunc("month", F.col("o_orderdate")).alias("month")).agg(F.sum(_cents("o_totalprice")).alias("total_cents"))


def rank_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = _t(spark, sf_dir, "orders").groupBy(compat.trunc("month", F.col("o_orderdate")).alias("month"), "o_orderstatus").agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count("*").alias("n"))
    return agg.withColumn("r", F.rank().over(Window.partitionBy("month").orderBy(F.desc_nulls_last(F.col("cents") / F.col("n")))).cast("long"))


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.extract(F.lit("HOUR"), d).cast("long").alias("h"), compat.day_of_week(d).alias("dow"), F.to_date(d).alias("day"), F.date_format(d, "yyyy").alias("text_year"))


def datediff_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_timestamp_ntz(F.lit("1995-01-01 23:00:00"))
    df = _t(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.col("o_orderdate").alias("b"))
    return df.select("o_orderkey", *(compat.boundaries(u, F.col("a"), F.col("b")).alias(f"{u}s") for u in ("year", "month", "day", "hour", "second")))


def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(compat.strip_accents(F.col("text"))).alias("h"))


def decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.replace(F.format_number("c_acctbal", 2), F.lit(","), F.lit("_")).alias("t"))
    return df.select("c_custkey", compat.decimal_text(F.replace(F.replace(F.col("t"), F.lit("."), F.lit(",")), F.lit("_"), F.lit("."))).alias("v"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def last_value_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(compat.last_value_by(F.col("value"), F.struct("ts", "event_id")).alias("last"))


def metric_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.load().find("events")
    m = d.metrics[0]
    return d.scan(spark, sf_dir).groupBy("event_type").agg(*(F.round(m.column(k), 8).alias(k) for k in m.modes if "shape" not in m.modes[k]))


def metric_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load().find("events").mode(spark, sf_dir, "load", "time_series", ["event_type"]).withColumn("time_series", F.round("time_series", 8))


def metric_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load().find("events").mode(spark, sf_dir, "load", "ranking", ["event_type"]).withColumn("ranking", F.round("ranking", 8))


def metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load().find("events").mode(spark, sf_dir, "load", "comparison", ["event_type"]).select("event_type", F.round("comparison", 8).alias("comparison"), F.round("part", 8).alias("part"))


def alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    return e.query(f"SELECT o_orderkey FROM orders WHERE {e.catalog.alias('orders', 'Open')}")


def pager_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Engine(spark, sf_dir).execute("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", limit=15, offset=30)
    return spark.createDataFrame([(*x, r.next_offset) for x in r.rows], "o_orderkey long, o_custkey long, next_offset long")


_YEARS: dict[tuple[str, str], str] = {}
#: The years 1996 and 1997 of orders, and a statement whose years cannot be proven.
PRUNED = "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders WHERE o_orderdate >= '1996-02-01' AND o_orderdate < '1998-01-01' GROUP BY 1"
UNPRUNED = PRUNED.replace("GROUP BY", "OR o_totalprice < 0 GROUP BY").replace("WHERE ", "WHERE (").replace("'1998-01-01'", "'1998-01-01')")


def year_files(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose orders are one file a year, some without the column o_orderpriority's last neighbour, as published series are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _YEARS:
        where, orders = work_dir(spark, "years"), _t(spark, sf_dir, "orders")
        by_year = orders.withColumn("y", F.year("o_orderdate")).repartition("y")
        by_year.write.partitionBy("y").mode("overwrite").parquet(f"{where}/all")
        years = [r[0] for r in by_year.select("y").distinct().collect()]  # one row a year
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(where).getFileSystem(spark._jsc.hadoopConfiguration())
        for y in years:
            fs.rename(path(f"{where}/all/y={y}"), path(f"{where}/ORDERS_{y}.parquet"))
        _YEARS[key] = where
    found = catalog.load()
    own = replace(found.find("orders"), source="ORDERS_*.parquet")
    return Engine(spark, _YEARS[key], catalog.Catalog(found.datasets | {own.key: own}))


def pruned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = year_files(spark, sf_dir).prepare(PRUNED)
    assert p.years == {1996, 1997} and len(p.files) == 2, p.files
    return p.df


def unpruned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_files(spark, sf_dir).query(UNPRUNED)


def reader_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, orders = work_dir(spark, "drift"), _t(spark, sf_dir, "orders")
    orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.mode("overwrite").parquet(f"{where}/a.parquet")
    orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").cast("string"), "o_orderstatus").write.mode("overwrite").parquet(f"{where}/b.parquet")
    return Engine(spark, where).query(f"SELECT o_orderkey, o_custkey, o_orderstatus, regexp_extract(filename, '[ab][.]parquet') AS f FROM read_parquet(['{where}/a.parquet', '{where}/b.parquet'], union_by_name = true, filename = true)")


def reader_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = work_dir(spark, "csv")
    _t(spark, sf_dir, "nation").write.mode("overwrite").csv(f"{where}/nation.csv", header=True, sep=";")
    return Engine(spark, where).query(f"SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM read_csv('{where}/nation.csv', header = true, delim = ';') WHERE n_regionkey > 0")


def reader_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = work_dir(spark, "json")
    _t(spark, sf_dir, "nation").write.mode("overwrite").json(f"{where}/nation.json")
    return Engine(spark, where).query(f"SELECT n_regionkey AS r, CAST(count(*) AS BIGINT) AS n FROM read_json('{where}/nation.json') GROUP BY 1")


def reader_parquet_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).query(f"SELECT n_name FROM read_parquet('{sf_dir}/natio?.parquet') WHERE n_nationkey < 9")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).freshness()


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("s"), "o_orderstatus", F.lit("p"), "o_orderpriority").alias("m"), F.struct("o_custkey", "o_totalprice").alias("t"), F.array("o_custkey", F.col("o_orderkey")).alias("a"))
    return df.select("o_orderkey", F.element_at("m", F.lit("p")).alias("p"), F.col("t.o_custkey").alias("c"), F.array_max("a").alias("most"), F.size(F.map_keys("m")).cast("long").alias("n"), F.from_json(F.to_json("t"), "o_custkey long")["o_custkey"].alias("j"))


def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(500).where("id % 3 = 0").select(F.col("id").alias("x"))


def pivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"], "measure", "v")


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return _t(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


QUESTION = "the were und pour la"
_W = "regexp_extract_all(strip_accents(lower({})), '[a-z0-9]{{2,}}')"
_T = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
BM25_SQL = f"""
    WITH q AS (SELECT unnest(list_distinct({_T.format("w")})) AS term FROM (SELECT {_W.format(f"'{QUESTION}'")} AS w)),
    t AS (SELECT doc_id, {_T.format("w")} AS t FROM (SELECT doc_id, {_W.format("coalesce(text, '')")} AS w FROM documents)),
    tf AS (SELECT doc_id, x AS term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM t) JOIN q ON x = term GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), a AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
    s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * len(t.t) / mean))) AS s FROM tf JOIN df USING (term) JOIN t USING (doc_id), a GROUP BY doc_id)
    SELECT doc_id, round(s / max(s) OVER (), 4) AS score FROM s ORDER BY s DESC, doc_id LIMIT 10"""


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_t(spark, sf_dir, "documents"), "doc_id", "text", QUESTION, 10)


def rank_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).search("monthly revenue of customer orders").select("key", "score", "band")


def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).list_datasets()


def additivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d.key, m.id, m.kind, typing.additive(m)) for d in catalog.load().datasets.values() for m in d.metrics], "dataset string, metric string, kind string, additive boolean")


GUARDED = (
    "SELECT 1 AS a", "WITH t AS (SELECT * FROM orders) SELECT count(*) FROM t", "SELECT * FROM orders UNION ALL SELECT * FROM orders", "DESCRIBE SELECT * FROM orders", "DROP TABLE orders", "SELECT 1; SELECT 2",
    "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets", "SELECT * FROM range(-100000000000, 0)", "SELECT sequence(-100000000000, 0) AS s", "SELECT repeat('a', 100000000 / 2) AS s", "SELECT current_user AS u",
    "SELECT * FROM read_parquet('/etc/passwd')", "SELECT * FROM read_text('x')", "SELECT spark_partition_id() AS p", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM secrets)", "SELECT * FROM parquet.`/etc/passwd`", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT * FROM range(100000000)", "SELECT * FROM orders, lineitem, customer", "SELECT * FROM secrets",
)


def guard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for sql in GUARDED:
        try:
            Engine(spark, sf_dir).query(sql)
            rows.append((sql, True))
        except guard.Rejected:
            rows.append((sql, False))
    return spark.createDataFrame(rows, "statement string, allowed boolean")


def result_schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    sql = "SELECT o_orderstatus, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
    rows = [(c["name"], c["role"], c["agg"], c["metric"], c["unit"], c["unit_tier"], c["additive"]) for c in typing.columns(e.query(sql), e.catalog, sql)]
    return spark.createDataFrame(rows, "name string, role string, agg string, metric string, unit string, unit_tier string, additive boolean")


MORE = {
    "group_monthly_sum": (group_monthly_sum, "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders GROUP BY 1"),
    "rank_monthly": (rank_monthly, "SELECT *, rank() OVER (PARTITION BY month ORDER BY cents / n DESC) AS r FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1, 2)"),
    "date_parts": (date_parts, "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, extract(hour FROM o_orderdate) AS h, dayofweek(o_orderdate) AS dow, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y') AS text_year FROM orders"),
    "datediff_units": (datediff_units, "SELECT o_orderkey, " + ", ".join(f"datediff('{u}', TIMESTAMP '1995-01-01 23:00:00', o_orderdate) AS {u}s" for u in ("year", "month", "day", "hour", "second")) + " FROM orders"),
    "strip_accents": (strip_accents, "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents"),
    "decimal_text": (decimal_text, "SELECT c_custkey, round(c_acctbal, 2) AS v FROM customer"),
    "json_props": (json_props, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "last_value_by_time": (last_value_by_time, "SELECT user_id, arg_max(value, {'ts': ts, 'e': event_id}) AS last FROM events GROUP BY user_id"),
    "metric_modes": (metric_modes, "SELECT event_type, round(sum(value * 0.5) / 1000, 8) AS total_energy, round(avg(value), 8) AS average_power, round(max(value), 8) AS peak_power, round(avg(value), 8) AS average, round(max(value), 8) AS maximum, round(min(value), 8) AS minimum, round(sum(value * 0.5), 8) AS total, round(max(value), 8) AS peak, round(arg_max(value, {'t': ts, 'e': event_id}), 8) AS last_value, count(*) FILTER (WHERE value > 10) AS count_eligible, count(*) FILTER (WHERE value <= 10) AS count_not_eligible, round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 8) AS rate_eligible FROM events GROUP BY 1"),
    "metric_time_series": (metric_time_series, "SELECT event_type, ts, round(avg(value), 8) AS time_series FROM events GROUP BY 1, 2"),
    "metric_ranking": (metric_ranking, "SELECT event_type, round(avg(value), 8) AS ranking, rank() OVER (ORDER BY avg(value) DESC) AS place FROM events GROUP BY 1"),
    "metric_comparison": (metric_comparison, "SELECT event_type, round(avg(value), 8) AS comparison, round(avg(value) / sum(avg(value)) OVER (), 8) AS part FROM events GROUP BY 1"),
    "alias_filter": (alias_filter, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "pager_rows": (pager_rows, "SELECT o_orderkey, o_custkey, 45 AS next_offset FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30"),
    "pruned_years": (pruned_years, PRUNED.replace("sum(CAST", "CAST(sum(CAST").replace(" AS cents", " AS BIGINT) AS cents")),
    "unpruned_years": (unpruned_years, UNPRUNED.replace("sum(CAST", "CAST(sum(CAST").replace(" AS cents", " AS BIGINT) AS cents")),
    "reader_union_by_name": (reader_union_by_name, "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN 'b.parquet' ELSE 'a.parquet' END AS f FROM orders"),
    "reader_csv": (reader_csv, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation WHERE n_regionkey > 0"),
    "reader_json": (reader_json, "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n FROM nation GROUP BY 1"),
    "reader_parquet_glob": (reader_parquet_glob, "SELECT n_name FROM nation WHERE n_nationkey < 9"),
    "freshness": (freshness, "SELECT 'sales/orders' AS dataset, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS rows FROM orders UNION ALL SELECT 'sales/lineitem', min(l_shipdate), max(l_shipdate), count(*) FROM lineitem UNION ALL SELECT 'web/events', min(ts), max(ts), count(*) FROM events"),
    "nested_values": (nested_values, "SELECT o_orderkey, o_orderpriority AS p, o_custkey AS c, greatest(o_custkey, o_orderkey) AS most, CAST(2 AS BIGINT) AS n, o_custkey AS j FROM orders"),
    "range_source": (range_source, "SELECT range AS x FROM range(500) WHERE range % 3 = 0"),
    "pivot_measures": (pivot_measures, "SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem"),
    "daily_windows": (daily_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "bm25_search": (bm25_search, BM25_SQL),
    "rank_datasets": (rank_datasets, None),
    "list_datasets": (list_datasets, "SELECT * FROM (VALUES ('sales/customer', 'Customers'), ('sales/lineitem', 'Order lines'), ('sales/nation', 'Nations'), ('sales/orders', 'Customer orders'), ('sales/part', 'Parts'), ('sales/region', 'Regions'), ('sales/supplier', 'Suppliers'), ('web/documents', 'Crawled texts'), ('web/events', 'Measured events')) v(key, title)"),
    "additivity_table": (additivity_table, "SELECT * FROM (VALUES ('sales/orders', 'order_value', 'financial_flow', true), ('sales/lineitem', 'quantity', 'flow', true), ('sales/lineitem', 'line_value', 'financial_flow', true), ('sales/lineitem', 'discount', 'ratio', false), ('web/events', 'load', 'average_power', false), ('sales/customer', 'balance', 'stock', false), ('sales/part', 'retail_price', 'price', false)) v(dataset, metric, kind, additive)"),
    "guard_table": (guard_table, "SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', {str(i < 4).lower()})" for i, s in enumerate(GUARDED)) + ") v(statement, allowed)"),
    "result_schema_table": (result_schema_table, "SELECT * FROM (VALUES ('o_orderstatus', 'dimension', NULL, NULL, NULL, 'unknown', NULL), ('total', 'measure', 'sum', 'order_value', 'USD', 'column_native', true), ('mean', 'measure', 'avg', 'order_value', 'USD', 'column_native', false), ('n', 'measure', 'count', NULL, NULL, 'count', true)) v(name, role, agg, metric, unit, unit_tier, additive)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _view_query(sql) for name, sql in SQL.items()} | {name: f for name, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {name: sql for name, (_, sql) in MORE.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value by status in one month, through the guard."""
    return Engine(spark, sf_dir).query("SELECT o_orderstatus, ROUND(AVG(o_totalprice), 1) AS mean_value, COUNT(*) AS n FROM orders WHERE o_orderdate >= '1996-08-01' AND o_orderdate < '1996-09-01' GROUP BY 1")
