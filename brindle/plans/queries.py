"""Registered queries: bodies over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Index
from .search import count, search, search_all

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
OVERRIDES = {"documents": {"text": {"type": "text", "fields": ["raw"]}}, "benchmark": {"text": {"type": "text"}}}
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def index(spark: SparkSession, sf_dir: str, table: str, overrides: dict | None = None, change=None) -> Index:
    catalog = Catalog(spark)
    key = KEYS.get(table)
    keys = (key,) if key else LINE if table == "lineitem" else ("conv_id", "turn")
    own = catalog.attach(table, f"{sf_dir}/{table}.parquet", key, keys, OVERRIDES.get(table, {}) | (overrides or {}) if not change else {})
    return Index(table, change(own.df), key, keys, (OVERRIDES.get(table, {}) | (overrides or {}))) if change else own


def register(name: str, table: str, body: dict, sql: str | None, path: str | None = None, pick: dict | None = None, change=None, overrides: dict | None = None, rounded: tuple = ()) -> None:
    """path: the aggregation to show, None for hits. pick: result column -> name shown. rounded: columns rounded to 4 places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(index(spark, sf_dir, table, overrides, change), body)
        df = found.hits if path is None else found.total if path == "total" else found.max_score if path == "max_score" else found.aggregations[path]
        out = [F.col(f"`{c}`").alias(n) for c, n in pick.items()] if pick else [F.col(f"`{c}`") for c in df.columns]
        df = df.select(*out)
        return df.select(*(F.round(f"`{c}`", 4).alias(c) if c in rounded else F.col(f"`{c}`") for c in df.columns))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def rows(name: str, table: str, query: dict, where: str, key: str | None = None, change=None, overrides=None, source: str | None = None) -> None:
    """A predicate: the keys of all rows that match."""
    key = key or KEYS[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.query import translate

        own = index(spark, sf_dir, table, overrides, change)
        return own.df.where(translate(own, query).pred).select(key)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key} FROM {source or table} WHERE {where}"


# ---------------------------------------------------------------- predicates

NULLED = lambda df: df.withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
NULLED_SQL = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"

rows("q_match_all", "nation", {"match_all": {}}, "true")
rows("q_match_none", "nation", {"match_none": {}}, "false")
rows("q_term", "part", {"term": {"p_brand": "Brand#3"}}, "p_brand = 'Brand#3'")
rows("q_term_case_insensitive", "part", {"term": {"p_brand": {"value": "bRAND#3", "case_insensitive": True}}}, "lower(p_brand) = 'brand#3'")
rows("q_term_date_day", "orders", {"term": {"o_orderdate": "1998-10-03"}}, "o_orderdate >= '1998-10-03' AND o_orderdate < '1998-10-04'")
rows("q_term_date_month", "orders", {"term": {"o_orderdate": "1997-05"}}, "o_orderdate >= '1997-05-01' AND o_orderdate < '1997-06-01'")
rows("q_term_int", "part", {"term": {"p_size": 11}}, "p_size = 11")
rows("q_terms", "orders", {"terms": {"o_orderpriority": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')")
rows("q_terms_dates", "orders", {"terms": {"o_orderdate": ["1998-10-03", "1997-05-28"]}}, "o_orderdate::date IN ('1998-10-03', '1997-05-28')")
rows("q_ids", "customer", {"ids": {"values": ["3", "14", "159", "x"]}}, "c_custkey IN (3, 14, 159)")
rows("q_exists", "customer", {"exists": {"field": "c_acctbal"}}, "c_acctbal IS NOT NULL", change=NULLED, source=NULLED_SQL)
rows("q_range_number", "orders", {"range": {"o_totalprice": {"gte": 100000, "lt": 250000.5}}}, "o_totalprice >= 100000 AND o_totalprice < 250000.5")
rows("q_range_date", "orders", {"range": {"o_orderdate": {"gte": "1996-02", "lte": "1996-03"}}}, "o_orderdate >= '1996-02-01' AND o_orderdate < '1996-04-01'")
rows("q_range_date_math", "orders", {"range": {"o_orderdate": {"gt": "1996-02-10||/M", "lt": "1996-02-10||+3M/d"}}}, "o_orderdate >= '1996-03-01' AND o_orderdate < '1996-05-10'")
rows("q_range_date_zone", "events", {"range": {"ts": {"gte": "2024-01-10", "lt": "2024-01-12", "time_zone": "+02:00"}}}, "ts >= '2024-01-09 22:00:00' AND ts < '2024-01-11 22:00:00'")
rows("q_range_date_format", "orders", {"range": {"o_orderdate": {"gte": "03/10/1998", "format": "dd/MM/yyyy"}}}, "o_orderdate >= '1998-10-03'")
rows("q_range_keyword", "customer", {"range": {"c_name": {"gte": "Customer#000000100", "lt": "Customer#000000200"}}}, "c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")
rows("q_wildcard", "part", {"wildcard": {"p_name": {"value": "r?d*ng"}}}, "p_name LIKE 'r_d%ng'")
rows("q_wildcard_ci", "part", {"wildcard": {"p_name": {"value": "RED*", "case_insensitive": True}}}, "p_name ILIKE 'red%'")
rows("q_regexp", "part", {"regexp": {"p_name": {"value": "(red|blue) w.*"}}}, "regexp_full_match(p_name, '(red|blue) w.*')")
rows("q_prefix", "part", {"prefix": {"p_name": {"value": "small"}}}, "starts_with(p_name, 'small')")
rows("q_prefix_ci", "part", {"prefix": {"p_name": {"value": "SMALL", "case_insensitive": True}}}, "starts_with(lower(p_name), 'small')")
rows("q_bool_full", "orders", {"bool": {"must": [{"term": {"o_orderstatus": "F"}}], "filter": [{"range": {"o_totalprice": {"gt": 50000}}}], "must_not": [{"term": {"o_orderpriority": "5-LOW"}}], "should": [{"term": {"o_orderpriority": "1-URGENT"}}]}}, "o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderpriority <> '5-LOW'")
rows("q_bool_should_only", "orders", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gt": 400000}}}]}}, "o_orderstatus = 'F' OR o_totalprice > 400000")
rows("q_bool_minimum_should_match", "orders", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gt": 200000}}}, {"term": {"o_orderpriority": "1-URGENT"}}], "minimum_should_match": 2}}, "(o_orderstatus = 'F')::int + (o_totalprice > 200000)::int + (o_orderpriority = '1-URGENT')::int >= 2")
rows("q_bool_must_not_nulls", "customer", {"bool": {"must_not": [{"range": {"c_acctbal": {"gt": 5000}}}, {"term": {"c_mktsegment": "MACHINERY"}}]}}, "(c_acctbal > 5000) IS NOT TRUE AND (c_mktsegment = 'MACHINERY') IS NOT TRUE", change=NULLED, source=NULLED_SQL)
rows("q_constant_score", "orders", {"constant_score": {"filter": {"term": {"o_orderstatus": "P"}}, "boost": 2}}, "o_orderstatus = 'P'")
rows("q_dis_max", "orders", {"dis_max": {"queries": [{"term": {"o_orderstatus": "P"}}, {"term": {"o_orderpriority": "2-HIGH"}}]}}, "o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'")
rows("q_boosting", "orders", {"boosting": {"positive": {"term": {"o_orderstatus": "P"}}, "negative": {"term": {"o_orderpriority": "2-HIGH"}}, "negative_boost": 0.2}}, "o_orderstatus = 'P'")
rows("q_match_keyword", "part", {"match": {"p_brand": "Brand#7"}}, "p_brand = 'Brand#7'")
rows("q_fuzzy", "part", {"fuzzy": {"p_type": {"value": "ECONOMI", "fuzziness": 1}}}, "levenshtein(p_type, 'ECONOMI') <= 1")
rows("q_script", "orders", {"script": {"script": {"source": "o_totalprice > :x * 2", "params": {"x": 100000}}}}, "o_totalprice > 200000")
rows("q_wrapper", "part", {"wrapper": {"query": "eyJ0ZXJtIjogeyJwX3NpemUiOiA3fX0="}}, "p_size = 7")
rows("q_query_string", "orders", {"query_string": {"query": "(o_orderstatus:F OR o_orderstatus:P) AND NOT o_orderpriority:2-HIGH AND o_totalprice:[1000 TO 90000]"}}, "o_orderstatus IN ('F', 'P') AND o_orderpriority <> '2-HIGH' AND o_totalprice BETWEEN 1000 AND 90000")
rows("q_simple_query_string", "orders", {"simple_query_string": {"query": "F + 1-URGENT | P", "fields": ["o_orderstatus", "o_orderpriority"]}}, "(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'P'")
LISTED = lambda df: df.withColumn("tags", F.array("p_brand", "p_type", F.split("p_name", " ")[0]))
rows("q_terms_list", "part", {"terms": {"tags": ["red", "ECONOMY"]}}, "list_has_any(tags, ['red', 'ECONOMY'])", change=LISTED, source="(SELECT *, [p_brand, p_type, split_part(p_name, ' ', 1)] AS tags FROM part)")
rows("q_terms_set", "part", {"terms_set": {"tags": {"terms": ["red", "ECONOMY", "Brand#3"], "minimum_should_match_script": {"source": "2"}}}}, "len(list_intersect(tags, ['red', 'ECONOMY', 'Brand#3'])) >= 2", change=LISTED, source="(SELECT *, [p_brand, p_type, split_part(p_name, ' ', 1)] AS tags FROM part)")
STRUCT = lambda df: df.withColumn("meta", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
rows("q_struct_path", "customer", {"bool": {"filter": [{"term": {"meta.segment": "MACHINERY"}}, {"range": {"meta.balance": {"gt": 100}}}]}}, "c_mktsegment = 'MACHINERY' AND c_acctbal > 100", change=STRUCT)
ITEMS = lambda df: df.withColumn("items", F.array(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("v")), F.struct(F.lit("click").alias("kind"), (F.col("user_id") % 10).cast("double").alias("v"))))
ITEMS_SQL = "(SELECT *, [{'kind': event_type, 'v': value}, {'kind': 'click', 'v': (user_id % 10)::double}] AS items FROM events)"
rows("n_nested_exists", "events", {"nested": {"path": "items", "query": {"bool": {"filter": [{"term": {"items.kind": "click"}}, {"range": {"items.v": {"gt": 8}}}]}}}}, "len(list_filter(items, lambda x: x.kind = 'click' AND x.v > 8)) > 0", change=ITEMS, source=ITEMS_SQL)
GEO = lambda df: df.withColumn("at", F.struct(((F.col("c_custkey") * 37) % 170 - 85).cast("double").alias("lat"), ((F.col("c_custkey") * 91) % 360 - 180).cast("double").alias("lon")))
GEO_SQL = "(SELECT *, ((c_custkey * 37) % 170 - 85)::double AS lat, ((c_custkey * 91) % 360 - 180)::double AS lon FROM customer)"
HAVERSINE = "2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians({0})) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin((radians(lon) - radians({1})) / 2), 2))))"
rows("g_distance", "customer", {"geo_distance": {"distance": "3000km", "at": {"lat": 48.0, "lon": 11.0}}}, HAVERSINE.format("48.0", "11.0") + " <= 3000000", change=GEO, source=GEO_SQL)
rows("g_bounding_box", "customer", {"geo_bounding_box": {"at": {"top_left": {"lat": 60, "lon": -20}, "bottom_right": {"lat": 20, "lon": 40}}}}, "lat BETWEEN 20 AND 60 AND lon BETWEEN -20 AND 40", change=GEO, source=GEO_SQL)
rows("g_polygon", "customer", {"geo_polygon": {"at": {"points": [{"lat": 0.5, "lon": 0.5}, {"lat": 50.5, "lon": 0.5}, {"lat": 0.5, "lon": 50.5}]}}}, "lat > 0.5 AND lon > 0.5 AND lat + lon < 51.0", change=GEO, source=GEO_SQL)
IP = lambda df: df.withColumn("ip", F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 7).cast("string"), (F.col("c_custkey") % 250).cast("string"), F.lit("9")))
rows("q_ip_block", "customer", {"term": {"ip": "10.3.0.0/16"}}, "c_custkey % 7 = 3", change=IP, overrides={"ip": {"type": "ip"}})
rows("q_ip_range", "customer", {"range": {"ip": {"gte": "10.2.0.0", "lt": "10.4.100.0"}}}, "(c_custkey % 7) * 1000 + c_custkey % 250 >= 2000 AND (c_custkey % 7) * 1000 + c_custkey % 250 < 4100", change=IP, overrides={"ip": {"type": "ip"}})
rows("q_unmapped", "nation", {"term": {"missing_field": 1}}, "false")

# ---------------------------------------------------------------- metrics

L = "l_extendedprice"


def metric(name: str, aggs: dict, pick: dict, sql: str, table: str = "lineitem", **more) -> None:
    register(name, table, {"size": 0, "aggs": aggs}, sql, "", pick, rounded=tuple(pick.values()), **more)


metric("m_sum", {"x": {"sum": {"field": L}}}, {"x": "total"}, f"SELECT round(sum({L}), 4) AS total FROM lineitem")
metric("m_avg", {"x": {"avg": {"field": L}}}, {"x": "mean"}, f"SELECT round(avg({L}), 4) AS mean FROM lineitem")
metric("m_min_max", {"a": {"min": {"field": "l_shipdate"}}, "b": {"max": {"field": L}}}, {"a": "first_ship", "b": "top"}, f"SELECT round(epoch_ms(min(l_shipdate))::double, 4) AS first_ship, round(max({L}), 4) AS top FROM lineitem")
register("m_value_count", "customer", {"size": 0, "aggs": {"n": {"value_count": {"field": "c_acctbal"}}}}, f"SELECT count(c_acctbal) AS n FROM {NULLED_SQL}", "", {"n": "n"}, change=NULLED)
metric("m_stats", {"s": {"stats": {"field": "l_quantity"}}}, {"s.count": "n", "s.min": "lo", "s.max": "hi", "s.avg": "mean", "s.sum": "total"}, "SELECT count(l_quantity) AS n, round(min(l_quantity), 4) AS lo, round(max(l_quantity), 4) AS hi, round(avg(l_quantity), 4) AS mean, round(sum(l_quantity), 4) AS total FROM lineitem")
metric("m_extended_stats", {"s": {"extended_stats": {"field": "l_quantity"}}}, {"s.sum_of_squares": "squares", "s.variance": "var", "s.std_deviation": "sd", "s.std_upper": "up", "s.std_lower": "low"}, "SELECT round(sum(l_quantity * l_quantity), 4) AS squares, round(var_pop(l_quantity), 4) AS var, round(stddev_pop(l_quantity), 4) AS sd, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 4) AS up, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 4) AS low FROM lineitem")
register("m_cardinality_exact", "lineitem", {"size": 0, "aggs": {"n": {"cardinality": {"field": "l_partkey", "exact": True}}}}, "SELECT count(DISTINCT l_partkey) AS n FROM lineitem", "", {"n": "n"})
register("m_cardinality_sketch", "lineitem", {"size": 0, "aggs": {"n": {"cardinality": {"field": "l_partkey"}}}}, None, "", {"n": "n"})
metric("m_percentiles_exact", {"p": {"percentiles": {"field": L, "percents": [5, 50, 95], "exact": True}}}, {"p.5.0": "p5", "p.50.0": "p50", "p.95.0": "p95"}, f"SELECT round(quantile_cont({L}, 0.05), 4) AS p5, round(quantile_cont({L}, 0.5), 4) AS p50, round(quantile_cont({L}, 0.95), 4) AS p95 FROM lineitem")
register("m_percentiles_sketch", "lineitem", {"size": 0, "aggs": {"p": {"percentiles": {"field": L}}}}, None, "")
metric("m_percentile_ranks", {"p": {"percentile_ranks": {"field": "l_quantity", "values": [10, 25.5]}}}, {"p.10.0": "below_10", "p.25.5": "below_25"}, "SELECT round(avg((l_quantity <= 10)::int) * 100, 4) AS below_10, round(avg((l_quantity <= 25.5)::int) * 100, 4) AS below_25 FROM lineitem")
metric("m_weighted_avg", {"w": {"weighted_avg": {"value": {"field": L}, "weight": {"field": "l_quantity"}}}}, {"w": "mean"}, f"SELECT round(sum({L} * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem")
metric("m_median_absolute_deviation", {"m": {"median_absolute_deviation": {"field": "l_quantity"}}}, {"m": "mad"}, "SELECT round(mad(l_quantity), 4) AS mad FROM lineitem")
metric("m_matrix_stats", {"m": {"matrix_stats": {"fields": ["l_quantity", "l_discount"]}}}, {"m.count": "n", "m.l_quantity.mean": "mean", "m.l_quantity.variance": "var", "m.l_quantity.l_discount.covariance": "cov", "m.l_quantity.l_discount.correlation": "corr"}, "SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS var, round(covar_samp(l_quantity, l_discount), 4) AS cov, round(corr(l_quantity, l_discount), 4) AS corr FROM lineitem")
metric("m_missing_value", {"x": {"avg": {"field": "c_acctbal", "missing": 0}}}, {"x": "mean"}, f"SELECT round(avg(coalesce(c_acctbal, 0)), 4) AS mean FROM {NULLED_SQL}", "customer", change=NULLED)
metric("m_script", {"x": {"sum": {"script": "l_extendedprice * (1 - l_discount)"}}}, {"x": "revenue"}, "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem")
metric("m_scripted_metric", {"x": {"scripted_metric": {"map_script": "l_tax * l_quantity", "combine_script": "sum(value)"}}}, {"x": "tax"}, "SELECT round(sum(l_tax * l_quantity), 4) AS tax FROM lineitem")
metric("m_geo_centroid", {"c": {"geo_centroid": {"field": "at"}}}, {"c.lat": "lat", "c.lon": "lon"}, f"SELECT round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM {GEO_SQL}", "customer", change=GEO)
metric("m_geo_bounds", {"b": {"geo_bounds": {"field": "at"}}}, {"b.top": "t", "b.left": "l", "b.bottom": "b", "b.right": "r"}, f"SELECT round(max(lat), 4) AS t, round(min(lon), 4) AS l, round(min(lat), 4) AS b, round(max(lon), 4) AS r FROM {GEO_SQL}", "customer", change=GEO)

# ---------------------------------------------------------------- buckets


def buckets(name: str, table: str, aggs: dict, path: str, sql: str | None, rounded: tuple = (), query: dict | None = None, **more) -> None:
    register(name, table, {"size": 0, **({"query": query} if query else {}), "aggs": aggs}, sql, path, rounded=rounded, **more)


AVG = {"mean": {"avg": {"field": L}}}
buckets("q_terms_avg", "lineitem", {"flag": {"terms": {"field": "l_returnflag"}, "aggs": AVG}}, "flag", f"SELECT l_returnflag AS flag, count(*) AS doc_count, round(avg({L}), 4) AS mean FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ("mean",), {"bool": {"filter": [{"range": {"l_quantity": {"gte": 10}}}]}})
buckets("b_terms", "orders", {"c": {"terms": {"field": "o_custkey", "size": 7}}}, "c", "SELECT o_custkey AS c, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
buckets("b_terms_by_key", "part", {"b": {"terms": {"field": "p_brand", "order": {"_key": "desc"}, "size": 5}}}, "b", "SELECT p_brand AS b, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
buckets("b_terms_by_metric", "part", {"b": {"terms": {"field": "p_brand", "order": {"top": "desc"}, "size": 6}, "aggs": {"top": {"max": {"field": "p_retailprice"}}}}}, "b", "SELECT p_brand AS b, count(*) AS doc_count, max(p_retailprice) AS top FROM part GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 6")
buckets("b_terms_include_exclude", "part", {"b": {"terms": {"field": "p_brand", "include": "Brand#1.*", "exclude": ["Brand#13"], "size": 50}}}, "b", "SELECT p_brand AS b, count(*) AS doc_count FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_brand <> 'Brand#13' GROUP BY 1")
buckets("b_terms_min_doc_count", "orders", {"c": {"terms": {"field": "o_custkey", "min_doc_count": 15, "size": None}}}, "c", "SELECT o_custkey AS c, count(*) AS doc_count FROM orders GROUP BY 1 HAVING count(*) >= 15")
buckets("b_terms_missing", "customer", {"s": {"terms": {"field": "c_mktsegment", "missing": "none"}}}, "s", f"SELECT coalesce(c_mktsegment, 'none') AS s, count(*) AS doc_count FROM {NULLED_SQL} GROUP BY 1", change=NULLED)
buckets("b_terms_null_key", "customer", {"s": {"terms": {"field": "c_mktsegment"}}}, "s", f"SELECT c_mktsegment AS s, count(*) AS doc_count FROM {NULLED_SQL} WHERE c_mktsegment IS NOT NULL GROUP BY 1", change=NULLED)
buckets("b_terms_list", "part", {"t": {"terms": {"field": "tags", "size": 8}}}, "t", "SELECT t, count(*) AS doc_count FROM (SELECT unnest(list_distinct([p_brand, p_type, split_part(p_name, ' ', 1)])) AS t FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", change=LISTED)
buckets("b_terms_date", "orders", {"d": {"terms": {"field": "o_orderdate", "size": 5}}}, "d", "SELECT epoch_ms(o_orderdate) AS d, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
buckets("b_multi_terms", "lineitem", {"k": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}]}}}, "k", "SELECT l_returnflag || '|' || l_linestatus AS k, count(*) AS doc_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
buckets("b_terms_terms_avg", "lineitem", {"flag": {"terms": {"field": "l_returnflag", "size": 2}, "aggs": {"status": {"terms": {"field": "l_linestatus"}, "aggs": AVG}}}}, "flag>status", f"WITH t AS (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS doc_count, round(avg({L}), 4) AS mean FROM lineitem JOIN t USING (l_returnflag) GROUP BY 1, 2", ("mean",))
buckets("b_parent_counts", "customer", {"n": {"terms": {"field": "c_nationkey", "size": 30}, "aggs": {"s": {"terms": {"field": "c_mktsegment"}}, "bal": {"value_count": {"field": "c_acctbal"}}}}}, "n", f"SELECT c_nationkey AS n, count(*) AS doc_count, count(c_acctbal) AS bal FROM {NULLED_SQL} GROUP BY 1", change=NULLED)
buckets("b_three_levels", "lineitem", {"a": {"terms": {"field": "l_returnflag"}, "aggs": {"b": {"terms": {"field": "l_linestatus"}, "aggs": {"c": {"terms": {"field": "l_linenumber", "size": 3}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}}}}}, "a>b>c", "SELECT a, b, c, doc_count, q FROM (SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, count(*) AS doc_count, round(sum(l_quantity), 4) AS q, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2, 3) WHERE r <= 3", ("q",))
buckets("b_histogram", "orders", {"h": {"histogram": {"field": "o_totalprice", "interval": 50000, "min_doc_count": 1}}}, "h", "SELECT floor(o_totalprice / 50000) * 50000 AS h, count(*) AS doc_count FROM orders GROUP BY 1")
buckets("b_histogram_offset", "orders", {"h": {"histogram": {"field": "o_totalprice", "interval": 50000, "offset": 7000, "min_doc_count": 1}}}, "h", "SELECT floor((o_totalprice - 7000) / 50000) * 50000 + 7000 AS h, count(*) AS doc_count FROM orders GROUP BY 1")
buckets("b_histogram_gapfill", "customer", {"h": {"histogram": {"field": "c_acctbal", "interval": 100}}}, "h", "WITH g AS (SELECT floor(c_acctbal / 100)::bigint AS o, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT unnest(range(min(o), max(o) + 1)) AS o FROM g) SELECT (o * 100)::double AS h, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (o)")
buckets("b_histogram_bounds", "part", {"h": {"histogram": {"field": "p_size", "interval": 10, "extended_bounds": {"min": -20, "max": 80}}}}, "h", "WITH g AS (SELECT floor(p_size / 10.0)::bigint AS o, count(*) AS n FROM part GROUP BY 1), e AS (SELECT unnest(range(-2, 9)) AS o) SELECT (o * 10)::double AS h, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (o)")
buckets("b_date_histogram_month", "lineitem", {"m": {"date_histogram": {"field": "l_shipdate", "calendar_interval": "month", "min_doc_count": 1}, "aggs": {"q": {"sum": {"field": L}}}}}, "m", f"SELECT epoch_ms(date_trunc('month', l_shipdate)) AS m, count(*) AS doc_count, round(sum({L}), 4) AS q FROM lineitem GROUP BY 1", ("q",))
for _unit in ("day", "week", "quarter", "year"):
    buckets(f"b_date_histogram_{_unit}", "orders", {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": _unit, "min_doc_count": 1}}}, "m", f"SELECT epoch_ms(date_trunc('{_unit}', o_orderdate)) AS m, count(*) AS doc_count FROM orders GROUP BY 1")
buckets("b_date_histogram_hour", "events", {"h": {"date_histogram": {"field": "ts", "calendar_interval": "hour"}}}, "h", "WITH g AS (SELECT epoch_ms(date_trunc('hour', ts)) // 3600000 AS o, count(*) AS n FROM events GROUP BY 1), e AS (SELECT unnest(range(min(o), max(o) + 1)) AS o FROM g) SELECT o * 3600000 AS h, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (o)")
buckets("b_date_histogram_fixed", "events", {"h": {"date_histogram": {"field": "ts", "fixed_interval": "90m", "min_doc_count": 1}}}, "h", "SELECT epoch_ms(ts) // 5400000 * 5400000 AS h, count(*) AS doc_count FROM events GROUP BY 1")
buckets("b_date_histogram_offset", "events", {"h": {"date_histogram": {"field": "ts", "calendar_interval": "day", "offset": "+6h", "min_doc_count": 1}}}, "h", "SELECT (epoch_ms(ts) - 21600000) // 86400000 * 86400000 + 21600000 AS h, count(*) AS doc_count FROM events GROUP BY 1")
buckets("b_date_histogram_month_gaps", "orders", {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}}}, "m", "WITH g AS (SELECT date_trunc('month', o_orderdate) AS o, count(*) AS n FROM orders WHERE o_totalprice > 480000 GROUP BY 1), e AS (SELECT unnest(generate_series((SELECT min(o) FROM g)::timestamp, (SELECT max(o) FROM g)::timestamp, INTERVAL 1 MONTH)) AS o) SELECT epoch_ms(e.o) AS m, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g ON g.o = e.o", query={"range": {"o_totalprice": {"gt": 480000}}})
buckets("b_range_overlap", "orders", {"r": {"range": {"field": "o_totalprice", "ranges": [{"to": 100000}, {"from": 50000, "to": 200000}, {"from": 900000}]}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}}}}, "r", "SELECT '*-100000.0' AS r, count(*) AS doc_count, round(coalesce(sum(o_totalprice), 0), 4) AS s FROM orders WHERE o_totalprice < 100000 UNION ALL SELECT '50000.0-200000.0', count(*), round(coalesce(sum(o_totalprice), 0), 4) FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000 UNION ALL SELECT '900000.0-*', count(*), round(coalesce(sum(o_totalprice), 0), 4) FROM orders WHERE o_totalprice >= 900000", ("s",))
buckets("b_date_range", "orders", {"r": {"date_range": {"field": "o_orderdate", "ranges": [{"key": "old", "to": "1996-01-01"}, {"key": "new", "from": "1998"}]}}}, "r", "SELECT 'old' AS r, count(*) AS doc_count FROM orders WHERE o_orderdate < '1996-01-01' UNION ALL SELECT 'new', count(*) FROM orders WHERE o_orderdate >= '1998-01-01'")
buckets("b_missing", "customer", {"m": {"missing": {"field": "c_acctbal"}}}, "m", f"SELECT count(*) AS doc_count FROM {NULLED_SQL} WHERE c_acctbal IS NULL", change=NULLED)
buckets("b_filter", "lineitem", {"f": {"filter": {"term": {"l_returnflag": "A"}}, "aggs": AVG}}, "f", f"SELECT count(*) AS doc_count, round(avg({L}), 4) AS mean FROM lineitem WHERE l_returnflag = 'A'", ("mean",))
buckets("b_filters_other", "orders", {"f": {"filters": {"filters": {"urgent": {"term": {"o_orderpriority": "1-URGENT"}}, "big": {"range": {"o_totalprice": {"gte": 300000}}}, "none": {"match_none": {}}}, "other_bucket": True}}}, "f", "SELECT 'urgent' AS f, count(*) AS doc_count FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'big', count(*) FROM orders WHERE o_totalprice >= 300000 UNION ALL SELECT 'none', 0 UNION ALL SELECT '_other_', count(*) FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice < 300000")
buckets("b_filters_under_terms", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"f": {"filters": {"filters": {"big": {"range": {"o_totalprice": {"gte": 450000}}}, "none": {"match_none": {}}}}}}}}, "s>f", "SELECT o_orderstatus AS s, 'big' AS f, count(*) FILTER (o_totalprice >= 450000) AS doc_count FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT o_orderstatus, 'none', 0 FROM orders")
buckets("b_adjacency_matrix", "orders", {"m": {"adjacency_matrix": {"filters": {"a": {"term": {"o_orderstatus": "F"}}, "b": {"term": {"o_orderpriority": "1-URGENT"}}}}}}, "m", "SELECT 'a' AS m, count(*) AS doc_count FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'a&b', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_PAGE = {"sources": [{"f": {"terms": {"field": "l_returnflag"}}}, {"n": {"terms": {"field": "l_linenumber", "order": "desc"}}}], "size": 5}
_PAGE_SQL = "SELECT c.f AS f, c.n AS n, doc_count FROM (SELECT struct_pack(f := l_returnflag, n := l_linenumber) AS c, count(*) AS doc_count FROM lineitem GROUP BY 1) {} ORDER BY c.f, c.n DESC LIMIT 5"


def _composite(name: str, body: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(index(spark, sf_dir, "lineitem"), {"size": 0, "aggs": {"c": {"composite": body}}}).aggregations["c"]
        return found.select("c.*", "doc_count")

    QUERIES[name], ORACLE_SQL[name] = run, sql


_composite("b_composite_page1", _PAGE, _PAGE_SQL.format(""))
_composite("b_composite_page2", _PAGE | {"after": {"f": "A", "n": 3}}, _PAGE_SQL.format("WHERE c.f > 'A' OR (c.f = 'A' AND c.n < 3)"))
_composite("b_composite_dates", {"sources": [{"w": {"date_histogram": {"field": "l_shipdate", "fixed_interval": "30d"}}}, {"h": {"histogram": {"field": "l_quantity", "interval": 10}}}], "size": 12}, "SELECT epoch_ms(l_shipdate) // 2592000000 * 2592000000 AS w, floor(l_quantity / 10) * 10 AS h, count(*) AS doc_count FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 12")
buckets("b_auto_date_histogram", "orders", {"m": {"auto_date_histogram": {"field": "o_orderdate", "buckets": 12}}}, "m", None)
buckets("b_variable_width_histogram", "orders", {"m": {"variable_width_histogram": {"field": "o_totalprice", "buckets": 6}}}, "m", None)
buckets("b_sampler", "orders", {"s": {"sampler": {"shard_size": 200}, "aggs": {"m": {"avg": {"field": "o_totalprice"}}}}}, "s", "SELECT count(*) AS doc_count, round(avg(o_totalprice), 4) AS m FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200)", ("m",))
buckets("b_diversified_sampler", "orders", {"s": {"diversified_sampler": {"field": "o_custkey", "shard_size": 50, "max_docs_per_value": 1}, "aggs": {"m": {"avg": {"field": "o_totalprice"}}}}}, "s", "SELECT count(*) AS doc_count, round(avg(o_totalprice), 4) AS m FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_orderkey LIMIT 50)", ("m",))
buckets("b_nested", "events", {"i": {"nested": {"path": "items"}, "aggs": {"k": {"terms": {"field": "items.kind"}, "aggs": {"v": {"sum": {"field": "items.v"}}, "up": {"reverse_nested": {}}}}}}}, "i>k", f"SELECT k, count(*) AS doc_count, round(sum(v), 4) AS v FROM (SELECT unnest(items).kind AS k, unnest(items).v AS v FROM {ITEMS_SQL}) GROUP BY 1", ("v",), change=ITEMS)
buckets("b_reverse_nested", "events", {"i": {"nested": {"path": "items"}, "aggs": {"k": {"terms": {"field": "items.kind"}, "aggs": {"up": {"reverse_nested": {}}}}}}}, "i>k>up", f"SELECT k, count(DISTINCT event_id) AS doc_count FROM (SELECT event_id, unnest(items).kind AS k FROM {ITEMS_SQL}) GROUP BY 1", change=ITEMS)
buckets("b_geo_distance", "customer", {"r": {"geo_distance": {"field": "at", "origin": {"lat": 48.0, "lon": 11.0}, "unit": "km", "ranges": [{"key": "near", "to": 2000}, {"key": "far", "from": 2000}]}}}, "r", "SELECT CASE WHEN " + HAVERSINE.format("48.0", "11.0") + f" < 2000000 THEN 'near' ELSE 'far' END AS r, count(*) AS doc_count FROM {GEO_SQL} GROUP BY 1", change=GEO)
buckets("b_geotile_grid", "customer", {"t": {"geotile_grid": {"field": "at", "precision": 2}}}, "t", f"SELECT '2/' || greatest(0, least(3, floor((lon + 180) / 360 * 4)))::int || '/' || greatest(0, least(3, floor((1 - ln(tan(radians(greatest(-85.05112878, least(85.05112878, lat)))) + 1 / cos(radians(greatest(-85.05112878, least(85.05112878, lat))))) / pi()) / 2 * 4)))::int AS t, count(*) AS doc_count FROM {GEO_SQL} GROUP BY 1", change=GEO)
buckets("b_geohash_grid", "customer", {"t": {"geohash_grid": {"field": "at", "precision": 1}}}, "t", None, change=GEO)
buckets("b_ip_range", "customer", {"r": {"ip_range": {"field": "ip", "ranges": [{"mask": "10.3.0.0/16"}, {"from": "10.5.0.0"}]}}}, "r", "SELECT '10.3.0.0/16' AS r, count(*) FILTER (c_custkey % 7 = 3) AS doc_count FROM customer UNION ALL SELECT '10.5.0.0-*', count(*) FILTER (c_custkey % 7 >= 5) FROM customer", change=IP, overrides={"ip": {"type": "ip"}})

# ---------------------------------------------------------------- hits


def page(name: str, table: str, body: dict, sql: str, columns: list[str], **more) -> None:
    register(name, table, body | {"_source": columns}, sql, None, {c: c for c in columns}, **more)


page("h_sort_page", "orders", {"sort": [{"o_totalprice": "desc"}], "size": 20, "from": 10}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", ["o_orderkey", "o_totalprice"])
page("h_sort_nulls_last", "customer", {"sort": [{"c_acctbal": "desc"}, {"c_custkey": "desc"}], "size": 2000}, f"SELECT c_custkey, c_acctbal FROM {NULLED_SQL} ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 2000", ["c_custkey", "c_acctbal"], change=NULLED)
page("h_sort_missing_first", "customer", {"sort": [{"c_acctbal": {"order": "asc", "missing": "_first"}}], "size": 30}, f"SELECT c_custkey, c_acctbal FROM {NULLED_SQL} ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 30", ["c_custkey", "c_acctbal"], change=NULLED)
page("h_search_after", "orders", {"sort": [{"o_orderpriority": "asc"}, {"o_orderkey": "asc"}], "search_after": ["2-HIGH", 500], "size": 15}, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 500) ORDER BY 2, 1 LIMIT 15", ["o_orderkey", "o_orderpriority"])
page("h_search_after_nulls", "customer", {"sort": [{"c_acctbal": "asc"}, {"c_custkey": "asc"}], "search_after": [9900.0, 1], "size": 60}, f"SELECT c_custkey, c_acctbal FROM {NULLED_SQL} WHERE c_acctbal > 9900 OR c_acctbal IS NULL OR (c_acctbal = 9900 AND c_custkey > 1) ORDER BY 2 NULLS LAST, 1 LIMIT 60", ["c_custkey", "c_acctbal"], change=NULLED)
page("h_lineitem_page", "lineitem", {"sort": [{"l_shipdate": "asc"}], "size": 25}, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus LIMIT 25", ["l_orderkey", "l_linenumber", "l_quantity"])
page("h_post_filter", "orders", {"query": {"term": {"o_orderstatus": "F"}}, "post_filter": {"term": {"o_orderpriority": "1-URGENT"}}, "sort": ["o_orderkey"], "size": 12}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY 1 LIMIT 12", ["o_orderkey"])
page("h_collapse", "orders", {"sort": [{"o_totalprice": "desc"}], "collapse": {"field": "o_custkey"}, "size": 20}, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", ["o_custkey", "o_orderkey"])
register("h_inner_hits_top3", "orders", {"sort": [{"o_totalprice": "desc"}], "collapse": {"field": "o_custkey", "inner_hits": {"size": 3, "sort": [{"o_orderdate": "desc"}]}}, "size": 5, "_source": ["o_custkey", "o_orderkey"]}, "WITH top AS (SELECT o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) SELECT r AS _rank, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 AND o_custkey IN (SELECT o_custkey FROM top)", None, {"_rank": "_rank", "o_custkey": "o_custkey", "o_orderkey": "o_orderkey"})
register("h_rescore", "orders", {"query": {"function_score": {"query": {"match_all": {}}, "functions": [{"field_value_factor": {"field": "o_totalprice"}}]}}, "rescore": {"window_size": 50, "query": {"rescore_query": {"function_score": {"functions": [{"field_value_factor": {"field": "o_custkey"}}]}}, "query_weight": 0, "rescore_query_weight": 1}}, "size": 10, "_source": ["o_orderkey"]}, "SELECT o_orderkey, o_custkey::double AS _score FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) ORDER BY o_custkey DESC, o_orderkey LIMIT 10", None, {"o_orderkey": "o_orderkey", "_score": "_score"})
register("h_total_capped", "lineitem", {"track_total_hits": 1000}, "SELECT 1000 AS value, 'gte' AS relation", "total")
register("h_total_exact", "lineitem", {"track_total_hits": True, "query": {"range": {"l_quantity": {"gt": 25}}}}, "SELECT count(*) AS value, 'eq' AS relation FROM lineitem WHERE l_quantity > 25", "total")
register("h_min_score", "orders", {"query": {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"term": {"o_orderpriority": "1-URGENT"}}]}}, "min_score": 2, "track_total_hits": True}, "SELECT count(*) AS value, 'eq' AS relation FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", "total")
register("h_terminate_after", "lineitem", {"terminate_after": 77, "track_total_hits": True}, "SELECT 77 AS value, 'eq' AS relation", "total")
page("h_source_patterns", "part", {"sort": ["p_partkey"], "size": 5}, "SELECT p_partkey, p_brand FROM part ORDER BY 1 LIMIT 5", ["p_partkey", "p_brand"])
register("h_docvalue_format", "orders", {"sort": ["o_orderkey"], "size": 5, "_source": ["o_orderkey"], "docvalue_fields": [{"field": "o_orderdate", "format": "yyyy/MM/dd"}]}, "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders ORDER BY 1 LIMIT 5", None, {"o_orderkey": "o_orderkey", "fields.o_orderdate": "day"})
page("h_sort_script", "orders", {"sort": [{"_script": {"script": "o_totalprice % 1000", "order": "desc"}}], "size": 7}, "SELECT o_orderkey FROM orders ORDER BY o_totalprice % 1000 DESC, o_orderkey LIMIT 7", ["o_orderkey"])
page("h_sort_geo", "customer", {"sort": [{"_geo_distance": {"at": {"lat": 10.0, "lon": 20.0}, "unit": "km", "order": "asc"}}], "size": 1}, "SELECT c_custkey FROM " + GEO_SQL + " ORDER BY " + HAVERSINE.format("10.0", "20.0") + ", c_custkey LIMIT 1", ["c_custkey"], change=GEO)


def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(index(spark, sf_dir, "orders"), {"range": {"o_orderdate": {"gte": "1997"}}})


QUERIES["h_count"], ORACLE_SQL["h_count"] = _count, "SELECT count(*) AS count FROM orders WHERE o_orderdate >= '1997-01-01'"


def _get(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = index(spark, sf_dir, "orders")
    return Catalog(spark).get(own, 42).select("o_orderkey", "o_totalprice")


QUERIES["s_point_lookup"], ORACLE_SQL["s_point_lookup"] = _get, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42"


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_all([index(spark, sf_dir, "customer"), index(spark, sf_dir, "supplier")], {"size": 0, "aggs": {"i": {"terms": {"field": "_index"}, "aggs": {"a": {"value_count": {"field": "c_custkey"}}, "b": {"value_count": {"field": "s_suppkey"}}}}}})
    return found.aggregations["i"]


QUERIES["h_multi_index"], ORACLE_SQL["h_multi_index"] = _several, "SELECT 'customer' AS i, count(*) AS doc_count, count(*) AS a, 0 AS b FROM customer UNION ALL SELECT 'supplier', count(*), 0, count(*) FROM supplier"

# ---------------------------------------------------------------- pipelines

_MONTHS = "SELECT epoch_ms(date_trunc('month', o_orderdate)) AS m, count(*) AS doc_count, round(sum(o_totalprice), 4) AS s FROM orders GROUP BY 1"


def months(name: str, pipe: dict, sql: str, columns: dict, rounded: tuple = ()) -> None:
    aggs = {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month", "min_doc_count": 1}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}, "x": pipe}}}
    register(name, "orders", {"size": 0, "aggs": aggs}, sql, "m", columns, rounded=rounded)


_X = {"m": "m", "x": "x"}
months("w_cumulative_sum", {"cumulative_sum": {"buckets_path": "_count"}}, f"SELECT m, sum(doc_count) OVER (ORDER BY m)::double AS x FROM ({_MONTHS})", _X)
months("w_derivative", {"derivative": {"buckets_path": "_count"}}, f"SELECT m, (doc_count - lag(doc_count) OVER (ORDER BY m))::double AS x FROM ({_MONTHS})", _X)
months("w_derivative_unit", {"derivative": {"buckets_path": "_count", "unit": "day"}}, f"SELECT m, round((doc_count - lag(doc_count) OVER (ORDER BY m)) / ((m - lag(m) OVER (ORDER BY m)) / 86400000.0), 4) AS x FROM ({_MONTHS})", _X, ("x",))
months("w_serial_diff", {"serial_diff": {"buckets_path": "_count", "lag": 12}}, f"SELECT m, (doc_count - lag(doc_count, 12) OVER (ORDER BY m))::double AS x FROM ({_MONTHS})", _X)
months("w_moving_avg", {"moving_avg": {"buckets_path": "_count", "window": 3}}, f"SELECT m, round(avg(doc_count) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS x FROM ({_MONTHS})", _X, ("x",))
months("w_moving_fn", {"moving_fn": {"buckets_path": "_count", "window": 4, "script": "MovingFunctions.max(values)"}}, f"SELECT m, (max(doc_count) OVER (ORDER BY m ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))::double AS x FROM ({_MONTHS})", _X)
months("w_bucket_sort", {"bucket_sort": {"sort": [{"s": {"order": "desc"}}], "from": 1, "size": 4}}, f"SELECT m, s FROM ({_MONTHS}) ORDER BY s DESC, m LIMIT 4 OFFSET 1", {"m": "m", "s": "s"}, ("s",))
months("w_bucket_script", {"bucket_script": {"buckets_path": {"total": "s", "n": "_count"}, "script": "params.total / params.n"}}, "SELECT epoch_ms(date_trunc('month', o_orderdate)) AS m, round(sum(o_totalprice) / count(*), 4) AS x FROM orders GROUP BY 1", _X, ("x",))
months("w_bucket_selector", {"bucket_selector": {"buckets_path": {"n": "_count"}, "script": "n > 190"}}, f"SELECT m, doc_count FROM ({_MONTHS}) WHERE doc_count > 190", {"m": "m", "doc_count": "doc_count"})


def over_months(name: str, pipe: dict, sql: str, rounded: tuple = (), pick: dict | None = None) -> None:
    aggs = {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month", "min_doc_count": 1}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}}}, "x": pipe}
    register(name, "orders", {"size": 0, "aggs": aggs}, sql, "x", pick, rounded=rounded)


over_months("w_avg_bucket", {"avg_bucket": {"buckets_path": "m>_count"}}, f"SELECT round(avg(doc_count), 4) AS value FROM ({_MONTHS})", ("value",))
over_months("w_sum_bucket", {"sum_bucket": {"buckets_path": "m>_count"}}, f"SELECT sum(doc_count)::double AS value FROM ({_MONTHS})")
over_months("w_max_bucket", {"max_bucket": {"buckets_path": "m>_count"}}, f"SELECT max(doc_count)::double AS value FROM ({_MONTHS})", (), {"value": "value"})
over_months("w_min_bucket", {"min_bucket": {"buckets_path": "m>_count"}}, f"SELECT min(doc_count)::double AS value FROM ({_MONTHS})", (), {"value": "value"})
over_months("w_stats_bucket", {"stats_bucket": {"buckets_path": "m>_count"}}, f"SELECT count(*) AS count, min(doc_count)::double AS min, max(doc_count)::double AS max, round(avg(doc_count), 4) AS avg, sum(doc_count)::double AS sum FROM ({_MONTHS})", ("avg",))
over_months("w_extended_stats_bucket", {"extended_stats_bucket": {"buckets_path": "m>_count"}}, f"SELECT count(*) AS count, min(doc_count)::double AS min, max(doc_count)::double AS max, round(avg(doc_count), 4) AS avg, sum(doc_count)::double AS sum, sum(doc_count * doc_count)::double AS sum_of_squares, round(var_pop(doc_count), 4) AS variance, round(stddev_pop(doc_count), 4) AS std_deviation FROM ({_MONTHS})", ("avg", "variance", "std_deviation"))
over_months("w_percentiles_bucket", {"percentiles_bucket": {"buckets_path": "m>_count", "percents": [50]}}, f"SELECT list_sort(list(doc_count))[floor(0.5 * (count(*) - 1) + 0.5)::int + 1]::double AS p50 FROM ({_MONTHS})", (), {"50.0": "p50"})
register("w_nested_sibling", "orders", {"size": 0, "aggs": {"st": {"terms": {"field": "o_orderstatus"}, "aggs": {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year", "min_doc_count": 1}}, "x": {"avg_bucket": {"buckets_path": "m>_count"}}}}}}, "SELECT o_orderstatus AS st, round(avg(n), 4) AS value FROM (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1", "st>x", rounded=("value",))
register("w_nested_parent", "orders", {"size": 0, "aggs": {"st": {"terms": {"field": "o_orderstatus"}, "aggs": {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year", "min_doc_count": 1}, "aggs": {"x": {"cumulative_sum": {"buckets_path": "_count"}}}}}}}}, "SELECT st, m, sum(n) OVER (PARTITION BY st ORDER BY m)::double AS x FROM (SELECT o_orderstatus AS st, epoch_ms(date_trunc('year', o_orderdate)) AS m, count(*) AS n FROM orders GROUP BY 1, 2)", "st>m", {"st": "st", "m": "m", "x": "x"})

# ---------------------------------------------------------------- vectors

VECTOR = [round(((i * 37) % 17 - 8) / 20, 3) for i in range(64)]
_LITERAL = "[" + ", ".join(f"{x}::double" for x in VECTOR) + "]"


def near(name: str, given: dict, sql: str) -> None:
    register(name, "embeddings", {"knn": {"field": "embedding", "vector": VECTOR, **given}, "size": given["k"], "_source": ["vec_id"]}, sql, None, {"vec_id": "vec_id", "_score": "score"}, rounded=("score",))


_DISTANCE = {"l2": f"list_distance(embedding::double[], {_LITERAL})", "cosine": f"list_cosine_distance(embedding::double[], {_LITERAL})", "dot": f"-list_dot_product(embedding::double[], {_LITERAL})"}
for _metric, _sql in _DISTANCE.items():
    near(f"v_knn_{_metric}", {"k": 10, "metric": _metric}, f"SELECT vec_id, round(1 / (1 + {_sql}), 4) AS score FROM embeddings ORDER BY {_sql}, vec_id LIMIT 10")
near("v_knn_filtered", {"k": 8, "metric": "cosine", "filter": {"term": {"label": 2}}}, f"SELECT vec_id, round(1 / (1 + {_DISTANCE['cosine']}), 4) AS score FROM embeddings WHERE label = 2 ORDER BY {_DISTANCE['cosine']}, vec_id LIMIT 8")
register("v_knn_then_filter", "embeddings", {"query": {"bool": {"must": [{"knn": {"field": "embedding", "vector": VECTOR, "k": 20}}], "filter": [{"term": {"label": 1}}]}}, "size": 20, "_source": ["vec_id"]}, f"SELECT vec_id FROM (SELECT * FROM embeddings ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 20) WHERE label = 1", None, {"vec_id": "vec_id"})
register("v_knn_hits_agg", "embeddings", {"knn": {"field": "embedding", "vector": VECTOR, "k": 50}, "size": 0, "aggs": {"l": {"terms": {"field": "label", "size": 100}}}}, f"SELECT label AS l, count(*) AS doc_count FROM (SELECT * FROM embeddings ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 50) GROUP BY 1", "l")
register("v_knn_hybrid", "embeddings", {"query": {"bool": {"should": [{"knn": {"field": "embedding", "vector": VECTOR, "k": 5}}, {"term": {"label": 3}}]}}, "size": 12, "_source": ["vec_id"]}, f"WITH n AS (SELECT vec_id, 1 / (1 + {_DISTANCE['l2']}) AS s FROM embeddings ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 5) SELECT vec_id, round(coalesce(s, 0) + (label = 3)::int, 4) AS score FROM embeddings LEFT JOIN n USING (vec_id) WHERE s IS NOT NULL OR label = 3 ORDER BY coalesce(s, 0) + (label = 3)::int DESC, vec_id LIMIT 12", None, {"vec_id": "vec_id", "_score": "score"}, rounded=("score",))

# ---------------------------------------------------------------- full text

_TOKENS = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')"


def _bm25(terms: list[str], table: str = "documents") -> tuple[str, str]:
    """CTEs with tokens and statistics, and the score, in SQL."""
    key = KEYS[table]
    counts = ", ".join(f"count(*) FILTER (list_contains(t, '{x}')) AS h{k}" for k, x in enumerate(terms))
    ctes = f"d AS (SELECT {key}, text, {_TOKENS} AS t FROM {table}), s AS (SELECT count(text) AS n, avg(len(t)) FILTER (text IS NOT NULL) AS a, {counts} FROM d)"
    score = " + ".join(f"ln(1 + (n - h{k} + 0.5) / (h{k} + 0.5)) * (len(list_filter(t, lambda w: w = '{x}')) * 2.2) / (len(list_filter(t, lambda w: w = '{x}')) + 1.2 * (0.25 + 0.75 * len(t) / a))" for k, x in enumerate(terms))
    return ctes, score


def text(name: str, query: dict, terms: list[str], where: str, score: str | None = None, table: str = "documents", size: int = 25) -> None:
    ctes, own = _bm25(terms, table)
    key = KEYS[table]
    register(name, table, {"query": query, "size": size, "_source": [key]}, f"WITH {ctes} SELECT {key}, round({score or own}, 4) AS score FROM d, s WHERE {where} ORDER BY {score or own} DESC, {key} LIMIT {size}", None, {key: key, "_score": "score"}, rounded=("score",))


_HAS = "list_contains(t, '{}')".format
text("f_match_or", {"match": {"text": "worthless idiot"}}, ["worthless", "idiot"], f"{_HAS('worthless')} OR {_HAS('idiot')}")
text("f_match_and", {"match": {"text": {"query": "the idiot", "operator": "AND"}}}, ["the", "idiot"], f"{_HAS('the')} AND {_HAS('idiot')}")
text("f_match_benchmark", {"match": {"text": {"query": "that was", "boost": 2.0}}}, ["that", "was"], f"{_HAS('that')} OR {_HAS('was')}", "2 * (" + _bm25(["that", "was"], "benchmark")[1] + ")", "benchmark")
text("f_bool_filter", {"bool": {"must": [{"match": {"text": "idiot clown"}}], "filter": [{"exists": {"field": "text"}}], "must_not": [{"match": {"text": "worthless"}}]}}, ["idiot", "clown"], f"({_HAS('idiot')} OR {_HAS('clown')}) AND NOT {_HAS('worthless')}")
text("f_boost", {"fts_boost": {"positive": {"match": {"text": "idiot"}}, "negative": {"match": {"text": "clown"}}, "negative_boost": 0.5}}, ["idiot"], _HAS("idiot"), "(" + _bm25(["idiot"])[1] + f") * CASE WHEN {_HAS('clown')} THEN 0.5 ELSE 1.0 END")
text("f_constant", {"constant_score": {"filter": {"match": {"text": "idiot"}}, "boost": 3}}, ["idiot"], _HAS("idiot"), "(3.0::double + 0 * len(t))")


def _phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.query import translate

    own = index(spark, sf_dir, "documents")
    return own.df.where(translate(own, {"match_phrase": {"text": "and the"}}).pred).select("doc_id")


QUERIES["f_phrase"], ORACLE_SQL["f_phrase"] = _phrase, f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE len(list_filter(list_zip(t[:-2], t[2:]), lambda p: p[1] = 'and' AND p[2] = 'the')) > 0"


def _slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.query import translate

    own = index(spark, sf_dir, "documents")
    return own.df.where(translate(own, {"match_phrase": {"text": {"query": "by from", "slop": 2}}}).pred).select("doc_id")


QUERIES["f_phrase_slop"], ORACLE_SQL["f_phrase_slop"] = _slop, f"SELECT DISTINCT a.doc_id FROM (SELECT doc_id, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) AS p FROM documents) a JOIN (SELECT doc_id, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) AS p FROM documents) b ON a.doc_id = b.doc_id AND a.w = 'by' AND b.w = 'from' AND b.p > a.p AND b.p - a.p - 1 <= 2"
rows("f_wildcard_text", "documents", {"wildcard": {"text": {"value": "*MIT License*"}}}, "text LIKE '%MIT License%'")
text("f_multi_match", {"multi_match": {"query": "idiot", "fields": ["text^2", "lang"]}}, ["idiot"], _HAS("idiot"), "2 * (" + _bm25(["idiot"])[1] + ")", size=10)
text("f_fts_bool", {"fts_bool": {"must": [{"match": {"text": "idiot"}}], "should": [{"match": {"text": "clown"}}], "must_not": [{"match": {"text": "worthless"}}]}}, ["idiot", "clown"], f"{_HAS('idiot')} AND NOT {_HAS('worthless')}")


def _fuzzy(name: str, word: str, given: dict, distance: int, prefix: int) -> None:
    """Every term within the distance counts: the 50 that are closest, then most frequent, and the word itself."""
    near = f"levenshtein(w, '{word}') <= {distance} AND left(w, {prefix}) = '{word[:prefix]}'"
    sql = f"""WITH d AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents), s AS (SELECT count(text) AS n, avg(len(t)) FILTER (text IS NOT NULL) AS a FROM d),
        x AS (SELECT w FROM (SELECT unnest(list_distinct(t)) AS w FROM d) WHERE {near} GROUP BY w ORDER BY levenshtein(w, '{word}'), count(*) DESC, w LIMIT 50),
        terms AS (SELECT w FROM x UNION SELECT '{word}'),
        f AS (SELECT doc_id, w, len(any_value(t)) AS l, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS w FROM d) SEMI JOIN terms USING (w) GROUP BY 1, 2),
        h AS (SELECT w, count(*) AS h FROM f GROUP BY 1)
        SELECT doc_id, round(sum(ln(1 + (n - h + 0.5) / (h + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * l / a))), 4) AS score FROM f JOIN h USING (w), s GROUP BY 1"""
    register(name, "documents", {"query": {"match": {"text": {"query": word, **given}}}, "size": None, "_source": ["doc_id"]}, sql, None, {"doc_id": "doc_id", "_score": "score"}, rounded=("score",))


_fuzzy("f_fuzzy", "idoit", {"fuzziness": 2, "prefix_length": 1}, 2, 1)
_fuzzy("f_fuzzy_auto", "clwn", {"fuzziness": "AUTO", "prefix_length": 2}, 1, 2)


def _tokenised(name: str, given: dict, query: str, tokens: str) -> None:
    sql = f"WITH d AS (SELECT doc_id, {tokens} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (list_contains(t, '{query}')) AS h FROM d) SELECT doc_id, round(ln(1 + (n - h + 0.5) / (h + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * l / a)), 4) AS score FROM (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda w: w = '{query}')) AS f FROM d) , s WHERE f > 0"
    register(name, "documents", {"query": {"match": {"text": query}}, "size": None, "_source": ["doc_id"]}, sql, None, {"doc_id": "doc_id", "_score": "score"}, overrides={"text": {"type": "text", **given}}, rounded=("score",))


_tokenised("f_tokens_whitespace", {"tokenizer": "whitespace"}, "License.", "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')")
_tokenised("f_tokens_raw", {"tokenizer": "raw"}, "the", "[text]")
_tokenised("f_tokens_ngram", {"tokenizer": "ngram", "n": 5, "lower": True}, "idiot", "[substring(lower(text), i, 5) for i in range(1, len(text) - 3)]")

# ---------------------------------------------------------------- scores


def scores(name: str, table: str, query: dict, score: str, where: str = "true", size: int = 40) -> None:
    key = KEYS[table]
    register(name, table, {"query": query, "size": size, "_source": [key]}, f"SELECT {key}, {key}::varchar AS id, round({score}, 4) AS score FROM {table} WHERE {where} ORDER BY {score} DESC, {key} LIMIT {size}", None, {key: key, "_id": "id", "_score": "score"}, rounded=("score",))


_P, _H = "(o_orderstatus = 'P')::int", "(o_orderpriority = '2-HIGH')::int"
scores("q_constant_score_score", "orders", {"constant_score": {"filter": {"term": {"o_orderstatus": "P"}}, "boost": 2}}, "2.0::double", "o_orderstatus = 'P'")
scores("q_dis_max_score", "orders", {"dis_max": {"queries": [{"term": {"o_orderstatus": {"value": "P", "boost": 2}}}, {"term": {"o_orderpriority": "2-HIGH"}}], "tie_breaker": 0.5}}, f"(greatest(2 * {_P}, {_H}) + 0.5 * least(2 * {_P}, {_H}))::double", "o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'", 3000)
scores("q_boosting_score", "orders", {"boosting": {"positive": {"term": {"o_orderstatus": "P"}}, "negative": {"term": {"o_orderpriority": "2-HIGH"}}, "negative_boost": 0.2}}, "CASE WHEN o_orderpriority = '2-HIGH' THEN 0.2 ELSE 1.0 END::double", "o_orderstatus = 'P'", 3000)
scores("q_function_score_decay", "orders", {"function_score": {"gauss": {"o_totalprice": {"origin": 100000, "scale": 50000, "offset": 1000, "decay": 0.4}}}}, "exp(pow(greatest(0, abs(o_totalprice - 100000) - 1000), 2) * ln(0.4) / 2500000000.0)", size=3000)
scores("q_function_score_dates", "orders", {"function_score": {"exp": {"o_orderdate": {"origin": "1997-01-01", "scale": "30d"}}}}, "exp(abs(epoch_ms(o_orderdate) - 852076800000) * ln(0.5) / 2592000000.0)", size=3000)
scores("q_function_score_modes", "orders", {"function_score": {"functions": [{"filter": {"term": {"o_orderstatus": "P"}}, "weight": 3}, {"filter": {"term": {"o_orderpriority": "2-HIGH"}}, "weight": 5}], "score_mode": "sum", "boost_mode": "replace", "max_boost": 7}}, f"least(7.0, CASE WHEN {_P} + {_H} = 0 THEN 1 ELSE 3 * {_P} + 5 * {_H} END)::double", size=3000)
scores("q_script_score", "orders", {"script_score": {"query": {"term": {"o_orderstatus": "F"}}, "script": {"source": "o_totalprice / :x", "params": {"x": 1000}}}}, "o_totalprice / 1000", "o_orderstatus = 'F'")
register("h_max_score", "orders", {"query": {"bool": {"should": [{"term": {"o_orderstatus": {"value": "P", "boost": 2}}}, {"term": {"o_orderpriority": "2-HIGH"}}]}}}, f"SELECT max(2 * {_P} + {_H})::double AS max_score FROM orders", "max_score")
_HAMMING = f"list_sum([(embedding[i] <> ({_LITERAL})[i])::int for i in range(1, 65)])"
near("v_knn_hamming", {"k": 10, "metric": "hamming"}, f"SELECT vec_id, round(1 / (1 + {_HAMMING}), 4) AS score FROM embeddings ORDER BY {_HAMMING}, vec_id LIMIT 10")

# ---------------------------------------------------------------- more buckets

_DAY = 86_400_000
buckets("b_date_histogram_zone", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "time_zone": "Europe/Berlin"}}}, "d", f"WITH g AS (SELECT (epoch_ms(ts) + 3600000) // {_DAY} AS o, count(*) AS n FROM events GROUP BY 1), e AS (SELECT unnest(range(min(o), max(o) + 1)) AS o FROM g) SELECT o * {_DAY} - 3600000 AS d, coalesce(n, 0) AS doc_count FROM e LEFT JOIN g USING (o)")
buckets("b_date_histogram_hard_bounds", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "hard_bounds": {"min": "2024-01-05", "max": "2024-01-08"}}}}, "d", "SELECT epoch_ms(date_trunc('day', ts)) AS d, count(*) AS doc_count FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-08' GROUP BY 1")
buckets("b_date_histogram_extended", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "extended_bounds": {"min": "2023-12-28", "max": "2024-02-03||+1d"}}}}, "d", "SELECT epoch_ms(d) AS d, count(event_id) AS doc_count FROM (SELECT unnest(generate_series('2023-12-28'::timestamp, '2024-02-04'::timestamp, INTERVAL 1 DAY)) AS d) LEFT JOIN events ON date_trunc('day', ts) = d GROUP BY 1")
buckets("b_terms_other", "orders", {"c": {"terms": {"field": "o_custkey", "size": 7}}}, "c:other", "SELECT (sum(n) - sum(n) FILTER (r <= 7))::bigint AS sum_other_doc_count, 0::bigint AS doc_count_error_upper_bound FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey)")
buckets("b_terms_other_under_terms", "lineitem", {"f": {"terms": {"field": "l_returnflag"}, "aggs": {"n": {"terms": {"field": "l_linenumber", "size": 2}}}}}, "f>n:other", "SELECT f, (sum(n) - sum(n) FILTER (r <= 2))::bigint AS sum_other_doc_count, 0::bigint AS doc_count_error_upper_bound FROM (SELECT l_returnflag AS f, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY 1")
buckets("b_terms_min_zero", "orders", {"p": {"terms": {"field": "o_orderpriority", "min_doc_count": 0}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}}}}, "p", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderkey = 5) AS doc_count, round(coalesce(sum(o_totalprice) FILTER (o_orderkey = 5), 0), 4) AS s FROM orders GROUP BY 1", ("s",), query={"ids": {"values": [5]}})
buckets("b_filter_under_terms_empty", "orders", {"p": {"terms": {"field": "o_orderpriority"}, "aggs": {"f": {"filter": {"term": {"o_orderpriority": "2-HIGH"}}, "aggs": {"s": {"sum": {"field": "o_totalprice"}}}}}}}, "p>f", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderpriority = '2-HIGH') AS doc_count, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 0), 4) AS s FROM orders GROUP BY 1", ("s",))
buckets("b_missing_under_terms", "customer", {"n": {"terms": {"field": "c_nationkey", "size": 30}, "aggs": {"m": {"missing": {"field": "c_acctbal"}}}}}, "n>m", f"SELECT c_nationkey AS n, count(*) FILTER (c_acctbal IS NULL) AS doc_count FROM {NULLED_SQL} GROUP BY 1", change=NULLED)
buckets("b_multi_terms_separator", "part", {"k": {"multi_terms": {"terms": [{"field": "a"}, {"field": "b"}], "size": 50}}}, "k", "SELECT replace(p_brand || '|' || p_type, '|', '\\|') || '|' || replace(p_type || '|', '|', '\\|') AS k, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", change=lambda df: df.withColumn("a", F.concat_ws("|", "p_brand", "p_type")).withColumn("b", F.concat("p_type", F.lit("|"))))


def _missing_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"sources": [{"s": {"terms": {"field": "c_mktsegment", "missing_bucket": True}}}, {"h": {"histogram": {"field": "c_acctbal", "interval": 2000}}}], "size": 9}
    return search(index(spark, sf_dir, "customer", change=NULLED), {"size": 0, "aggs": {"c": {"composite": body}}}).aggregations["c"].select("c.*", "doc_count")


QUERIES["b_composite_missing_bucket"], ORACLE_SQL["b_composite_missing_bucket"] = _missing_bucket, f"SELECT c_mktsegment AS s, floor(c_acctbal / 2000) * 2000 AS h, count(*) AS doc_count FROM {NULLED_SQL} WHERE c_acctbal IS NOT NULL GROUP BY 1, 2 ORDER BY 1 NULLS FIRST, 2 LIMIT 9"

# ---------------------------------------------------------------- the catalog


def _several_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark).get(index(spark, sf_dir, "orders"), [42, 7, 7, -1]).select("o_orderkey", "o_totalprice")


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.commit("t", 1, f"{sf_dir}/customer.parquet")
    catalog.commit("t", 2, f"{sf_dir}/supplier.parquet", tag="now")
    by_version, by_tag = catalog.attach("old", "t", version=1).df, catalog.attach("new", "t", tag="now").df
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(by_version, "old").union(count(by_tag, "new")).union(count(catalog.refs("t"), "refs"))


QUERIES["s_multi_get"], ORACLE_SQL["s_multi_get"] = _several_keys, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (42, 7)"
QUERIES["s_pinned_versions"], ORACLE_SQL["s_pinned_versions"] = _pinned, "SELECT 'old' AS name, count(*) AS n FROM customer UNION ALL SELECT 'new', count(*) FROM supplier UNION ALL SELECT 'refs', 3"
