"""Semantics that the test tables don't show: nulls, refusals, literals, cursors, explain, catalog."""

from datetime import datetime

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from brindle.errors import Refused
from brindle.functions import dates
from brindle.operators.query import translate
from brindle.plans.queries import ORACLE_SQL, QUERIES
from brindle.plans.search import explain, search
from brindle.sources.catalog import Catalog, Index


@pytest.fixture(scope="module")
def hint(spark):
    rows = [(i, f"text {i}", None if i % 5 == 4 else i * 37 % 1000, None if i % 4 == 3 else f"c{i % 3}", None if i % 6 == 5 else [f"t{i % 2}", f"t{i % 5}"], i % 3 == 0 if i % 7 else None, datetime(2024, 1 + i % 6, 15), float(i) + 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, body string, rating int, category string, tags array<string>, flag boolean, ts timestamp_ntz, price float")
    return Index("hint", df, "id", ("id",), {"body": {"type": "text", "fields": ["raw"]}})


def ids(index, query):
    return sorted(r["id"] for r in index.df.where(translate(index, query).pred).collect())


def test_must_not_keeps_nulls(hint):
    assert len(ids(hint, {"bool": {"must_not": [{"term": {"category": "c0"}}]}})) == 40 - len(ids(hint, {"term": {"category": "c0"}}))
    assert set(ids(hint, {"bool": {"must_not": [{"range": {"rating": {"gte": 0}}}]}})) == {i for i in range(40) if i % 5 == 4}


def test_multi_valued(hint):
    assert ids(hint, {"term": {"tags": "t4"}}) == [i for i in range(40) if i % 6 != 5 and i % 5 == 4]
    found = search(hint, {"size": 0, "aggs": {"t": {"terms": {"field": "tags"}}}}).aggregations["t"]
    assert {r["t"]: r["doc_count"] for r in found.collect()}["t0"] == sum(1 for i in range(40) if i % 6 != 5 and (i % 2 == 0 or i % 5 == 0))


def test_float_literal_is_single_precision(hint):
    assert ids(hint, {"term": {"price": 3.1}}) == [3]


def test_boolean_and_sub_field(hint):
    assert ids(hint, {"term": {"flag": "true"}}) == [i for i in range(40) if i % 7 and i % 3 == 0]
    assert ids(hint, {"term": {"body.raw": "text 7"}}) == [7]
    assert search(hint, {"size": 0, "aggs": {"f": {"terms": {"field": "flag"}}}}).aggregations["f"].count() == 2


def test_null_keys_count_in_the_parent_only(hint):
    out = search(hint, {"size": 0, "track_total_hits": True, "aggs": {"c": {"terms": {"field": "category"}}}})
    assert out.total.first()["value"] == 40
    assert sum(r["doc_count"] for r in out.aggregations["c"].collect()) == 30


def test_floor_of_negative_keys(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-250, -201, -200, -101, -1, 0, 1, 99, 100, 250])], "id int, v bigint")
    out = search(Index("v", df, "id", ("id",)), {"size": 0, "aggs": {"h": {"histogram": {"field": "v", "interval": 100}}}}).aggregations["h"]
    assert {r["h"]: r["doc_count"] for r in out.collect()} == {-300.0: 2, -200.0: 2, -100.0: 1, 0.0: 3, 100.0: 1, 200.0: 1}


def test_empty_table(spark, hint):
    none = Index("none", hint.df.limit(0), "id", ("id",), {"body": {"type": "text"}})
    out = search(none, {"query": {"match": {"body": "text"}}, "aggs": {"s": {"sum": {"field": "rating"}}, "h": {"histogram": {"field": "rating", "interval": 5}}, "r": {"range": {"field": "rating", "ranges": [{"to": 5}]}}}})
    assert out.hits.count() == 0 and out.aggregations["h"].count() == 0
    assert out.aggregations[""].first()["s"] == 0.0
    assert out.aggregations["r"].first()["doc_count"] == 0


def test_nested_is_joint(spark):
    df = spark.createDataFrame([(0, [("red", 1), ("blue", 9)]), (1, [("red", 9)]), (2, []), (3, None), (4, [None])], "id int, items array<struct<color:string,qty:int>>")
    index = Index("n", df, "id", ("id",))
    both = {"bool": {"filter": [{"term": {"items.color": "red"}}, {"range": {"items.qty": {"gt": 5}}}]}}
    assert ids(index, {"nested": {"path": "items", "query": both}}) == [1]
    with pytest.raises(Refused):
        translate(index, {"term": {"items.color": "red"}})


@pytest.mark.parametrize(
    "query",
    [{"intervals": {}}, {"span_term": {}}, {"more_like_this": {}}, {"has_child": {}}, {"unheard_of": {}}, {"regexp": {"category": "a&b"}}, {"regexp": {"category": "(?=a)b"}}, {"regexp": {"category": "<1-9>"}}, {"term": {"rating": 1.5}}, {"term": {"rating": "x"}}, {"range": {"ts": {"gte": "yesterday"}}}, {"function_score": {"min_score": 1}}, {"bool": {"must_not": [{"match_all": {}}], "adjust_pure_negative": False}}, {"match": {"body": {"query": "x", "analyzer": "y"}}}, {"prefix": {"rating": "1"}}],
)
def test_refused_queries(hint, query):
    with pytest.raises(Refused):
        translate(hint, query)


@pytest.mark.parametrize(
    "body",
    [{"suggest": {}}, {"highlight": {}}, {"nonsense": 1}, {"search_after": [1]}, {"sort": ["_score"], "search_after": [1.0]}, {"sort": [{"_score": "asc"}]}, {"sort": ["_id"]}, {"sort": ["nothing"]}, {"size": -1}, {"rescore": {"query": {"rescore_query": {"match_all": {}}}}, "sort": ["id"]}, {"sort": ["id", "rating"], "search_after": [1]}, {"knn": {"field": "rating", "vector": [1.0], "k": 1}}, {"knn": {"field": "nope", "vector": [1.0], "k": 1}}, {"knn": {"field": "x", "vector": [1.0], "k": 0}}, {"knn": {"field": "x", "vector": [1.0], "k": 1, "metric": "l3"}},
     *({"size": 0, "aggs": {"a": {k: {}}}} for k in ("global", "rare_terms", "significant_terms", "significant_text", "top_hits", "unheard"))],
)
def test_refused_bodies(hint, body):
    with pytest.raises(Refused):
        search(hint, body)
    assert "refused" in explain(hint, body)


def test_refusals_of_buckets(hint):
    for aggs in ({"a": {"terms": {"field": "nothing"}}}, {"a": {"date_histogram": {"field": "ts", "calendar_interval": "fortnight"}}}, {"a": {"date_histogram": {"field": "rating", "fixed_interval": "1d"}}}, {"a": {"histogram": {"field": "rating", "interval": 0}}}, {"a": {"cumulative_sum": {"buckets_path": "_count"}}}, {"a": {"avg_bucket": {"buckets_path": "x>y"}}}, {"a": {"percentiles": {"field": "rating", "percents": [101]}}}):
        with pytest.raises(Refused):
            search(hint, {"size": 0, "aggs": aggs})


def test_date_literals():
    day = 86_400_000
    assert dates.interval("1970-01-02") == (day, 2 * day - 1)
    assert dates.interval("1970") == (0, 365 * day - 1)
    assert dates.interval("1970-01-01T00:00:01.500Z") == (1500, 1500)
    assert dates.interval("1970-01-01", time_zone="-01:00")[0] == 3_600_000
    assert dates.interval("1970-01-15||+1M/M") == (31 * day, 59 * day - 1)
    assert dates.interval("now/d", now=datetime(1970, 1, 3, 5)) [0] in (2 * day, 2 * day - day, 2 * day + day)
    assert dates.interval("86400", format="epoch_second") == (day, day)
    assert dates.interval(5) == (5, 5)


def test_date_override_and_types(spark):
    df = spark.createDataFrame([(0, 0), (1, 86_400_000), (2, None)], "id int, ms bigint").withColumn("d", F.date_from_unix_date(F.col("id")))
    index = Index("e", df, "id", ("id",), {"ms": {"type": "date"}})
    assert ids(index, {"range": {"ms": {"gte": "1970-01-02"}}}) == [1]
    assert ids(index, {"range": {"d": {"gt": "1970-01-01", "lte": "1970-01-02"}}}) == [1]
    assert ids(index, {"term": {"d": "1970-01-03"}}) == [2]
    with pytest.raises(Refused):
        Index("bad", df, "id", ("id",), {"d": {"type": "ip"}})


def test_month_in_a_time_zone(spark):
    df = spark.createDataFrame([(0, datetime(2024, 1, 31, 23, 30))], "id int, ts timestamp_ntz")
    index = Index("z", df, "id", ("id",))
    out = search(index, {"size": 0, "aggs": {"m": {"date_histogram": {"field": "ts", "calendar_interval": "month", "time_zone": "Europe/Berlin"}}}}).aggregations["m"]
    assert out.first()["m"] == dates.interval("2024-02-01", time_zone="Europe/Berlin")[0]


def test_days_over_a_change_of_clocks(spark):
    # 2024-03-31 has 23 hours in Berlin; days without rows are there too, and keys are instants
    df = spark.createDataFrame([(0, datetime(2024, 3, 30, 12)), (1, datetime(2024, 3, 31, 22, 30)), (2, datetime(2024, 4, 2, 1))], "id int, ts timestamp_ntz")
    body = {"field": "ts", "calendar_interval": "day", "time_zone": "Europe/Berlin"}
    run = lambda more: [(r["d"], r["doc_count"]) for r in search(Index("z", df, "id", ("id",)), {"size": 0, "aggs": {"d": {"date_histogram": body | more}}}).aggregations["d"].orderBy("d").collect()]
    day = lambda x: dates.interval(x, time_zone="Europe/Berlin")[0]
    assert run({}) == [(day("2024-03-30"), 1), (day("2024-03-31"), 0), (day("2024-04-01"), 1), (day("2024-04-02"), 1)]
    assert run({"hard_bounds": {"min": "2024-03-31", "max": "2024-04-02"}}) == [(day("2024-04-01"), 1)]
    assert run({"extended_bounds": {"min": "2024-03-29", "max": "2024-04-03"}})[0] == (day("2024-03-29"), 0)


def test_buckets_that_are_not_shown(hint):
    out = search(hint, {"size": 0, "query": {"range": {"id": {"lt": 9}}}, "aggs": {"c": {"terms": {"field": "category", "size": 1}, "aggs": {"t": {"terms": {"field": "flag", "size": 1}}, "none": {"filter": {"range": {"id": {"gte": 7}}}}, "gone": {"missing": {"field": "rating"}}}}}}).aggregations
    shown = {r["c"]: r["doc_count"] for r in out["c"].collect()}
    every = {c: sum(i % 3 == int(c[1]) and i % 4 != 3 for i in range(9)) for c in ("c0", "c1", "c2")}
    assert len(shown) == 1 and out["c:other"].first()["sum_other_doc_count"] == sum(every.values()) - sum(shown.values()) and out["c:other"].first()["doc_count_error_upper_bound"] == 0
    assert out["c>t:other"].count() == 1
    # parents without a row in a bucket have it empty
    assert out["c>none"].count() == 1 and out["c>gone"].count() == 1
    many = search(hint, {"size": 0, "query": {"ids": {"values": [0]}}, "aggs": {"c": {"terms": {"field": "category", "min_doc_count": 0}}}}).aggregations["c"]
    assert {r["c"]: r["doc_count"] for r in many.collect()} == {"c0": 1, "c1": 0, "c2": 0}


def test_hits_have_ids_and_a_maximal_score(hint):
    out = search(hint, {"query": {"constant_score": {"filter": {"range": {"id": {"gte": 3, "lt": 5}}}, "boost": 2.5}}})
    assert sorted(r["_id"] for r in out.hits.collect()) == ["3", "4"] and out.max_score.first()["max_score"] == 2.5
    assert search(hint, {"sort": ["id"]}).max_score.first()["max_score"] is None
    assert search(hint, {"stored_fields": "_none_"}).hits.columns == ["_id", "_score", "_sort_0"]
    for k in ("explain", "profile", "version", "timeout"):
        with pytest.raises(Refused):
            search(hint, {k: "1s" if k == "timeout" else True})


def test_keys_with_the_separator(spark):
    df = spark.createDataFrame([(0, "a|b", "c", 1), (1, "a", "b|c", 1), (2, "a\\\\", "b", 2)], "id int, x string, y string, event_value int")
    index = Index("m", df, "id", ("id",))
    out = search(index, {"size": 0, "aggs": {"k": {"multi_terms": {"terms": [{"field": "x"}, {"field": "y"}]}}, "s": {"scripted_metric": {"map_script": "event_value * 2", "combine_script": "sum(value) + max(event_value)"}}}})
    assert out.aggregations["k"].count() == 3 and out.aggregations[""].first()["s"] == 10


def test_vectors_of_another_length_are_refused(spark):
    index = Index("v", spark.createDataFrame([(0, [1.0, 2.0])], "id int, v array<float>"), "id", ("id",))
    with pytest.raises(Refused):
        search(index, {"knn": {"field": "v", "vector": [1.0], "k": 1}})
    assert search(index, {"knn": {"field": "v", "vector": [1.0, 3.0], "k": 1, "metric": "hamming"}}).hits.first()["_score"] == 0.5


def test_paging_covers_everything_once(hint):
    seen, cursor = [], None
    while True:
        body = {"sort": [{"rating": "desc"}, {"id": "asc"}], "size": 7, "_source": ["id", "rating"]}
        page = search(hint, body | ({"search_after": cursor} if cursor else {})).hits.collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        cursor = [page[-1]["rating"], page[-1]["id"]]
    assert seen == sorted(range(40), key=lambda i: (i % 5 == 4, -(i * 37 % 1000) if i % 5 != 4 else 0, i))


def test_composite_pages_cover_everything_once(hint):
    seen, after = [], None
    while True:
        body = {"sources": [{"c": {"terms": {"field": "category", "missing_bucket": True}}}, {"f": {"terms": {"field": "flag"}}}], "size": 2}
        page = search(hint, {"size": 0, "aggs": {"p": {"composite": body | ({"after": after} if after else {})}}}).aggregations["p"].collect()
        if not page:
            break
        seen += [(tuple(r["p"]), r["doc_count"]) for r in page]
        after = page[-1]["p"].asDict()
    assert len(seen) == len({k for k, _ in seen}) == 5 and sum(n for _, n in seen) == sum(1 for i in range(40) if i % 7)


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark)
    catalog.discover(f"{DATA}/sf0.001", {"orders": ("o_orderkey",)})
    orders = catalog.indexes["orders"]
    assert catalog.get(orders, 3).count() == 1 and orders.mapping()["o_orderdate"] == "date"
    with pytest.raises(Refused):
        catalog.get(catalog.indexes["lineitem"], 1)
    for v in (1, 2):
        spark.range(v).write.parquet(f"{tmp_path}/{v}")
        catalog.commit("t", v, f"{tmp_path}/{v}", tag=f"v{v}")
    assert catalog.attach("one", "t", version=1).df.count() == 1
    assert catalog.attach("two", "t", tag="v2").df.count() == 2
    with pytest.raises(Refused):
        catalog.attach("three", "t", version=3)
    assert catalog.refs("t").count() == 4 and catalog.stats().count() > 3
    assert catalog.refresh("orders").df.count() == orders.df.count()
    # a tag is followed, a pinned version stays
    catalog.commit("t", 1, f"{tmp_path}/1", tag="v2")
    assert catalog.refresh("two").df.count() == 1 and catalog.refresh("one").df.count() == 1
    assert sorted(r["o_orderkey"] for r in catalog.get(orders, [3, 5, -1]).collect()) == [3, 5]


def test_filters_and_columns_reach_the_scan(spark):
    catalog = Catalog(spark)
    orders = catalog.attach("orders", f"{DATA}/sf0.001/orders.parquet", "o_orderkey", ("o_orderkey",))
    plan = explain(orders, {"query": {"range": {"o_orderdate": {"gte": "1997-01-01"}}}, "size": 0, "aggs": {"s": {"terms": {"field": "o_orderstatus"}}}})["aggregation s"]
    assert "GreaterThanOrEqual(o_orderdate" in plan
    read = plan.split("ReadSchema: struct<")[-1].split(">")[0]
    assert "o_totalprice" not in read and "o_custkey" not in read


def test_all_buckets_of_terms(spark, duck, tmp_path):
    """A size of None cuts nothing, whatever the number of buckets; the query that asks for it gives all rows of its SQL."""
    orders = spark.range(10_050 * 15 + 14).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 15).alias("o_custkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["b_terms_min_doc_count"](spark, str(tmp_path)).collect()
    want = duck.execute(ORACLE_SQL["b_terms_min_doc_count"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 10_050
    found = search(Index("o", orders, "o_orderkey", ("o_orderkey",)), {"size": 0, "aggs": {"c": {"terms": {"field": "o_custkey", "size": None}}}}).aggregations
    assert found["c"].count() == 10_051 and found["c:other"].first()["sum_other_doc_count"] == 0


def all_hits(spark, duck, folder, name):
    """A registered query over more texts than its page had, against its SQL."""
    texts = [f"idiot clown {'License. ' * (i % 3 + 1)}{'w ' * (i % 5)}" if i % 40 else "the" if i % 80 else None for i in range(5_300)]
    texts = [x or "none of it" for x in texts] if "tokens" in name else texts
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = QUERIES[name](spark, str(folder))
    want = duck.execute(ORACLE_SQL[name].replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'")).fetchall()
    same([(r["doc_id"], r["score"]) for r in got.collect()], want)
    return len(want)


@pytest.mark.parametrize("name", ["f_fuzzy", "f_fuzzy_auto", "f_tokens_whitespace", "f_tokens_ngram"])
def test_all_hits_of_a_text_query(name, spark, duck, tmp_path):
    assert all_hits(spark, duck, tmp_path, name) > 5_000


def test_a_size_of_none_cuts_no_hits(hint):
    assert search(hint, {"size": None}).hits.count() == 40
    assert [r["id"] for r in search(hint, {"size": None, "from": 5, "sort": [{"id": "desc"}]}).hits.collect()] == list(range(34, -1, -1))


@pytest.mark.parametrize("n", [1, 3, 5])
def test_ngrams_take_linear_time(n, spark):
    """All stretches of n characters, also beyond the basic plane and over line ends; a long text costs no more for each of them than a short one."""
    import time

    from brindle.functions.text import count_tokens, tokens

    texts = ["", "ab", "Abc\r\n\u2028d\U0001f600\U0001f601éf\U00010400", "xyz" * 5, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else [t.lower()[i : i + n] for i in range(len(t) - n + 1)] for t in texts]
    assert [tuple(r) for r in df.select(tokens(F.col("t"), "ngram", True, n), count_tokens(F.col("t"), "ngram", True, n)).collect()] == [(w, None if w is None else len(w)) for w in want]
    start = time.time()
    long = spark.range(1).select(F.repeat(F.lit("Aé "), 200_000).alias("t"))
    assert long.select(F.size(tokens(F.col("t"), "ngram", True, n))).first()[0] == 600_000 - n + 1 and time.time() - start < 30


def test_exact_percentiles_sort_only_the_parts_that_hold_the_ranks(spark):
    """The same values as sorted lists give, with ties, negative numbers, infinities, nulls and groups without values; no task holds a map of all values."""
    import math
    import random

    r = random.Random(5)
    draw = {"a": lambda: r.gauss(0, 1e6), "b": lambda: float(r.randrange(-3, 4)), "c": lambda: None, "d": lambda: r.choice([-math.inf, math.inf, 1e300, 5e-324, 0.0]), "e": lambda: 7.25 + r.random() * 1e-9}
    rows = [(i, g, draw[g]()) for i, g in enumerate(r.choices("abcde", k=12_000))] + [(12_000, "f", 3.5)]
    index = Index("p", spark.createDataFrame(rows, "id int, g string, v double").repartition(3), "id", ("id",))
    percents = [0, 0.1, 33.3, 50, 99.9, 100]
    aggs = {"p": {"percentiles": {"field": "v", "percents": percents, "exact": True}}, "m": {"median_absolute_deviation": {"field": "v"}}, "n": {"value_count": {"field": "v"}}}

    def at(values, share):
        values = sorted(values)
        k = (len(values) - 1) * share
        low, high = values[math.floor(k)], values[math.ceil(k)]
        return low if low == high else (math.ceil(k) - k) * low + (k - math.floor(k)) * high

    def wanted(values):
        if not values:
            return [None] * len(percents) + [None, 0]
        middle = at(values, 0.5)
        away = [abs(v - middle) for v in values]
        return [at(values, p / 100) for p in percents] + [None if any(math.isnan(x) for x in away) else at(away, 0.5), len(values)]

    fields = [f"p.{float(p)}" for p in percents] + ["m", "n"]
    got = {x["g"]: [x[f] for f in fields] for x in search(index, {"size": 0, "aggs": {"g": {"terms": {"field": "g"}, "aggs": aggs}}}).aggregations["g"].collect()}
    want = {g: wanted([v for _, h, v in rows if h == g and v is not None]) for g in "abcdef"}
    got["d"][-2], want["d"][-2] = None, None
    same([(g, *v) for g, v in got.items()], [(g, *v) for g, v in want.items()])
    finite = Index("p", index.df.where("g <> 'd'"), "id", ("id",))
    found = search(finite, {"size": 0, "aggs": aggs}).aggregations[""]
    same([tuple(found.first()[f] for f in fields)], [tuple(wanted([v for _, h, v in rows if h != "d" and v is not None]))])
    assert "percentile(" not in found._jdf.queryExecution().toString()
    empty = search(Index("p", index.df.limit(0), "id", ("id",)), {"size": 0, "aggs": aggs}).aggregations[""].collect()
    assert [tuple(x[f] for f in fields) for x in empty] == [(None,) * 7 + (0,)]
