"""Pipeline aggregations: over the buckets of one level, which are few, so windows by parent bucket do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Refused

SIBLING = ("avg_bucket", "sum_bucket", "min_bucket", "max_bucket", "stats_bucket", "extended_stats_bucket", "percentiles_bucket")
PARENT = ("cumulative_sum", "derivative", "serial_diff", "moving_avg", "moving_fn", "bucket_sort", "bucket_script", "bucket_selector")


def _column(df: DataFrame, path: str) -> Column:
    name = {"_count": "doc_count"}.get(path, path)
    if name not in df.columns and name.endswith(".value"):
        name = name[:-6]
    if name not in df.columns:
        raise Refused(f"[{path}] is not a value of these buckets")
    return F.col(f"`{name}`")


def sibling(buckets: DataFrame, kind: str, body: dict, path: str, parents: tuple[str, ...]) -> DataFrame:
    """One row for each parent bucket. Buckets without a value are skipped."""
    key = next(c for c in buckets.columns if c not in parents)
    x = _column(buckets, path).cast("double")
    grouped = buckets.where(x.isNotNull()).groupBy(*parents)
    if kind in ("avg_bucket", "sum_bucket"):
        return grouped.agg((F.avg if kind == "avg_bucket" else F.sum)(x).alias("value"))
    if kind in ("min_bucket", "max_bucket"):
        best = F.min(x) if kind == "min_bucket" else F.max(x)
        pairs = grouped.agg(best.alias("value"), F.collect_list(F.struct(x.alias("x"), F.col(key).cast("string").alias("k"))).alias("all"))
        return pairs.select(*parents, "value", F.array_sort(F.transform(F.filter("all", lambda p: p["x"] == F.col("value")), lambda p: p["k"])).alias("keys"))
    if kind in ("stats_bucket", "extended_stats_bucket"):
        out = [F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.sum(x).alias("sum")]
        if kind == "extended_stats_bucket":
            out += [F.sum(x * x).alias("sum_of_squares"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_deviation")]
        return grouped.agg(*out)
    # the nearest bucket's value, not an interpolated one
    percents = body.get("percents", (1, 5, 25, 50, 75, 95, 99))
    sorted_ = F.array_sort(F.collect_list(x))
    return grouped.agg(*(F.element_at(sorted_, (F.floor(F.lit(p / 100) * (F.count(x) - 1) + F.lit(0.5)) + 1).cast("int")).alias(f"{float(p)}") for p in percents))


def parent(buckets: DataFrame, name: str, kind: str, body: dict, parents: tuple[str, ...], key: str | None) -> DataFrame:
    """A new column of the buckets, or fewer buckets. Windows run in key order under each parent bucket."""
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    ordered = by.orderBy(key) if key else by.orderBy("doc_count")
    if kind == "cumulative_sum":
        x = F.coalesce(_column(buckets, body["buckets_path"]), F.lit(0)).cast("double")
        return buckets.withColumn(name, F.sum(x).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    if kind == "derivative":
        x = _column(buckets, body["buckets_path"]).cast("double")
        difference = x - F.lag(x).over(ordered)
        if unit := body.get("unit"):
            from .query import _duration

            size = {"second": "1s", "minute": "1m", "hour": "1h", "day": "1d", "week": "1w"}.get(unit, unit)
            difference = difference / ((F.col(key) - F.lag(key).over(ordered)) / F.lit(_duration(size)))
        return buckets.withColumn(name, difference)
    if kind == "serial_diff":
        x = _column(buckets, body["buckets_path"]).cast("double")
        return buckets.withColumn(name, x - F.lag(x, int(body.get("lag", 1))).over(ordered))
    if kind == "moving_avg":
        # the values before the bucket and its own, as many as the window
        x = _column(buckets, body["buckets_path"]).cast("double")
        return buckets.withColumn(name, F.avg(x).over(ordered.rowsBetween(1 - int(body.get("window", 5)), 0)))
    if kind == "moving_fn":
        # the window ends before the bucket, moved by shift; functions of an array `values`
        x, window, shift = _column(buckets, body["buckets_path"]).cast("double"), int(body["window"]), int(body.get("shift", 0))
        values = F.collect_list(x).over(ordered.rowsBetween(shift - window, shift - 1))
        known = {"max": "array_max(values)", "min": "array_min(values)", "sum": "aggregate(values, 0D, (a, v) -> a + v)", "unweightedAvg": "aggregate(values, 0D, (a, v) -> a + v, a -> a / size(values))"}
        source = body["script"]
        if m := re.fullmatch(r"MovingFunctions\.(\w+)\(values\)", source):
            if m[1] not in known:
                raise Refused(f"[{source}] isn't served")
            source = known[m[1]]
        return buckets.withColumn("values", values).withColumn(name, F.when(F.size("values") > 0, F.expr(source))).drop("values")
    if kind == "bucket_sort":
        order = []
        for s in body.get("sort", []):
            what, way = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
            way = way.get("order", "asc") if isinstance(way, dict) else way
            c = F.col(f"`{key}`") if what == "_key" else _column(buckets, what)
            order.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
        order += [F.col(f"`{key}`").asc()] if key else []
        start, size = int(body.get("from", 0)), body.get("size")
        ranked = buckets.withColumn("__rank", F.row_number().over(by.orderBy(*order)))
        on = F.col("__rank") > start
        if size is not None:
            on &= F.col("__rank") <= start + int(size)
        return ranked.where(on).drop("__rank")
    source = body["script"]["source"] if isinstance(body["script"], dict) else body["script"]
    held = buckets
    for variable, path in body["buckets_path"].items():
        held = held.withColumn(f"__{variable}", _column(buckets, path))
        source = re.sub(rf"(?:params\.)?\b{variable}\b", f"__{variable}", source)
    dropped = [f"__{v}" for v in body["buckets_path"]]
    if kind == "bucket_script":
        return held.withColumn(name, F.expr(source)).drop(*dropped)
    return held.where(F.coalesce(F.expr(source), F.lit(False))).drop(*dropped)
