"""Metric aggregations: each is one or more aggregate columns, so a level's metrics share one pass and one shuffle."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Refused
from ..sources.catalog import Index
from .query import script

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def _value(index: Index, body: dict) -> Column:
    if "script" in body and "field" not in body:
        x = script(body["script"])
    else:
        x = index.comparable(body["field"])[0]
    return F.coalesce(x, F.lit(body["missing"])) if "missing" in body else x


def _number(index: Index, body: dict) -> Column:
    return _value(index, body).cast("double")


def percents_of(body: dict) -> list[float]:
    percents = body.get("percents", PERCENTS)
    if any(not 0 <= p <= 100 for p in percents):
        raise Refused("percents lie between 0 and 100")
    return list(percents)


#: Into how many parts of near equal size the values are cut before any are sorted.
PARTS = 1000


def ranked(df: DataFrame, keys: tuple[str, ...], x: Column, shares: dict[str, float]) -> DataFrame:
    """The keys, and for each name the exact value at its share (0 to 1) of the ranks, between two ranks in proportion. Groups without values have no row; without keys there is one row.

    A sketch, read at once, gives the ends of PARTS parts of the values. Counts of the parts, which are
    exact whatever the sketch, say which of them hold the ranks; only the values of these are
    counted and sorted. So no task holds more than PARTS counts or the different values of one part for
    a group, and equal values are one row. NaN comes last.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    own = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), x.cast("double").alias("__x")).where(F.col("__x").isNotNull())
    ends = own.agg(F.percentile_approx("__x", [k / PARTS for k in range(1, PARTS)], 4 * PARTS)).first()[0] or []
    ends = sorted({e for e in ends if math.isfinite(e)}) or [0.0]
    placed = Bucketizer(splits=[-math.inf, *ends, math.inf], inputCol="__x", outputCol="__part", handleInvalid="keep").transform(own)
    group = names or [F.lit(0)]
    parts = placed.groupBy(*names, "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__last", F.sum("__n").over(W.partitionBy(*group)) - 1)
    at = {n: F.col("__last") * F.lit(float(p)) for n, p in shares.items()}
    holds = lambda rank, first, n: (first <= rank) & (rank < first + n)
    wanted = reduce(lambda a, b: a | b, (holds(end(a), F.col("__before"), F.col("__n")) for a in at.values() for end in (F.floor, F.ceil)))
    chosen = parts.where(wanted).select(*(F.col(n).alias(f"{n}_") for n in names), F.col("__part").alias("__part_"), "__before", "__last")
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in [*names, "__part"]))
    values = placed.join(chosen if keys else F.broadcast(chosen), on).groupBy(*names, "__part", "__before", "__last", "__x").agg(F.count(F.lit(1)).alias("__n"))
    values = values.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__n").over(W.partitionBy(*names, "__part").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    found = [F.max("__last").alias("__last")]
    for i, a in enumerate(at.values()):
        found += [F.max(F.when(holds(end(a), F.col("__first"), F.col("__n")), F.col("__x"))).alias(f"__{side}{i}") for side, end in (("low", F.floor), ("high", F.ceil))]
    out = values.groupBy(*names).agg(*found)
    between = [F.when(F.col(f"__low{i}") == F.col(f"__high{i}"), F.col(f"__low{i}")).otherwise((F.ceil(a) - a) * F.col(f"__low{i}") + (a - F.floor(a)) * F.col(f"__high{i}")).alias(n) for i, (n, a) in enumerate(at.items())]
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *between)


def columns(index: Index, kind: str, name: str, body: dict) -> list[Column]:
    """The aggregate columns of a metric. A metric of one value is called name; of several, name.part."""
    if kind == "value_count":
        return [F.count(_value(index, body)).alias(name)]
    if kind == "cardinality":
        x = _value(index, body)
        # an error of 1.04 / sqrt(m); the threshold below which counts are nearly exact decides m
        exact = body.get("exact", False)
        return [(F.countDistinct(x) if exact else F.approx_count_distinct(x, max(0.005, min(0.1, 1.04 / (int(body.get("precision_threshold", 3000)) ** 0.5))))).alias(name)]
    if kind in ("min", "max", "sum", "avg"):
        x = _number(index, body)
        return [{"min": F.min, "max": F.max, "avg": F.avg, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0))}[kind](x).alias(name)]
    if kind in ("stats", "extended_stats"):
        x = _number(index, body)
        out = [F.count(x).alias(f"{name}.count"), F.min(x).alias(f"{name}.min"), F.max(x).alias(f"{name}.max"), F.avg(x).alias(f"{name}.avg"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{name}.sum")]
        if kind == "extended_stats":
            sigma = float(body.get("sigma", 2))
            # the central moment keeps large means from swallowing the variance
            out += [
                F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"{name}.sum_of_squares"), F.var_pop(x).alias(f"{name}.variance"), F.var_samp(x).alias(f"{name}.variance_sampling"), F.stddev_pop(x).alias(f"{name}.std_deviation"), F.stddev_samp(x).alias(f"{name}.std_deviation_sampling"),
                (F.avg(x) + sigma * F.stddev_pop(x)).alias(f"{name}.std_upper"), (F.avg(x) - sigma * F.stddev_pop(x)).alias(f"{name}.std_lower"),
            ]
        return out
    if kind == "percentiles":
        # exact ones take passes of their own: ranked()
        x, percents = _number(index, body), percents_of(body)
        every = F.percentile_approx(x, [p / 100 for p in percents], int(body.get("tdigest", {}).get("compression", 100)) * 100)
        return [every[k].alias(f"{name}.{float(p)}") for k, p in enumerate(percents)]
    if kind == "percentile_ranks":
        x = _number(index, body)
        return [(F.avg(F.when(x.isNotNull(), (x <= float(v)).cast("double"))) * 100).alias(f"{name}.{float(v)}") for v in body["values"]]
    if kind == "weighted_avg":
        v, w = _number(index, body["value"]), _number(index, body["weight"])
        both = v.isNotNull() & w.isNotNull()
        return [F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w))).alias(name)]
    if kind == "matrix_stats":
        return _matrix(index, name, body)
    if kind == "geo_centroid":
        p = index.comparable(body["field"])[0]
        return [F.avg(p["lat"]).alias(f"{name}.lat"), F.avg(p["lon"]).alias(f"{name}.lon"), F.count(p).alias(f"{name}.count")]
    if kind == "geo_bounds":
        p = index.comparable(body["field"])[0]
        return [F.max(p["lat"]).alias(f"{name}.top"), F.min(p["lon"]).alias(f"{name}.left"), F.min(p["lat"]).alias(f"{name}.bottom"), F.max(p["lon"]).alias(f"{name}.right")]
    if kind == "scripted_metric":
        # map: a value of each row; combine: an aggregate over it (column `value`), both Spark SQL
        if extra := {"init_script", "reduce_script"} & body.keys():
            raise Refused(f"scripted_metric with {sorted(extra)} isn't served")
        # the name `value` alone, not words or columns that hold it
        text = re.sub(r"(?<![\w.`'])value(?![\w`'(])", lambda _: f"({body['map_script']})", body["combine_script"])
        return [F.expr(text).alias(name)]
    raise Refused(f"unknown metric [{kind}]")


def _matrix(index: Index, name: str, body: dict) -> list[Column]:
    fields = body["fields"]
    own = {f: _number(index, {"field": f}) for f in fields}
    complete = F.lit(True)
    for x in own.values():
        complete &= x.isNotNull()
    own = {f: F.when(complete, x) for f, x in own.items()}
    out = [F.count(next(iter(own.values()))).alias(f"{name}.count")]
    for f, x in own.items():
        out += [F.avg(x).alias(f"{name}.{f}.mean"), F.var_samp(x).alias(f"{name}.{f}.variance"), F.skewness(x).alias(f"{name}.{f}.skewness"), (F.kurtosis(x) + 3).alias(f"{name}.{f}.kurtosis")]
    for k, f in enumerate(fields):
        for g in fields[k + 1 :]:
            out += [F.covar_samp(own[f], own[g]).alias(f"{name}.{f}.{g}.covariance"), F.corr(own[f], own[g]).alias(f"{name}.{f}.{g}.correlation")]
    return out


METRICS = ("value_count", "cardinality", "min", "max", "sum", "avg", "stats", "extended_stats", "percentiles", "percentile_ranks", "weighted_avg", "matrix_stats", "geo_centroid", "geo_bounds", "scripted_metric", "median_absolute_deviation")
