"""Hits: sorting, cursors, pages, collapsing, rescoring, source filtering."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import space
from ..sources.catalog import Index
from .query import script, translate


def sort_columns(index: Index, given) -> list[tuple[str, Column, str, bool]]:
    """(name, value, asc or desc, nulls first) of each sort clause; nulls are last in both directions by default."""
    out = []
    for entry in given if isinstance(given, list) else [given]:
        if isinstance(entry, str):
            entry = {entry: "desc" if entry == "_score" else "asc"}
        name, options = next(iter(entry.items()))
        options = {"order": options} if isinstance(options, str) else dict(options)
        order = options.get("order", "desc" if name == "_score" else "asc")
        first = options.get("missing", "_last") == "_first"
        if name == "_score":
            if order == "asc":
                raise Refused("sorting by ascending _score isn't served")
            out.append((name, F.col("_score"), order, False))
            continue
        if name == "_doc":
            out += [(k, F.col(k), order, False) for k in index.keys]
            continue
        if name == "_geo_distance":
            field = next(k for k in options if k not in ("order", "unit", "mode", "distance_type", "ignore_unmapped"))
            away = space.haversine(index.comparable(field)[0], *space.point(options[field])) / space.metres("1" + options.get("unit", "m"))
            out.append((name, away, order, first))
            continue
        if name == "_script":
            out.append((name, script(options["script"]), order, first))
            continue
        if name in ("_id", "_index"):
            raise Refused(f"sorting by [{name}] isn't served")
        column, kind, at = index.comparable(name)
        if isinstance(at, T.ArrayType):
            mode = options.get("mode", "min" if order == "asc" else "max")
            if isinstance(at.elementType, T.StructType) or mode not in ("min", "max"):
                raise Refused(f"[{name}] can't be sorted by {mode}")
            column = F.array_min(column) if mode == "min" else F.array_max(column)
        elif kind in ("geo_point", "object", "binary"):
            raise Refused(f"[{name}] can't be sorted by")
        if options.get("missing", "_last") not in ("_last", "_first"):
            column = F.coalesce(column, F.lit(options["missing"]))
        out.append((name, column, order, first))
    return out


def ordering(sorts, index: Index) -> list[Column]:
    """Sort columns, then the table's keys, so that ties have one order."""
    out = []
    for _, column, order, first in sorts:
        out.append({("asc", False): column.asc_nulls_last, ("asc", True): column.asc_nulls_first, ("desc", False): column.desc_nulls_last, ("desc", True): column.desc_nulls_first}[order, first]())
    return out + [F.col(k).asc() for k in index.keys if k not in {n for n, *_ in sorts}]


def after(sorts, cursor: list) -> Column:
    """Rows strictly behind the cursor, in the order of the sorts."""
    if len(cursor) != len(sorts):
        raise Refused(f"search_after has {len(cursor)} values for {len(sorts)} sorts")
    pred, equal = F.lit(False), F.lit(True)
    for (_, column, order, first), value in zip(sorts, cursor):
        if value is None:
            behind, same = (column.isNotNull() if first else F.lit(False)), column.isNull()
        else:
            behind = F.coalesce(column > F.lit(value) if order == "asc" else column < F.lit(value), F.lit(not first))
            same = F.coalesce(column == F.lit(value), F.lit(False))
        pred |= equal & behind
        equal &= same
    return pred


def source_columns(index: Index, given) -> list[str]:
    """Columns of _source: false, a pattern, patterns, or includes and excludes."""
    names = index.df.columns
    if given is None or given is True:
        return names
    if given is False:
        return []
    if isinstance(given, (str, list)):
        given = {"includes": given}
    listed = lambda x: [x] if isinstance(x, str) else x or []
    include, exclude = listed(given.get("includes", given.get("include"))), listed(given.get("excludes", given.get("exclude")))
    paths = [n for n in names if not include or any(fnmatch.fnmatchcase(n, p) for p in include)]
    paths += [p for p in include if p not in names and "*" not in p and "." in p and index.resolve(p)]
    return [n for n in paths if not any(fnmatch.fnmatchcase(n, p) for p in exclude)]


def collapse(df: DataFrame, index: Index, field: str, order: list[Column], size: int = 1) -> DataFrame:
    """The best `size` rows of each key, with _rank among them; rows without a key make a group of their own."""
    key = index.comparable(field)[0]
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= size)


def rescore(df: DataFrame, index: Index, given, order: list[Column]) -> DataFrame:
    """The best window_size rows with scores joined from a second query; only they are kept."""
    for r in given if isinstance(given, list) else [given]:
        inner = r["query"]
        clause = translate(index, inner["rescore_query"])
        mine, theirs = F.lit(float(inner.get("query_weight", 1))) * F.col("_score"), F.lit(float(inner.get("rescore_query_weight", 1))) * clause.score
        mode = inner.get("score_mode", "total")
        joined = {"total": mine + theirs, "multiply": mine * theirs, "avg": (mine + theirs) / 2, "max": F.greatest(mine, theirs), "min": F.least(mine, theirs)}[mode]
        df = df.orderBy(*order).limit(int(r.get("window_size", 10))).withColumn("_score", F.when(clause.pred, joined).otherwise(mine))
    return df


def total(df: DataFrame, bound=None) -> DataFrame:
    """(value, relation): the exact count if bound is True; else counted up to the bound, 10,000 by default, and gte beyond it."""
    if bound is False:
        return df.sparkSession.createDataFrame([], "value bigint, relation string")
    if bound is True:
        return df.agg(F.count(F.lit(1)).alias("value"), F.lit("eq").alias("relation"))
    most = 10_000 if bound is None else int(bound)
    n = df.select(F.lit(1)).limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(most)).cast("bigint").alias("value"), F.when(F.col("n") > most, "gte").otherwise("eq").alias("relation"))
