"""Nearest neighbours: exact distances as a column, filtered before the k best are taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.space import distance
from ..sources.catalog import Index
from .query import translate

METRICS = ("l2", "cosine", "dot", "hamming")
FILTERS = ("match_all", "term", "terms", "exists", "range", "wildcard", "regexp", "prefix", "bool")


@dataclass
class Knn:
    """k nearest rows of a vector column. nprobes, refine_factor, ef and use_index are accepted for indexes that approximate; the search here is exact."""

    field: str
    vector: list[float]
    k: int
    metric: str = "l2"
    filter: dict | None = None
    boost: float = 1.0

    @classmethod
    def of(cls, body: dict) -> "Knn":
        name = next((n for n in body if n not in ("boost", "_name")), None)
        given = body[name] if name and isinstance(body[name], dict) else {**body, "field": body.get("field")}
        field = given.get("field", name)
        k, metric = int(given.get("k", 10)), given.get("metric", "l2")
        if k <= 0:
            raise Refused("k is positive")
        if metric not in METRICS:
            raise Refused(f"metric [{metric}] isn't one of {METRICS}")
        if not given.get("vector"):
            raise Refused("a vector is needed")
        return cls(field, [float(x) for x in given["vector"]], k, metric, given.get("filter"), float(given.get("boost", 1.0)))


def _allowed(query: dict) -> None:
    kind, body = next(iter(query.items()))
    if kind not in FILTERS:
        raise Refused(f"[{kind}] isn't served as a filter of nearest neighbours")
    if kind == "bool":
        for k in ("must", "should", "filter", "must_not"):
            for q in body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]]:
                _allowed(q)


def nearest(index: Index, knn: Knn) -> DataFrame:
    """The k rows with the least distance, as _distance, and _score = boost / (1 + distance). Each partition keeps k rows; nothing else is exchanged."""
    found = index.column(knn.field)
    if found is None:
        raise Refused(f"[{knn.field}] does not map to a column")
    column, kind, _ = found
    if kind != "vector":
        raise Refused(f"[{knn.field}] is not a vector")
    if knn.filter:
        _allowed(knn.filter)
    check_dimension(index, knn)
    rows = index.df.where(translate(index, knn.filter).pred) if knn.filter else index.df
    rows = rows.where(column.isNotNull() & (F.size(column) == len(knn.vector)))
    scored = rows.withColumn("_distance", distance(column, knn.vector, knn.metric))
    best = scored.orderBy(F.col("_distance").asc_nulls_last(), *(F.col(k).asc() for k in index.keys)).limit(knn.k)
    return best.withColumn("_score", F.lit(knn.boost) / (1 + F.col("_distance")))


def check_dimension(index: Index, knn: Knn) -> None:
    """Refuse a query vector of another length than the table's first vector, which is all that is read."""
    first = index.df.select(F.size(knn.field).alias("n")).where(F.col(knn.field).isNotNull()).first()
    if first and first["n"] != len(knn.vector):
        raise Refused(f"[{knn.field}] has {first['n']} dimensions, the query {len(knn.vector)}")
