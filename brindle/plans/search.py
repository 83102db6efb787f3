"""A search body becomes DataFrames: hits, total, and one table for each bucket aggregation. Nothing runs until one is read, but for small passes that scoring and exact percentiles need."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators import aggregate, hits, knn
from ..operators.query import translate
from ..sources.catalog import Index

KEYS = ("query", "knn", "size", "from", "sort", "search_after", "aggs", "aggregations", "post_filter", "min_score", "track_total_hits", "track_scores", "terminate_after", "rescore", "collapse", "_source", "fields", "docvalue_fields", "stored_fields", "script_fields", "explain", "profile", "timeout", "version")


@dataclass
class Result:
    hits: DataFrame | None
    total: DataFrame
    aggregations: dict[str, DataFrame] = field(default_factory=dict)
    max_score: DataFrame | None = None


def search(index: Index, body: dict) -> Result:
    """Run a body over an index. hits has _id (the primary key as text, if there is one), _score, the sort values as _sort_0, ..., and the columns of _source. max_score has one row: null if a sort leaves scores out and track_scores isn't set."""
    for k in ("explain", "profile", "version", "timeout"):
        if body.get(k):
            raise Refused(f"[{k}] isn't served")
    for k in body:
        if k in ("suggest", "highlight"):
            raise Refused(f"[{k}] isn't served")
        if k not in KEYS:
            raise Refused(f"unknown key [{k}]")
    query = body.get("query")
    near = body.get("knn") or (query or {}).get("knn")
    hybrid = _hybrid(query)
    if hybrid:
        rows = _joined(index, *hybrid)
    elif near:
        rows = knn.nearest(index, knn.Knn.of(near))
    elif query and "bool" in query and (found := _knn_in_bool(query["bool"])):
        # inside a bool the neighbours come first, and the rest filters them: fewer than k may stay
        clause, rest = found
        rows = knn.nearest(index, knn.Knn.of(clause))
        other = translate(index, {"bool": rest}) if rest else None
        if other is not None:
            rows = rows.where(other.pred).withColumn("_score", F.col("_score") + other.score)
    else:
        clause = translate(index, query)
        rows = index.df.where(clause.pred).withColumn("_score", clause.score)
    if "terminate_after" in body and int(body["terminate_after"]) > 0:
        rows = rows.limit(int(body["terminate_after"]))
    if "min_score" in body:
        rows = rows.where(F.col("_score") >= float(body["min_score"]))
    aggs = body.get("aggs") or body.get("aggregations")
    tables = aggregate.aggregate(replace(index, df=rows, whole=index.df), rows, aggs) if aggs else {}
    page = rows.where(translate(index, body["post_filter"]).pred) if body.get("post_filter") else rows
    total = hits.total(page, body.get("track_total_hits"))
    scored = not body.get("sort") or body.get("track_scores") or any(s == "_score" or isinstance(s, dict) and "_score" in s for s in (body["sort"] if isinstance(body["sort"], list) else [body["sort"]]))
    best = page.agg(F.max(F.col("_score") if scored else F.lit(None).cast("double")).alias("max_score"))
    return Result(_page(index, page, body), total, tables, best)


def _page(index: Index, rows: DataFrame, body: dict) -> DataFrame | None:
    size, start = body.get("size", 10), int(body.get("from", 0))
    size = None if size is None else int(size)
    if start < 0 or size is not None and size < 0:
        raise Refused("size and from aren't negative")
    if size == 0:
        return None
    given = body.get("sort")
    cursor = body.get("search_after")
    if cursor is not None and not given:
        raise Refused("search_after needs a sort")
    sorts = hits.sort_columns(index, given or ["_score"])
    if cursor is not None:
        if [s[0] for s in sorts] == ["_score"]:
            raise Refused("search_after over the score alone isn't served")
        rows = rows.where(hits.after(sorts, cursor))
    order = hits.ordering(sorts, index)
    if body.get("rescore"):
        if given:
            raise Refused("rescore and sort don't go together")
        rows = hits.rescore(rows, index, body["rescore"], order)
    inner = None
    if folded := body.get("collapse"):
        inner = folded.get("inner_hits")
        if inner:
            inside = hits.ordering(hits.sort_columns(index, inner.get("sort", ["_score"])), index)
            members = hits.collapse(rows, index, folded["field"], inside, int(inner.get("size", 3)))
        rows = hits.collapse(rows, index, folded["field"], order).drop("_rank")
    for k, (_, column, _, _) in enumerate(sorts):
        rows = rows.withColumn(f"_sort_{k}", column)
    # a size of None is no page: all rows, in no order unless some are left out
    page = rows if size is None and not start else rows.orderBy(*order)
    page = page.offset(start) if start else page
    page = page if size is None else page.limit(size)
    columns = [] if body.get("stored_fields") == "_none_" else hits.source_columns(index, body.get("_source"))
    extra = [F.expr(s["script"]["source"] if isinstance(s["script"], dict) else s["script"]).alias(n) for n, s in body.get("script_fields", {}).items()]
    for f in [*body.get("fields", []), *body.get("docvalue_fields", [])]:
        name, form = (f, None) if isinstance(f, str) else (f["field"], f.get("format"))
        column, kind, _ = index.comparable(name)
        value = F.date_format(F.timestamp_millis(column), form) if form and kind == "date" and form != "epoch_millis" else column
        extra.append(value.alias(f"fields.{name}"))
    if inner:
        key = index.comparable(folded["field"])[0]
        kept = page.select(key.alias("__key"))
        shown = [F.col(c) for c in columns]
        return members.join(kept if size is None else F.broadcast(kept), key.eqNullSafe(F.col("__key"))).select("_rank", "_score", *shown)
    sorted_by = [f"_sort_{k}" for k in range(len(sorts))]
    ids = [F.col(index.key).cast("string").alias("_id")] if index.key and "_id" not in index.df.columns else []
    return page.select(*ids, "_score", *sorted_by, *(F.col(c) if c in index.df.columns else F.col(c).alias(c) for c in columns), *extra)


def _hybrid(query: dict | None):
    """(neighbours, other clauses) of a bool that has only should, with one knn among them."""
    if not query or "bool" not in query or set(query["bool"]) - {"should", "boost"}:
        return None
    should = query["bool"].get("should") or []
    found = [q for q in should if "knn" in q] if isinstance(should, list) else []
    if len(found) != 1 or len(should) < 2:
        return None
    return found[0]["knn"], [q for q in should if "knn" not in q]


def _joined(index: Index, near: dict, others: list[dict]) -> DataFrame:
    """Rows that match text or are neighbours, with the sum of both scores: the k neighbours are joined by key to the table."""
    if not index.keys:
        raise Refused("a hybrid search needs keys")
    neighbours = knn.nearest(index, knn.Knn.of(near)).select(*(F.col(k).alias(f"__{k}") for k in index.keys), F.col("_score").alias("__near"))
    clause = translate(index, {"bool": {"should": others}})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in index.keys))
    # at most k rows are broadcast
    joined = index.df.join(F.broadcast(neighbours), on, "left")
    score = F.coalesce("__near", F.lit(0.0)) + F.when(clause.pred, clause.score).otherwise(0.0)
    return joined.where(clause.pred | F.col("__near").isNotNull()).withColumn("_score", score).drop("__near", *(f"__{k}" for k in index.keys))


def _knn_in_bool(body: dict):
    for k in ("must", "filter", "should"):
        own = body.get(k)
        for q in own if isinstance(own, list) else [own] if own else []:
            if "knn" in q:
                rest = {**body, k: [x for x in (own if isinstance(own, list) else []) if x is not q]}
                return q["knn"], {a: b for a, b in rest.items() if b}
    return None


def count(index: Index, query: dict | None = None) -> DataFrame:
    return index.df.where(translate(index, query).pred).agg(F.count(F.lit(1)).alias("count"))


def search_all(indexes: list[Index], body: dict) -> Result:
    """One search over several indexes: their rows together, missing columns null."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.df.withColumn("_index", F.lit(x.name)) for x in indexes))
    keys = tuple(dict.fromkeys(k for x in indexes for k in x.keys))
    overrides = {k: v for x in indexes for k, v in x.overrides.items()}
    return search(Index(",".join(x.name for x in indexes), df, None, ("_index", *keys), overrides), body)


def explain(index: Index, body: dict) -> dict[str, str]:
    """The plans of a body's parts, without running it but for the small passes that scoring needs; a request that is refused says why."""
    try:
        found = search(index, body)
    except Refused as e:
        return {"refused": str(e)}
    plan = lambda df: df._jdf.queryExecution().toString()
    return {**({"hits": plan(found.hits)} if found.hits is not None else {}), **{f"aggregation {k}": plan(v) for k, v in found.aggregations.items()}}
