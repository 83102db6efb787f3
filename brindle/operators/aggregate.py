"""The aggregation tree. Each bucket level becomes one flat DataFrame: the keys of its ancestors, its own key, doc_count and its metrics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import dates, space
from ..sources.catalog import Index
from . import metrics, pipelines
from .query import _duration, script, translate

REFUSED = {"global": "global needs all rows beside the query's", "rare_terms": "rare_terms", "significant_terms": "significant_terms", "significant_text": "significant_text", "top_hits": "top_hits"}
CALENDAR = {"second": "second", "1s": "second", "minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}
DAY = 86_400_000


@dataclass
class Level:
    """Rows of one bucket level: df has the columns of `keys` beside the table's. fixed: all keys that must appear, also when empty. order, size, fill: what happens to the buckets."""

    df: DataFrame
    key: str | None
    fixed: list | None = None
    order: list[Column] = field(default_factory=list)
    size: int | None = None
    least: int = 0
    fill: object = None
    index: Index | None = None
    distinct: str | None = None
    extra: dict[str, Column] = field(default_factory=dict)
    every: DataFrame | None = None
    other: bool = False


def aggregate(index: Index, df: DataFrame, aggs: dict, parents: tuple[str, ...] = (), path: str = "", kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """Path of each bucket aggregation ("a", "a>b") -> its buckets; "" (or the parent's path) has the metrics of the level above. Pipelines are applied to the buckets.

    Beside the buckets of terms and multi_terms, "a:other" has sum_other_doc_count and
    doc_count_error_upper_bound (0, as counts are exact), a row for each parent.
    """
    out: dict[str, DataFrame] = {}
    own, siblings = {}, {}
    for name, body in aggs.items():
        kind = next((k for k in body if k not in ("aggs", "aggregations", "meta")), None)
        if kind in REFUSED:
            raise Refused(f"[{REFUSED[kind]}] isn't served")
        if kind in metrics.METRICS:
            own[name] = (kind, body[kind])
        elif kind in pipelines.SIBLING:
            siblings[name] = (kind, body[kind])
        elif kind in pipelines.PARENT:
            if not parents:
                raise Refused(f"[{kind}] belongs under a bucket aggregation")
        elif kind in _BUCKETS:
            out |= _bucket(index, df, name, kind, body, parents, path, kept)
        else:
            raise Refused(f"unknown aggregation [{kind}]")
    if not parents and own:
        out[""] = _grouped(index, df, (), own)
    for name, (kind, body) in siblings.items():
        source = body["buckets_path"].split(">")
        for k in range(len(source) - 1, 0, -1):
            at = (path + ">" if path else "") + ">".join(source[:k])
            if at in out:
                out[(path + ">" if path else "") + name] = pipelines.sibling(out[at], kind, body, source[-1], parents)
                break
        else:
            raise Refused(f"[{body['buckets_path']}] leads nowhere")
    return out


def _grouped(index: Index, df: DataFrame, keys: tuple[str, ...], own: dict, distinct: str | None = None) -> DataFrame:
    """doc_count and metrics for each combination of keys: one partial and one final aggregation. Exact percentiles and the median absolute deviation take passes of their own, and their columns come last."""
    count = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    found = [count.alias("doc_count")]
    second = []
    for name, (kind, body) in own.items():
        if kind == "median_absolute_deviation":
            x = metrics._number(index, body)
            joined = _beside(df, metrics.ranked(df, keys, x, {"__median": 0.5}), keys)
            second.append(metrics.ranked(joined, keys, F.abs(x - F.col("__median")), {name: 0.5}))
        elif kind == "percentiles" and body.get("exact"):
            second.append(metrics.ranked(df, keys, metrics._number(index, body), {f"{name}.{float(p)}": p / 100 for p in metrics.percents_of(body)}))
        else:
            found += metrics.columns(index, kind, name, body)
    out = df.groupBy(*keys).agg(*found)
    for more in second:
        out = _beside(out, more, keys)
    return out


def _beside(df: DataFrame, more: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df with the columns that more has for its keys, null where it has none."""
    renamed = more.select(*(F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in more.columns if c not in keys))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return df.join(renamed if keys else F.broadcast(renamed), on or F.lit(True), "left").drop(*(f"__{i}" for i in range(len(keys))))


def _bucket(index: Index, df: DataFrame, name: str, kind: str, body: dict, parents: tuple[str, ...], path: str, kept: DataFrame | None) -> dict[str, DataFrame]:
    level = _BUCKETS[kind](index, df, name, body[kind])
    subs = body.get("aggs") or body.get("aggregations") or {}
    inner = level.index or index
    own = {n: (k, b[k]) for n, b in subs.items() for k in b if k in metrics.METRICS}
    keys = (*parents, *((level.key,) if level.key else ()))
    rows = level.df.where(F.col(level.key).isNotNull()) if level.key else level.df
    grouped = _grouped(inner, rows, keys, own, level.distinct)
    if level.fixed is not None and level.key:
        grouped = _with_fixed(grouped, level, parents, kept, own)
    if level.fill is not None:
        grouped = level.fill(grouped, parents, level.key, own)
    if level.every is not None:
        grouped = _filled(level.every.select(level.key).distinct().join(grouped, level.key, "left"), grouped, own)
    if not level.key and parents and kept is not None:
        # parents without a row here have an empty bucket
        grouped = _filled(kept.select(*parents).join(grouped, list(parents), "left"), grouped, own)
    if level.least > 1:
        grouped = grouped.where(F.col("doc_count") >= level.least)
    for column, value in level.extra.items():
        grouped = grouped.withColumn(column, value)
    cut, whole = False, grouped
    if level.size is not None:
        total = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
        order = level.order(own) if callable(level.order) else level.order
        if parents:
            ranked = grouped.withColumn("__rank", F.row_number().over(total.orderBy(*order)))
            grouped = ranked.where(F.col("__rank") <= level.size).drop("__rank")
        else:
            grouped = grouped.orderBy(*order).limit(level.size)
        cut = True
    here = f"{path}>{name}" if path else name
    down = {n: b for n, b in subs.items() if n not in own}
    parent_pipes = [(n, k, b[k]) for n, b in down.items() for k in b if k in pipelines.PARENT]
    out = {f"{here}:other": _other(whole, grouped, parents)} if level.other else {}
    # rows of buckets that were cut don't reach the levels below; the kept keys are at most size for each parent
    below = rows.join(F.broadcast(grouped.select(*keys)) if not parents else grouped.select(*keys), list(keys), "left_semi") if cut and keys and any(k in _BUCKETS for b in down.values() for k in b) else rows
    if down:
        out |= aggregate(inner, below, {n: b for n, b in down.items() if n not in {p[0] for p in parent_pipes}}, keys, here, grouped.select(*keys) if keys else None)
    for n, k, b in parent_pipes:
        grouped = pipelines.parent(grouped, n, k, b, parents, level.key)
    return {here: grouped} | out


def _with_fixed(grouped: DataFrame, level: Level, parents: tuple[str, ...], kept: DataFrame | None, own: dict) -> DataFrame:
    """Buckets that the request names appear with count 0 where no row is in them, under each parent bucket."""
    spark = grouped.sparkSession
    names = spark.createDataFrame([(x,) for x in level.fixed], T.StructType([T.StructField(level.key, grouped.schema[level.key].dataType)]))
    if parents:
        above = kept if kept is not None else grouped.select(*parents).distinct()
        # the request's few buckets beside each parent: an array of literals, not a join
        every = above.select(*parents, F.explode(F.array(*(F.lit(x).cast(grouped.schema[level.key].dataType) for x in level.fixed))).alias(level.key))
        out = every.join(grouped, [*parents, level.key], "left")
    else:
        out = names.join(grouped, level.key, "left")
    return _filled(out, grouped, own)


def _other(whole: DataFrame, shown: DataFrame, parents: tuple[str, ...]) -> DataFrame:
    """How many rows the buckets that aren't shown have, under each parent."""
    both = whole.select(*parents, F.col("doc_count").alias("__n")).union(shown.select(*parents, -F.col("doc_count")))
    return both.groupBy(*parents).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("sum_other_doc_count"), F.lit(0).cast("bigint").alias("doc_count_error_upper_bound"))


def _filled(out: DataFrame, grouped: DataFrame, own: dict) -> DataFrame:
    """The columns of grouped, with counts and sums of buckets without rows as 0."""
    sums = [n for n, (k, _) in own.items() if k == "sum"] + [f"{n}.sum" for n, (k, _) in own.items() if k in ("stats", "extended_stats")]
    counts = ["doc_count"] + [n for n, (k, _) in own.items() if k in ("value_count", "cardinality")] + [f"{n}.count" for n, (k, _) in own.items() if k in ("stats", "extended_stats")]
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(grouped.schema[c].dataType)).alias(c) if c in sums + counts else F.col(f"`{c}`") for c in grouped.columns])


# ---------------------------------------------------------------- buckets


def _order(name: str, given, default: list) -> object:
    """Columns to sort buckets by: _count, _key or a metric (m or m.value or m.part); ties by key."""

    def make(own: dict) -> list[Column]:
        out = []
        for entry in given if isinstance(given, list) else [given]:
            for what, way in entry.items():
                column = {"_count": "doc_count", "_key": name, "_term": name}.get(what)
                if column is None:
                    base, _, part = what.partition(".")
                    if base not in own:
                        raise Refused(f"order by [{what}]: no such metric below")
                    column = base if part in ("", "value") else what
                c = F.col(f"`{column}`")
                out.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
        return [*out, F.col(name).asc()]

    return make if given else (lambda own: default)


def _keyed(index: Index, body: dict) -> tuple[Column, str, T.DataType]:
    column, kind, at = index.comparable(body["field"]) if "field" in body else (script(body["script"]), "keyword", T.StringType())
    if "missing" in body:
        column = F.coalesce(column, F.lit(body["missing"]))
    return column, kind, at


def _terms(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    column, kind, at = _keyed(index, body)
    if isinstance(at, T.ArrayType):
        df = df.withColumn(name, F.explode(F.array_distinct(column)))
    else:
        df = df.withColumn(name, column)
    for option, keep in (("include", True), ("exclude", False)):
        if option in body:
            given = body[option]
            if isinstance(given, dict):
                hit = F.pmod(F.xxhash64(name), F.lit(int(given["num_partitions"]))) == int(given["partition"])
            else:
                hit = F.col(name).isin(given) if isinstance(given, list) else F.col(name).cast("string").rlike(f"^(?:{given})$")
            df = df.where(hit if keep else ~hit | F.col(name).isNull())
    order = _order(name, body.get("order"), [F.desc("doc_count"), F.asc(name)])
    least, every = int(body.get("min_doc_count", 1)), None
    if least == 0:
        # terms of the whole table, whatever the query's rows
        if index.whole is None or "missing" in body:
            raise Refused("min_doc_count 0 is served at the top level, without missing")
        every = _terms(replace(index, df=index.whole), index.whole, name, {**body, "min_doc_count": 1}).df
        every = every.where(F.col(name).isNotNull())
    return Level(df, name, order=order, size=_size(body), least=least, every=every, other=True)


def _size(body: dict) -> int | None:
    """How many buckets are shown; a size of None shows all, in no order."""
    return None if (size := body.get("size", 10)) is None else int(size)


def _multi_terms(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    parts = []
    for t in body["terms"]:
        # the separator inside a value is escaped, so different tuples have different keys
        parts.append(F.regexp_replace(_keyed(index, t)[0].cast("string"), r"([|\\\\])", r"\\$1"))
    whole = F.lit(True)
    for p in parts:
        whole &= p.isNotNull()
    df = df.withColumn(name, F.when(whole, F.concat_ws("|", *parts)))
    return Level(df, name, order=_order(name, body.get("order"), [F.desc("doc_count"), F.asc(name)]), size=_size(body), least=int(body.get("min_doc_count", 1)), other=True)


def _gaps(step, scale: float | int, bounds: dict | None):
    """Fill the gaps between the first and last bucket (or the given bounds) with empty ones: one small range of ordinals per parent."""

    def fill(grouped: DataFrame, parents: tuple[str, ...], key: str, own: dict) -> DataFrame:
        kind = grouped.schema[key].dataType
        low, high = F.min("__at"), F.max("__at")
        at = grouped.withColumn("__at", step(F.col(key)))
        ends = at.groupBy(*parents).agg(low.alias("low"), high.alias("high"))
        if bounds:
            for end, pick, name in (("low", F.least, "min"), ("high", F.greatest, "max")):
                if bounds.get(name) is not None:
                    ends = ends.withColumn(end, pick(end, step(F.lit(bounds[name]))))
        every = ends.where(F.col("low").isNotNull()).select(*parents, F.explode(F.sequence("low", "high")).alias("__at"))
        joined = every.join(at, [*parents, "__at"], "left")
        value = scale(F.col("__at")) if callable(scale) else F.col("__at") * F.lit(scale)
        joined = joined.withColumn(key, F.coalesce(F.col(key), value.cast(kind))).drop("__at")
        zero = ["doc_count"] + [n for n, (k, _) in own.items() if k in ("sum", "value_count", "cardinality")]
        return joined.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(grouped.schema[c].dataType)).alias(c) if c in zero else F.col(f"`{c}`") for c in grouped.columns])

    return fill


def _histogram(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    column, kind, at = _keyed(index, body)
    interval, offset = float(body["interval"]), float(body.get("offset", 0))
    if interval <= 0:
        raise Refused("an interval is positive")
    if hard := body.get("hard_bounds"):
        df = df.where(column.between(hard["min"], hard["max"]))
    df = df.withColumn(name, F.floor((column.cast("double") - offset) / interval) * interval + F.lit(offset))
    least = int(body.get("min_doc_count", 0))
    fill = _gaps(lambda k: F.round((k - offset) / interval).cast("bigint"), lambda a: a * interval + offset, body.get("extended_bounds")) if least == 0 else None
    return Level(df, name, order=_order(name, body.get("order"), [F.asc(name)]), least=least, fill=fill)


def _local(index: Index, body: dict) -> Column:
    """The date as milliseconds of its local time."""
    millis = index.comparable(body["field"])[0]
    if "missing" in body:
        millis = F.coalesce(millis, F.lit(dates.interval(body["missing"])[0]))
    return _to_local(millis, body.get("time_zone")) - int(_offset(body.get("offset", 0)))


def _to_local(millis: Column, zone: str | None) -> Column:
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(millis), zone)) if zone else millis


def _to_utc(millis: Column, zone: str | None) -> Column:
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(millis), zone)) if zone else millis


def _bounds(body: dict, name: str) -> dict | None:
    """Bounds of a date histogram in milliseconds; they may be dates with math."""
    given = body.get(name)
    return {k: dates.interval(v, body.get("format"), body.get("time_zone"))[0] for k, v in given.items() if v is not None} if given else None


def _offset(given) -> float:
    if isinstance(given, str) and given[:1] in "+-":
        return _duration(given[1:]) * (-1 if given[0] == "-" else 1)
    return _duration(given)


def _truncated(millis: Column, unit: str) -> Column:
    """The beginning of the calendar unit, in UTC, whatever the session's zone: all arithmetic is on days."""
    if unit in ("second", "minute", "hour", "day"):
        size = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY}[unit]
        return F.floor(millis / F.lit(size)) * size
    day = F.date_from_unix_date(F.floor(millis / F.lit(DAY)).cast("int"))
    return F.unix_date(F.trunc(day, unit)).cast("bigint") * DAY


def _date_histogram(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    if index.column(body["field"]) and index.column(body["field"])[1] != "date":
        raise Refused(f"[{body['field']}] is not a date")
    local, shift = _local(index, body), int(_offset(body.get("offset", 0)))
    least = int(body.get("min_doc_count", 0))
    fixed = body.get("fixed_interval")
    unit = CALENDAR.get(str(body.get("calendar_interval", body.get("interval", ""))))
    if fixed:
        size = int(_duration(fixed))
        key = F.floor(local / F.lit(size)) * size
        step, back = (lambda k: F.floor((k - shift) / F.lit(size)).cast("bigint")), (lambda a: a * size + shift)
    elif unit in ("second", "minute", "hour", "day", "week"):
        key = _truncated(local, unit)
        size = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY, "week": 7 * DAY}[unit]
        first = -3 * DAY if unit == "week" else 0
        step, back = (lambda k: F.floor((k - shift - first) / F.lit(size)).cast("bigint")), (lambda a: a * size + first + shift)
    elif unit in ("month", "quarter", "year"):
        key = _truncated(local, unit)
        months = {"month": 1, "quarter": 3, "year": 12}[unit]
        day = lambda k: F.date_from_unix_date(F.floor((k - shift) / F.lit(DAY)).cast("int"))
        step = lambda k: F.floor((F.year(day(k)) * 12 + F.month(day(k)) - 1) / months).cast("bigint")
        back = lambda a: F.unix_date(F.make_date(F.floor(a * months / 12).cast("int"), (F.pmod(a * months, F.lit(12)) + 1).cast("int"), F.lit(1))).cast("bigint") * DAY + shift
    else:
        raise Refused(f"interval [{body.get('calendar_interval', body.get('interval'))}] isn't served")
    zone = body.get("time_zone")
    # keys are instants; gaps are stepped in local time
    df = df.withColumn(name, _to_utc((key + shift).cast("bigint"), zone))
    if hard := _bounds(body, "hard_bounds"):
        # buckets that begin at or after max, or before min, go
        df = df.where(F.lit(True) if "min" not in hard else F.col(name) >= hard["min"]).where(F.lit(True) if "max" not in hard else F.col(name) < hard["max"])
    fill = _gaps(lambda k: step(_to_local(k, zone)), lambda a: _to_utc(back(a).cast("bigint"), zone), _bounds(body, "extended_bounds")) if least == 0 else None
    return Level(df, name, order=_order(name, body.get("order"), [F.asc(name)]), least=least, fill=fill)


def _auto_date_histogram(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    """The finest interval of a ladder that gives at most `buckets` buckets; one pass finds the ends."""
    millis = index.comparable(body["field"])[0]
    ends = df.agg(F.min(millis).alias("a"), F.max(millis).alias("b")).first()
    most = int(body.get("buckets", 10))
    if ends["a"] is None:
        return Level(df.withColumn(name, millis), name)
    span = ends["b"] - ends["a"]
    ladder = [("second", n * 1000) for n in (1, 5, 10, 30)] + [("minute", n * 60_000) for n in (1, 5, 10, 30)] + [("hour", n * 3_600_000) for n in (1, 3, 12)] + [("day", n * DAY) for n in (1, 7)]
    for _, size in ladder:
        if ends["b"] // size - ends["a"] // size + 1 <= most:
            return _date_histogram(index, df, name, {"field": body["field"], "fixed_interval": f"{size}ms"})
    for unit, size in (("month", 28 * DAY), ("quarter", 90 * DAY), ("year", 365 * DAY)):
        if span // size + 2 <= most or unit == "year":
            return _date_histogram(index, df, name, {"field": body["field"], "calendar_interval": unit})
    raise AssertionError


def _variable_width_histogram(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    """Buckets with about equal counts, cut at approximate quantiles; the key is a bucket's lower end."""
    x = _keyed(index, body)[0].cast("double")
    n = int(body.get("buckets", 10))
    cuts = df.agg(F.percentile_approx(x, [k / n for k in range(n)], 10_000).alias("q")).first()["q"] or []
    key = F.lit(None).cast("double")
    for cut in sorted(set(cuts)):
        key = F.when(x >= cut, F.lit(cut)).otherwise(key)
    return Level(df.withColumn(name, key), name, order=[F.asc(name)])


def _masked(df: DataFrame, name: str, conditions: list[tuple[str, Column]]) -> DataFrame:
    """Rows with the names of all conditions that hold, one row each: rows in several buckets count in each."""
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions)), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))


def _ranges(index: Index, df: DataFrame, name: str, body: dict, parse=float, column: Column | None = None) -> Level:
    x = column if column is not None else _keyed(index, body)[0].cast("double")
    found = []
    for r in body["ranges"]:
        low, high = (parse(r[k]) if r.get(k) is not None else None for k in ("from", "to"))
        label = r.get("key") or f"{'*' if low is None else low}-{'*' if high is None else high}"
        on = x.isNotNull()
        if low is not None:
            on &= x >= low
        if high is not None:
            on &= x < high
        found.append((low, high, label, on))
    found.sort(key=lambda r: (float("-inf") if r[0] is None else r[0], float("inf") if r[1] is None else r[1]))
    return Level(_masked(df, name, [(label, on) for _, _, label, on in found]), name, fixed=list(dict.fromkeys(r[2] for r in found)))


def _date_range(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    parse = lambda v: dates.interval(v, body.get("format"), body.get("time_zone"))[0]
    x = index.comparable(body["field"])[0]
    if "missing" in body:
        x = F.coalesce(x, F.lit(parse(body["missing"])))
    return _ranges(index, df, name, body, parse, x)


def _geo_distance(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    scale = space.metres("1" + body.get("unit", "m"))
    away = space.haversine(index.comparable(body["field"])[0], *space.point(body["origin"])) / scale
    return _ranges(index, df, name, body, float, away)


def _missing(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    found = index.column(body["field"])
    return Level(df.where(found[0].isNull()) if found else df, None)


def _filter(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    return Level(df.where(translate(index, body).pred), None)


def _filters(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    given = body["filters"]
    named = dict(sorted(given.items())) if isinstance(given, dict) else {str(k): f for k, f in enumerate(given)}
    conditions = [(k, translate(index, f).pred) for k, f in named.items()]
    other = body.get("other_bucket_key") or ("_other_" if body.get("other_bucket") else None)
    if other:
        none = F.lit(True)
        for _, c in conditions:
            none &= ~F.coalesce(c, F.lit(False))
        conditions.append((other, none))
    return Level(_masked(df, name, conditions), name, fixed=[k for k, _ in conditions])


def _adjacency_matrix(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    own = [(k, translate(index, f).pred) for k, f in sorted(body["filters"].items())]
    sep = body.get("separator", "&")
    pairs = [(f"{a}{sep}{b}", p & q) for k, (a, p) in enumerate(own) for b, q in own[k + 1 :]]
    return Level(_masked(df, name, own + pairs), name, order=[F.asc(name)])


def _sampler(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    """The best shard_size rows by score (here all of one shard), ties by key."""
    order = [F.col("_score").desc() if "_score" in df.columns else F.lit(0).desc(), *(F.col(k).asc() for k in index.keys)]
    return Level(df.orderBy(*order).limit(int(body.get("shard_size", 100))), None)


def _diversified_sampler(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    order = [F.col("_score").desc() if "_score" in df.columns else F.lit(0).desc(), *(F.col(k).asc() for k in index.keys)]
    value = index.comparable(body["field"])[0]
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(value).orderBy(*order)))
    few = ranked.where(F.col("__rank") <= int(body.get("max_docs_per_value", 1))).drop("__rank")
    return Level(few.orderBy(*order).limit(int(body.get("shard_size", 100))), None)


def _nested(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    """One row for each element, in place of the list."""
    path = body["path"]
    exploded = df.withColumn(path, F.explode(path))
    return Level(exploded, None, index=replace(index, df=exploded))


def _reverse_nested(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    if not index.key:
        raise Refused("reverse_nested needs a primary key")
    return Level(df, None, distinct=index.key)


def _geohash_grid(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    df = df.withColumn(name, space.geohash(index.comparable(body["field"])[0], int(body.get("precision", 5))))
    return Level(df, name, order=[F.desc("doc_count"), F.asc(name)], size=int(body.get("size", 10_000)))


def _geotile_grid(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    df = df.withColumn(name, space.tile(index.comparable(body["field"])[0], int(body.get("precision", 7))))
    return Level(df, name, order=[F.desc("doc_count"), F.asc(name)], size=int(body.get("size", 10_000)))


def _ip_range(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    x = space.ipv4(index.column(body["field"])[0])
    spans = [{"key": r.get("key") or r.get("mask") or f"{r.get('from', '*')}-{r.get('to', '*')}", "from": space.ip_block(r["mask"])[0] if "mask" in r else space.ip_block(r["from"])[0] if "from" in r else None, "to": space.ip_block(r["mask"])[1] + 1 if "mask" in r else space.ip_block(r["to"])[0] if "to" in r else None} for r in body["ranges"]]
    return _ranges(index, df, name, {"ranges": spans}, int, x)


def composite(index: Index, df: DataFrame, name: str, body: dict) -> Level:
    """Pages of key tuples, in the order of the sources; after: a tuple that the page lies strictly behind. The key is a struct of the sources."""
    columns, orders, after = [], [], body.get("after")
    for source in body["sources"]:
        own, spec = next(iter(source.items()))
        kind, given = next(iter(spec.items()))
        if kind == "terms":
            column = _keyed(index, given)[0]
        elif kind == "histogram":
            column = F.floor(_keyed(index, given)[0].cast("double") / float(given["interval"])) * float(given["interval"])
        elif kind == "date_histogram":
            column = _date_histogram(index, df, "__k", given | {"min_doc_count": 1}).df
            raise_key = F.floor(_local(index, given) / F.lit(int(_duration(given["fixed_interval"])))) * int(_duration(given["fixed_interval"])) if "fixed_interval" in given else _truncated(_local(index, given), CALENDAR[str(given["calendar_interval"])])
            column = _to_utc((raise_key + int(_offset(given.get("offset", 0)))).cast("bigint"), given.get("time_zone"))
        elif kind == "geotile_grid":
            column = space.tile(index.comparable(given["field"])[0], int(given.get("precision", 7)))
        else:
            raise Refused(f"composite source [{kind}] isn't served")
        columns.append((own, column, bool(given.get("missing_bucket"))))
        orders.append(given.get("order", "asc"))
    for own, column, missing in columns:
        df = df.withColumn(f"{name}.{own}", column)
        if not missing:
            df = df.where(F.col(f"`{name}.{own}`").isNotNull())
    if after:
        pred, equal = F.lit(False), F.lit(True)
        for (own, _, _), order in zip(columns, orders):
            c = F.col(f"`{name}.{own}`")
            if after[own] is None:
                pred |= equal & c.isNotNull()
                equal &= c.isNull()
            else:
                pred |= equal & F.coalesce((c > after[own]) if order == "asc" else (c < after[own]), F.lit(False))
                equal &= F.coalesce(c == F.lit(after[own]), F.lit(False))
        df = df.where(pred)
    key = F.struct(*(F.col(f"`{name}.{own}`").alias(own) for own, _, _ in columns))
    df = df.withColumn(name, key).drop(*(f"{name}.{own}" for own, _, _ in columns))
    sort = [F.col(f"{name}.{own}").asc_nulls_first() if o == "asc" else F.col(f"{name}.{own}").desc_nulls_last() for (own, _, _), o in zip(columns, orders)]
    return Level(df, name, order=sort, size=int(body.get("size", 10)))


_BUCKETS = {
    "terms": _terms, "multi_terms": _multi_terms, "histogram": _histogram, "date_histogram": _date_histogram, "auto_date_histogram": _auto_date_histogram, "variable_width_histogram": _variable_width_histogram, "range": _ranges, "date_range": _date_range, "ip_range": _ip_range, "missing": _missing, "filter": _filter, "filters": _filters,
    "adjacency_matrix": _adjacency_matrix, "composite": composite, "sampler": _sampler, "diversified_sampler": _diversified_sampler, "nested": _nested, "reverse_nested": _reverse_nested, "geo_distance": _geo_distance, "geohash_grid": _geohash_grid, "geotile_grid": _geotile_grid,
}
