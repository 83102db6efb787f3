"""The query clause: each kind becomes a predicate and a score, both columns over the table."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import dates, space
from ..functions import text as fn
from ..sources.catalog import Index
from . import fulltext

MAX_TERMS = 65_536
REFUSED = ("intervals", "match_phrase_prefix", "span_term", "span_near", "span_first", "span_or", "span_not", "span_multi", "span_containing", "span_within", "more_like_this", "has_child", "has_parent", "parent_id")


@dataclass
class Clause:
    """pred: whether a row matches; null counts as no. It stays as plain as the query allows, since a comparison inside coalesce() isn't pushed to the scan. score: the score where it matches."""

    pred: Column
    score: Column

    @classmethod
    def of(cls, pred: Column, boost: float = 1.0) -> "Clause":
        return cls(pred, F.lit(float(boost)))

    def certain(self) -> Column:
        """pred without nulls."""
        return F.coalesce(self.pred, F.lit(False))


def translate(index: Index, query: dict | None) -> Clause:
    if not query:
        return Clause.of(F.lit(True))
    if len(query) != 1:
        raise Refused(f"a query has one kind, not {sorted(query)}")
    kind, body = next(iter(query.items()))
    if kind in REFUSED:
        raise Refused(f"[{kind}] isn't served")
    if kind not in _KINDS:
        raise Refused(f"unknown query [{kind}]")
    return _KINDS[kind](index, body)


def _one_field(body: dict, shorthand: str = "value") -> tuple[str, dict]:
    names = [k for k in body if k not in ("boost", "_name")]
    if len(names) != 1:
        raise Refused(f"one field is needed, not {names}")
    value = body[names[0]]
    return names[0], value if isinstance(value, dict) else {shorthand: value}


def literal(value, kind: str, at: T.DataType) -> Column:
    """A value in the column's type: whole numbers up to 2 ** 53, single precision for float."""
    if isinstance(at, T.BooleanType):
        if isinstance(value, str):
            value = {"true": True, "false": False, "": False}.get(value)
        if not isinstance(value, bool):
            raise Refused(f"[{value}] is not a boolean")
        return F.lit(value)
    if isinstance(at, T.IntegralType):
        try:
            number = float(value)
        except (TypeError, ValueError) as e:
            raise Refused(f"[{value}] is not a number") from e
        if not isinstance(value, int) and (number != int(number) or abs(number) > 2**53):
            raise Refused(f"[{value}] is not a whole number up to 2^53")
        return F.lit(int(value if isinstance(value, int) else number))
    if isinstance(at, (T.FloatType, T.DoubleType, T.DecimalType)):
        try:
            return F.lit(float(value)).cast(at)
        except (TypeError, ValueError) as e:
            raise Refused(f"[{value}] is not a number") from e
    return F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def _equals(index: Index, name: str, value, ignore_case: bool = False, format: str | None = None) -> Column:
    found = index.column(name)
    if found is None:
        return F.lit(False)
    column, kind, at = found
    if kind == "date":
        low, high = dates.interval(value, format)
        return (column >= dates.bound(low, at)) & (column < dates.bound(high + 1, at))
    if kind == "ip":
        low, high = space.ip_block(str(value))
        return space.ipv4(column).between(low, high)
    if isinstance(at, T.ArrayType):
        if not isinstance(at.elementType, T.StringType):
            raise Refused(f"[{name}] can't be compared")
        return F.array_contains(column, str(value))
    if ignore_case and isinstance(at, T.StringType):
        return F.lower(column) == str(value).lower()
    return column == literal(value, kind, at)


def _term(index: Index, body: dict) -> Clause:
    name, given = _one_field(body)
    return Clause.of(_equals(index, name, given["value"], given.get("case_insensitive", False)), given.get("boost", 1.0))


def _terms(index: Index, body: dict) -> Clause:
    name, _ = _one_field(body)
    values = body[name]
    if len(values) > MAX_TERMS:
        raise Refused(f"at most {MAX_TERMS} terms")
    found = index.column(name)
    if found is None or not values:
        return Clause.of(F.lit(False))
    column, kind, at = found
    if kind in ("date", "ip"):
        return Clause.of(reduce(lambda a, b: a | b, (_equals(index, name, v) for v in values)), body.get("boost", 1.0))
    if isinstance(at, T.ArrayType):
        return Clause.of(F.arrays_overlap(column, F.array(*(F.lit(str(v)) for v in values))), body.get("boost", 1.0))
    return Clause.of(column.isin(*(literal(v, kind, at) for v in values)), body.get("boost", 1.0))


def _ids(index: Index, body: dict) -> Clause:
    if not index.key:
        return Clause.of(F.lit(False))
    at = index.df.schema[index.key].dataType
    values = []
    for v in sorted(set(body["values"]), key=str):
        if isinstance(at, T.IntegralType) and not re.fullmatch(r"-?\d+", str(v)):
            continue
        values.append(int(v) if isinstance(at, T.IntegralType) else str(v))
    return Clause.of(F.col(index.key).isin(values) if values else F.lit(False), body.get("boost", 1.0))


def _exists(index: Index, body: dict) -> Clause:
    found = index.column(body["field"])
    return Clause.of(found[0].isNotNull() if found else F.lit(False), body.get("boost", 1.0))


def _range(index: Index, body: dict) -> Clause:
    name, given = _one_field(body)
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    column, kind, at = found
    out = column.isNotNull()
    if kind == "date":
        # bounds in the column's own type reach the scan
        for op in ("gt", "gte", "lt", "lte"):
            if given.get(op) is not None:
                low, high = dates.interval(given[op], given.get("format"), given.get("time_zone"))
                end = dates.bound(high + 1 if op in ("gt", "lte") else low, at)
                out &= column >= end if op in ("gt", "gte") else column < end
        return Clause.of(out, given.get("boost", 1.0))
    if kind == "ip":
        own, value = space.ipv4(column), lambda v: F.lit(space.ip_block(str(v))[0])
    elif isinstance(at, T.ArrayType):
        raise Refused(f"[{name}]: ranges of lists aren't served")
    else:
        own, value = column, lambda v: _bound_of(v, kind, at)
    for op, compare in (("gt", lambda a, b: a > b), ("gte", lambda a, b: a >= b), ("lt", lambda a, b: a < b), ("lte", lambda a, b: a <= b)):
        if given.get(op) is not None:
            out &= compare(own, value(given[op]))
    return Clause.of(out, given.get("boost", 1.0))


def _bound_of(value, kind: str, at: T.DataType) -> Column:
    # a bound of an integer column may have a fraction
    if isinstance(at, T.IntegralType) and isinstance(value, float) and value != int(value):
        return F.lit(value)
    return literal(value, kind, at)


def _text_column(index: Index, name: str):
    found = index.column(name)
    if found is None:
        return None
    if not isinstance(found[2], T.StringType):
        raise Refused(f"[{name}] is not a string")
    return found[0]


def _pattern(make):
    def run(index: Index, body: dict) -> Clause:
        name, given = _one_field(body)
        column = _text_column(index, name)
        if column is None:
            return Clause.of(F.lit(False))
        return Clause.of(make(column, given.get("value", given.get("wildcard")), bool(given.get("case_insensitive"))), given.get("boost", 1.0))

    return run


def _prefix(column: Column, value: str, ignore_case: bool) -> Column:
    return F.lower(column).startswith(value.lower()) if ignore_case else column.startswith(value)


def _fuzzy(index: Index, body: dict) -> Clause:
    name, given = _one_field(body)
    column = _text_column(index, name)
    if column is None:
        return Clause.of(F.lit(False))
    text = str(given["value"])
    distance = fn.fuzziness(given.get("fuzziness", "AUTO"), text)
    near = lambda c: fn.within(c, text, distance, int(given.get("prefix_length", 0)))
    if index.overrides.get(name, {}).get("type") == "text":
        return Clause.of(F.exists(fulltext.analyzer_of(index, name).column(column), near), given.get("boost", 1.0))
    return Clause.of(near(column), given.get("boost", 1.0))


def _list(x) -> list:
    return x if isinstance(x, list) else [x] if x else []


def _bool(index: Index, body: dict) -> Clause:
    must, should = ([translate(index, q) for q in _list(body.get(k))] for k in ("must", "should"))
    filters, never = ([translate(index, q) for q in _list(body.get(k))] for k in ("filter", "must_not"))
    if body.get("adjust_pure_negative") is False and never and not (must or should or filters):
        raise Refused("a purely negative bool with adjust_pure_negative false matches nothing by design")
    pred = F.lit(True)
    for c in (*must, *filters):
        pred &= c.pred
    for c in never:
        pred &= ~c.certain()
    least = body.get("minimum_should_match")
    if should:
        least = (0 if must or filters else 1) if least is None else _minimum(least, len(should))
        if least == 1:
            pred &= reduce(lambda a, b: a | b, (c.pred for c in should))
        elif least > 1:
            pred &= reduce(lambda a, b: a + b, (c.certain().cast("int") for c in should)) >= least
    score = F.lit(0.0)
    for c in must:
        score += c.score
    for c in should:
        score += F.when(c.pred, c.score).otherwise(0.0)
    if not must and not should:
        # filters give no score; a purely negative bool is a match_all with exclusions
        score = F.lit(0.0 if filters else 1.0)
    return Clause(pred, score * F.lit(float(body.get("boost", 1.0))))


def _minimum(given, n: int) -> int:
    text = str(given)
    if text.endswith("%"):
        share = float(text[:-1])
        k = int(n * abs(share) / 100)
        return k if share >= 0 else n - k
    k = int(text)
    return k if k >= 0 else n + k


def _constant_score(index: Index, body: dict) -> Clause:
    return Clause(translate(index, body["filter"]).pred, F.lit(float(body.get("boost", 1.0))))


def _dis_max(index: Index, body: dict) -> Clause:
    own = [translate(index, q) for q in _list(body.get("queries"))]
    if not own:
        return Clause.of(F.lit(False))
    scores = [F.when(c.pred, c.score).otherwise(0.0) for c in own]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    tie = float(body.get("tie_breaker", 0.0))
    total = best + (reduce(lambda a, b: a + b, scores) - best) * tie if tie else best
    return Clause(reduce(lambda a, b: a | b, (c.pred for c in own)), total * F.lit(float(body.get("boost", 1.0))))


def _boosting(index: Index, body: dict) -> Clause:
    good, bad = translate(index, body["positive"]), translate(index, body["negative"])
    return Clause(good.pred, good.score * F.when(bad.pred, float(body.get("negative_boost", 0.5))).otherwise(1.0))


def script(source) -> Column:
    """A script is a Spark SQL expression over columns, or {"source": ..., "params": {...}} with :name parameters."""
    if isinstance(source, dict):
        text = source.get("source", "")
        for k, v in (source.get("params") or {}).items():
            text = re.sub(rf":{k}\b", json.dumps(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'", text)
        return F.expr(text)
    return F.expr(source)


def _function_score(index: Index, body: dict) -> Clause:
    if "min_score" in body or "script_score" in body:
        raise Refused("function_score with min_score or script_score isn't served")
    inner = translate(index, body.get("query"))
    functions = body.get("functions") or [{k: v for k, v in body.items() if k in ("field_value_factor", "weight", "random_score", "gauss", "exp", "linear")}]
    values = []
    for f in functions:
        value = _function(index, f)
        on = translate(index, f["filter"]).certain() if "filter" in f else F.lit(True)
        values.append((on, value))
    mode = body.get("score_mode", "multiply")
    some = reduce(lambda a, b: a | b, (on for on, _ in values))
    neutral = {"multiply": 1.0, "sum": 0.0, "avg": 0.0, "max": float("-inf"), "min": float("inf"), "first": None}[mode]
    if mode == "first":
        total = F.coalesce(*(F.when(on, v) for on, v in values))
    else:
        each = [F.when(on, v).otherwise(F.lit(neutral)) for on, v in values]
        if mode == "multiply":
            total = reduce(lambda a, b: a * b, each)
        elif mode in ("sum", "avg"):
            total = reduce(lambda a, b: a + b, each)
            if mode == "avg":
                total = total / reduce(lambda a, b: a + b, (on.cast("double") for on, _ in values))
        else:
            total = each[0] if len(each) == 1 else (F.greatest if mode == "max" else F.least)(*each)
    total = F.least(F.when(some, total).otherwise(1.0), F.lit(float(body.get("max_boost", 3.4e38))))
    joined = {"multiply": inner.score * total, "replace": total, "sum": inner.score + total, "avg": (inner.score + total) / 2, "max": F.greatest(inner.score, total), "min": F.least(inner.score, total)}[body.get("boost_mode", "multiply")]
    return Clause(inner.pred, joined * F.lit(float(body.get("boost", 1.0))))


def _function(index: Index, f: dict) -> Column:
    weight = F.lit(float(f.get("weight", 1.0)))
    if given := f.get("field_value_factor"):
        x = index.comparable(given["field"])[0].cast("double")
        if "missing" in given:
            x = F.coalesce(x, F.lit(float(given["missing"])))
        x = x * float(given.get("factor", 1.0))
        change = {"none": lambda v: v, "log": F.log10, "log1p": lambda v: F.log10(v + 1), "log2p": lambda v: F.log10(v + 2), "ln": F.ln, "ln1p": F.log1p, "ln2p": lambda v: F.ln(v + 2), "square": lambda v: v * v, "sqrt": F.sqrt, "reciprocal": lambda v: 1 / v}[given.get("modifier", "none")]
        return weight * change(x)
    if "random_score" in f:
        seed = int((f["random_score"] or {}).get("seed", 0))
        keys = index.keys or tuple(c for c, t in index.df.dtypes if "map" not in t)
        return weight * (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 24)) / float(1 << 24))
    for shape in ("gauss", "exp", "linear"):
        if shape in f:
            name, given = next((k, v) for k, v in f[shape].items() if k != "multi_value_mode")
            column, kind, _ = index.comparable(name)
            decay, offset = float(given.get("decay", 0.5)), given.get("offset", 0)
            if kind == "geo_point":
                away, scale, offset = space.haversine(column, *space.point(given["origin"])), space.metres(given["scale"]), space.metres(offset)
            elif kind == "date":
                origin = dates.interval(given.get("origin", "now"))[0]
                away, scale, offset = F.abs(column - origin), _duration(given["scale"]), _duration(offset)
            else:
                away, scale, offset = F.abs(column - float(given["origin"])), float(given["scale"]), float(offset)
            import math

            away = F.greatest(F.lit(0.0), away.cast("double") - float(offset))
            if shape == "gauss":
                return weight * F.exp(away * away * (math.log(decay) / scale**2))
            if shape == "exp":
                return weight * F.exp(away * (math.log(decay) / scale))
            s = scale / (1 - decay)
            return weight * F.greatest(F.lit(0.0), (F.lit(s) - away) / s)
    return weight


def _duration(text) -> float:
    if isinstance(text, (int, float)):
        return float(text)
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h|d|w)?", text)
    if not m:
        raise Refused(f"[{text}] is not a duration")
    return float(m[1]) * {"ms": 1, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7, "w": 6.048e8, None: 1}[m[2]]


def _terms_set(index: Index, body: dict) -> Clause:
    name, given = _one_field(body, "terms")
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    column, kind, at = found
    terms = list(dict.fromkeys(given["terms"]))
    if isinstance(at, T.ArrayType):
        n = F.size(F.array_intersect(column, F.array(*(F.lit(str(t)) for t in terms))))
    else:
        n = reduce(lambda a, b: a + b, (F.coalesce(column == literal(t, kind, at), F.lit(False)).cast("int") for t in terms))
    least = F.col(given["minimum_should_match_field"]) if "minimum_should_match_field" in given else script(given["minimum_should_match_script"]) if "minimum_should_match_script" in given else F.lit(1)
    return Clause.of(n >= least, given.get("boost", 1.0))


def _match(index: Index, body: dict) -> Clause:
    name, given = _one_field(body, "query")
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    text, boost = given["query"], float(given.get("boost", 1.0))
    if index.overrides.get(name, {}).get("type") == "text":
        if "analyzer" in given:
            raise Refused("an explicit analyzer isn't served")
        return Clause(*fulltext.match(index, name, str(text), given.get("operator", "OR"), given.get("fuzziness"), int(given.get("prefix_length", 0)), int(given.get("max_expansions", 50)), boost))
    return Clause.of(_equals(index, name, text), boost)


def _phrase(index: Index, body: dict) -> Clause:
    name, given = _one_field(body, "query")
    if index.column(name) is None:
        return Clause.of(F.lit(False))
    if index.overrides.get(name, {}).get("type") != "text":
        return Clause.of(_equals(index, name, given["query"]), given.get("boost", 1.0))
    return Clause(*fulltext.phrase(index, name, given["query"], int(given.get("slop", 0)), float(given.get("boost", 1.0))))


def _multi_match(index: Index, body: dict) -> Clause:
    if body.get("type", "best_fields") != "best_fields" or "tie_breaker" in body:
        raise Refused("multi_match is served with best_fields and no tie_breaker")
    return Clause(*fulltext.multi_match(index, body["fields"], body["query"], body.get("operator", "OR"), body.get("boosts"), float(body.get("boost", 1.0))))


def _fts_bool(index: Index, body: dict) -> Clause:
    for k in ("must", "should", "must_not"):
        for q in _list(body.get(k)):
            if next(iter(q)) not in TEXT_KINDS:
                raise Refused(f"fts_bool takes full-text clauses, not [{next(iter(q))}]")
    return _bool(index, {k: body.get(k) for k in ("must", "should", "must_not")} | {"boost": body.get("boost", 1.0)})


def _nested(index: Index, body: dict) -> Clause:
    path = body["path"]
    found = index.column(path)
    if found is None:
        return Clause.of(F.lit(False))
    column, kind, at = found
    if kind != "nested":
        raise Refused(f"[{path}] is not nested")

    # conditions hold jointly for one element
    return Clause.of(F.exists(column, lambda e: translate(Element(path, e, at.elementType), body["query"]).pred), body.get("boost", 1.0))


class Element:
    """An element of a nested column, to be asked for columns as an Index is."""

    key, keys, overrides, renamed = None, (), {}, {}

    def __init__(self, path: str, value: Column, at: T.StructType):
        self.name, self.value, self.at = path, value, at

    def column(self, name: str) -> tuple[Column, str, T.DataType] | None:
        own, at = self.value, self.at
        for part in name.removeprefix(self.name + ".").split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                return None
            own, at = own[part], at[part].dataType
        return own, Index.kind(at), at

    def comparable(self, name: str) -> tuple[Column, str, T.DataType]:
        found = self.column(name)
        if found is None:
            raise Refused(f"[{name}] does not map to a column")
        own, kind, at = found
        if kind == "date":
            return dates.to_millis(own, at.simpleString()), kind, at
        return (own.cast("int") if kind == "boolean" else own), kind, at

    def mapping(self) -> dict[str, str]:
        return {f"{self.name}.{f.name}": Index.kind(f.dataType) for f in self.at}


_KINDS = {}
TEXT_KINDS = ("match", "match_phrase", "multi_match", "fts_match", "fts_phrase", "fts_multi_match", "fts_bool", "fts_boost")


def _geo_distance(index: Index, body: dict) -> Clause:
    name = next(k for k in body if k not in ("distance", "boost", "_name", "distance_type"))
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    return Clause.of(space.haversine(found[0], *space.point(body[name])) <= space.metres(body["distance"]), body.get("boost", 1.0))


def _geo_box(index: Index, body: dict) -> Clause:
    name = next(k for k in body if k not in ("boost", "_name", "type"))
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    p, box = found[0], body[name]
    (top, left), (bottom, right) = space.point(box["top_left"]), space.point(box["bottom_right"])
    across = (p["lon"] >= left) & (p["lon"] <= right) if left <= right else (p["lon"] >= left) | (p["lon"] <= right)
    return Clause.of(p["lat"].between(bottom, top) & across, body.get("boost", 1.0))


def _geo_polygon(index: Index, body: dict) -> Clause:
    name = next(k for k in body if k not in ("boost", "_name"))
    found = index.column(name)
    if found is None:
        return Clause.of(F.lit(False))
    return Clause.of(space.in_polygon(found[0], [space.point(x) for x in body[name]["points"]]), body.get("boost", 1.0))


def _script(index: Index, body: dict) -> Clause:
    return Clause.of(script(body["script"]), body.get("boost", 1.0))


def _script_score(index: Index, body: dict) -> Clause:
    inner = translate(index, body.get("query"))
    score = script(body["script"]).cast("double")
    pred = inner.pred & (score >= float(body["min_score"])) if "min_score" in body else inner.pred
    return Clause(pred, score * F.lit(float(body.get("boost", 1.0))))


def _wrapper(index: Index, body: dict) -> Clause:
    return translate(index, json.loads(base64.b64decode(body["query"])))


def _simple_query_string(index: Index, body: dict) -> Clause:
    """+ and, | or, - not, "phrases", prefix*, (groups); words are joined by default_operator."""
    fields = body.get("fields") or [n for n, k in index.mapping().items() if k in ("text", "keyword")]
    default = str(body.get("default_operator", "or")).lower()
    pieces = re.findall(r'-?"[^"]*"|[()|+]|-?[^\s()|+"]+', body["query"])
    at = 0

    def field_query(piece: str) -> dict:
        def each(f: str) -> dict:
            name = f.split("^")[0]
            if piece.startswith('"'):
                return {"match_phrase": {name: piece[1:-1]}}
            return {"prefix": {name: piece[:-1]}} if piece.endswith("*") else {"match": {name: piece}}

        return {"dis_max": {"queries": [each(f) for f in fields]}}

    def primary() -> dict:
        nonlocal at
        piece = pieces[at]
        at += 1
        if piece == "(":
            inner = either()
            at += at < len(pieces) and pieces[at] == ")"
            return inner
        if piece.startswith("-") and len(piece) > 1:
            return {"bool": {"must_not": [field_query(piece[1:])]}}
        return field_query(piece)

    def either() -> dict:
        nonlocal at
        groups: list[list[dict]] = [[]]
        required = default == "and"
        while at < len(pieces) and pieces[at] != ")":
            if pieces[at] == "|":
                at += 1
                groups.append([primary()] if at < len(pieces) and pieces[at] != ")" else [])
            elif pieces[at] == "+":
                at += 1
                if at < len(pieces) and pieces[at] != ")":
                    groups[-1].append(primary())
            elif required or not groups[-1]:
                groups[-1].append(primary())
            else:
                groups.append([primary()])
        own = [g[0] if len(g) == 1 else {"bool": {"must": g}} for g in groups if g]
        return own[0] if len(own) == 1 else {"bool": {"should": own}}

    return translate(index, either()) if pieces else Clause.of(F.lit(False))


def _query_string(index: Index, body: dict) -> Clause:
    """field:value, field:[a TO b], AND, OR, NOT, (groups), "phrases", wildcards; the default field or fields otherwise."""
    pieces = re.findall(r'[\w.]+:[\[{][^\]}]*[\]}]|[\w.]+:"[^"]*"|"[^"]*"|[()]|[^\s()]+', body["query"])
    default = body.get("default_field")
    fields = [default] if default else body.get("fields") or [n for n, k in index.mapping().items() if k in ("text", "keyword")]
    joint = str(body.get("default_operator", "or")).lower()
    at = 0

    def leaf(piece: str) -> dict:
        name, sep, value = piece.partition(":")
        names = [name] if sep else fields
        value = value if sep else piece
        if m := re.fullmatch(r"([\[{])(\S+) TO (\S+)([\]}])", value):
            ends = {}
            if m[2] != "*":
                ends["gte" if m[1] == "[" else "gt"] = m[2]
            if m[3] != "*":
                ends["lte" if m[4] == "]" else "lt"] = m[3]
            return {"range": {names[0]: ends}}
        if m := re.fullmatch(r"(>=|<=|>|<)(.+)", value):
            return {"range": {names[0]: {{">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}[m[1]]: m[2]}}}

        def each(n: str) -> dict:
            if value == "*":
                return {"exists": {"field": n}}
            if value.startswith('"'):
                return {"match_phrase": {n: value[1:-1]}}
            return {"wildcard": {n: value}} if re.search(r"[*?]", value) else {"match": {n: value}}

        return each(names[0]) if len(names) == 1 else {"dis_max": {"queries": [each(n) for n in names]}}

    def unary() -> dict:
        nonlocal at
        piece = pieces[at]
        at += 1
        if piece == "NOT":
            return {"bool": {"must_not": [unary()]}}
        if piece == "(":
            inner = either()
            at += 1
            return inner
        if piece[0] in "+-" and len(piece) > 1:
            inner = leaf(piece[1:])
            return {"bool": {"must_not": [inner]}} if piece[0] == "-" else inner
        return leaf(piece)

    def both() -> dict:
        nonlocal at
        own = [unary()]
        while at < len(pieces) and pieces[at] not in ("OR", ")"):
            if pieces[at] == "AND":
                at += 1
            elif joint != "and":
                break
            own.append(unary())
        return own[0] if len(own) == 1 else {"bool": {"must": own}}

    def either() -> dict:
        nonlocal at
        own = [both()]
        while at < len(pieces) and pieces[at] != ")":
            if pieces[at] == "OR":
                at += 1
            own.append(both())
        return own[0] if len(own) == 1 else {"bool": {"should": own}}

    return translate(index, either()) if pieces else Clause.of(F.lit(False))


_KINDS.update({
    "match_all": lambda i, b: Clause.of(F.lit(True), (b or {}).get("boost", 1.0)), "match_none": lambda i, b: Clause.of(F.lit(False)), "term": _term, "terms": _terms, "ids": _ids, "exists": _exists, "range": _range,
    "wildcard": _pattern(fn.wildcard), "regexp": _pattern(fn.regexp), "prefix": _pattern(_prefix), "fuzzy": _fuzzy, "bool": _bool, "constant_score": _constant_score, "dis_max": _dis_max, "boosting": _boosting, "function_score": _function_score, "terms_set": _terms_set,
    "match": _match, "match_phrase": _phrase, "multi_match": _multi_match, "fts_match": _match, "fts_phrase": _phrase, "fts_multi_match": _multi_match, "fts_bool": _fts_bool, "fts_boost": _boosting, "nested": _nested, "geo_distance": _geo_distance, "geo_bounding_box": _geo_box, "geo_polygon": _geo_polygon,
    "script": _script, "script_score": _script_score, "wrapper": _wrapper, "simple_query_string": _simple_query_string, "query_string": _query_string,
})
