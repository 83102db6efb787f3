"""Full text: BM25 as a column. One small aggregation gives the statistics of the query's terms; the score is then computed where the text is read, without a shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.text import count_tokens, fuzziness, split_query, tokens, within
from ..sources.catalog import Index

K1, B = 1.2, 0.75


@dataclass
class Analyzer:
    tokenizer: str = "simple"
    lower: bool = False
    n: int = 3

    def column(self, text: Column) -> Column:
        return tokens(F.coalesce(text, F.lit("")), self.tokenizer, self.lower, self.n)

    def may_hold(self, text: Column, token: str) -> Column:
        """Whether the characters of the token are in the text: needed for the token, and quick."""
        return F.contains(F.lower(text) if self.lower else text, F.lit(token))

    def length(self, text: Column) -> Column:
        return count_tokens(F.coalesce(text, F.lit("")), self.tokenizer, self.lower, self.n)

    def holds(self, text: Column, split: Column, token: str) -> Column:
        """Whether the token is one of the text's, which are in split. An n-gram is one wherever its characters are, so nothing is split."""
        may = self.may_hold(text, token)
        return may if self.tokenizer == "ngram" and len(token) == self.n else may & F.array_contains(split, token)

    def query(self, text: str) -> list[str]:
        return split_query(text, self.tokenizer, self.lower, self.n)


@dataclass
class Statistics:
    """Of one field over the whole table: rows with text, average length, and rows that hold each term."""

    rows: int
    average: float
    holding: dict[str, int] = field(default_factory=dict)

    def idf(self, term: str) -> float:
        n = self.holding.get(term, 0)
        return math.log(1 + (self.rows - n + 0.5) / (n + 0.5))


def analyzer_of(index: Index, name: str) -> Analyzer:
    given = index.overrides.get(name, {})
    return Analyzer(given.get("tokenizer", "simple"), given.get("lower", False), given.get("n", 3))


def statistics(index: Index, name: str, terms: list[str]) -> Statistics:
    """One pass over the field's column. The result has a number for each term."""
    a = analyzer_of(index, name)
    text = F.col("x")
    own = index.df.select(F.col(name).alias("x"), a.column(F.col(name)).alias("t"), F.col(name).isNotNull().alias("has"))
    each = [F.count_if(a.holds(text, F.col("t"), term)).alias(f"h{k}") for k, term in enumerate(terms)]
    length = a.length(text) if a.tokenizer == "ngram" else F.size("t")
    r = own.agg(F.count_if("has").alias("rows"), F.avg(F.when(F.col("has"), length)).alias("average"), *each).first()
    return Statistics(r["rows"], r["average"] or 1.0, {t: r[f"h{k}"] for k, t in enumerate(terms)})


def _bm25(frequency: Column, length: Column, idf: float, average: float) -> Column:
    f = frequency.cast("double")
    return F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / F.lit(max(average, 1e-9))))


def expand(index: Index, name: str, term: str, distance: int, prefix: int, most: int) -> list[str]:
    """The field's terms within the distance: the closest first, then the most frequent, at most max_expansions."""
    a = analyzer_of(index, name)
    near = F.filter(F.array_distinct(a.column(F.col(name))), lambda t: within(t, term, distance, prefix))
    counted = index.df.select(F.explode(near).alias("t")).groupBy("t").count()
    return [r["t"] for r in counted.orderBy(F.levenshtein("t", F.lit(term)), F.desc("count"), "t").limit(most).collect()]


def match(index: Index, name: str, text: str, operator: str = "OR", fuzzy=None, prefix_length: int = 0, max_expansions: int = 50, boost: float = 1.0) -> tuple[Column, Column]:
    """(predicate, score). OR: any term; AND: every term (or, if fuzzy, one of its expansions)."""
    a = analyzer_of(index, name)
    terms = list(dict.fromkeys(a.query(text)))
    if not terms:
        return F.lit(False), F.lit(0.0)
    groups = {t: [t] for t in terms}
    for t in terms:
        if k := fuzziness(fuzzy, t):
            groups[t] = list(dict.fromkeys([t, *expand(index, name, t, k, prefix_length, max_expansions)]))
    every = list(dict.fromkeys(x for g in groups.values() for x in g))
    s = statistics(index, name, every)
    own = a.column(F.col(name))
    both = (lambda x, y: x & y) if str(operator).upper() == "AND" else (lambda x, y: x | y)
    # a text without a term's characters is not split at all
    likely = reduce(both, (reduce(lambda x, y: x | y, (a.may_hold(F.col(name), x) for x in g)) for g in groups.values()))
    predicate = likely & _bound(own, lambda t: reduce(both, (reduce(lambda x, y: x | y, (F.array_contains(t, x) for x in g)) for g in groups.values())))
    # the token array is bound once; each term's frequency is read from it
    score = _bound(own, lambda t: reduce(lambda x, y: x + y, (_bm25(_frequency(t, x), F.size(t), s.idf(x), s.average) for x in every)))
    return F.coalesce(predicate, F.lit(False)), score * F.lit(float(boost))


def _frequency(t: Column, term: str) -> Column:
    return F.size(F.filter(t, lambda w: w == F.lit(term)))


def _bound(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def phrase(index: Index, name: str, text: str, slop: int = 0, boost: float = 1.0) -> tuple[Column, Column]:
    """(predicate, score): the terms in order, with at most slop other tokens among them. The score counts the places where it starts."""
    if slop < 0:
        raise Refused("slop can't be negative")
    a = analyzer_of(index, name)
    terms = a.query(text)
    if not terms:
        return F.lit(False), F.lit(0.0)
    s = statistics(index, name, list(dict.fromkeys(terms)))
    idf = sum(s.idf(t) for t in terms)

    def starts(t: Column) -> Column:
        # places of the first term
        places = F.filter(F.transform(t, lambda x, i: F.when(x == F.lit(terms[0]), i + 1)), lambda i: i.isNotNull())

        def end(i: Column) -> Column:
            at = i
            if not slop:
                for term in terms[1:]:
                    at = F.when(F.try_element_at(t, at + 1) == F.lit(term), at + 1)
                return at
            for term in terms[1:]:
                # the nearest later place; null if there is none
                rest = F.array_position(F.slice(t, at + 1, F.size(t)), term)
                at = F.when(rest > 0, at + rest.cast("int"))
            return at

        return F.size(F.filter(places, lambda i: F.coalesce(end(i) - i - (len(terms) - 1) <= slop, F.lit(False))))

    own = a.column(F.col(name))
    likely = reduce(lambda x, y: x & y, (a.may_hold(F.col(name), x) for x in dict.fromkeys(terms)))
    frequency = F.when(likely, _bound(own, starts))
    score = _bound(own, lambda t: _bm25(starts(t), F.size(t), idf, s.average))
    return F.coalesce(frequency > 0, F.lit(False)), score * F.lit(float(boost))


def multi_match(index: Index, fields: list[str], text: str, operator: str = "OR", boosts: dict[str, float] | None = None, boost: float = 1.0, **more) -> tuple[Column, Column]:
    """The best field's score; fields may carry a boost as name^2."""
    found = []
    for f in fields:
        name, _, own = f.partition("^")
        if "*" in name:
            raise Refused("patterns of fields aren't served")
        p, s = match(index, name, text, operator, boost=float(own or (boosts or {}).get(name, 1.0)), **more)
        found.append((p, F.when(p, s).otherwise(0.0)))
    predicate = reduce(lambda x, y: x | y, (p for p, _ in found))
    best = found[0][1] if len(found) == 1 else F.greatest(*(s for _, s in found))
    return predicate, best * F.lit(float(boost))
