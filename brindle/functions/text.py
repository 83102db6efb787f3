"""Tokenizers and text predicates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Refused


def tokens(text: Column, tokenizer: str = "simple", lower: bool = False, n: int = 3) -> Column:
    """The tokens of a text, in order. simple: runs of letters and digits; whitespace; raw: the text; ngram: n characters each."""
    x = F.lower(text) if lower else text
    if tokenizer == "simple":
        return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if tokenizer == "whitespace":
        return F.filter(F.split(x, r"\s+"), lambda t: t != "")
    if tokenizer == "raw":
        return F.array(x)
    if tokenizer == "ngram":
        # one walk over the text: a character is taken at a time, with what follows it looked at. A substring would count from the text's beginning each time
        return F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{int(n)}}}))."), F.lit(1))
    raise Refused(f"tokenizer [{tokenizer}] isn't served")


def count_tokens(text: Column, tokenizer: str = "simple", lower: bool = False, n: int = 3) -> Column:
    """How many tokens there are. Those of ngram are counted without being made."""
    if tokenizer == "ngram":
        length = F.length(F.lower(text) if lower else text)
        return F.when(length.isNotNull(), F.greatest(length - (n - 1), F.lit(0)))
    return F.size(tokens(text, tokenizer, lower, n))


def split_query(text: str, tokenizer: str = "simple", lower: bool = False, n: int = 3) -> list[str]:
    """The same tokens of a query's text."""
    import regex

    x = text.lower() if lower else text
    if tokenizer == "simple":
        return regex.findall(r"[\p{L}\p{N}]+", x)
    if tokenizer == "whitespace":
        return x.split()
    if tokenizer == "raw":
        return [x]
    return [x[i : i + n] for i in range(len(x) - n + 1)]


def wildcard(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """* any text, ? one character, backslash escapes; the whole value must match."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += "\\" + pattern[k] if pattern[k] in "%_\\" else pattern[k]
        else:
            out += {"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c)
        k += 1
    if ignore_case:
        column, out = F.lower(column), out.lower()
    return F.like(column, F.lit(out), F.lit("\\"))


def regexp(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The whole value must match. Operators of other dialects, look-around and back-references are refused."""
    import re

    for bad, why in ((r"(?<!\\)[~&@#]", "operators ~ & @ #"), (r"<\d+-\d+>", "numeric ranges"), (r"\(\?[=!<]", "look-around"), (r"\\[1-9]", "back-references"), (r'(?<!\\)"', "quoted strings")):
        if re.search(bad, pattern):
            raise Refused(f"regexp [{pattern}]: {why} aren't served")
    return column.rlike(f"^(?{'i' if ignore_case else ''}:{pattern})$")


def fuzziness(value, text: str) -> int:
    """An edit distance; AUTO is 0 below 3 characters, 1 below 6, else 2."""
    if value is None:
        return 0
    if str(value).upper() == "AUTO":
        return 0 if len(text) < 3 else 1 if len(text) < 6 else 2
    if int(value) < 0:
        raise Refused("fuzziness can't be negative")
    return int(value)


def within(column: Column, text: str, distance: int, prefix: int = 0) -> Column:
    """Edit distance at most `distance` (a transposition costs 2), with the same first `prefix` characters."""
    near = F.levenshtein(column, F.lit(text), distance) >= 0
    return near & column.startswith(text[:prefix]) if prefix else near
