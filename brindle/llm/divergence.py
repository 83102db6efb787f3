"""Quality rules by distribution divergence: a document against its language's character classes and common words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, pieces, releasing, span_hash, text_buffer, words_of, shingles, mix

#: Function words of the languages that have a reference. A language that isn't here has none, and its documents pass the method's test.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux d'un cette ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux elle même sans".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "beyond_ascii")
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 4 if chr(_c) in ".,;:!?'\"()-" else 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes of text that are taken at once.
PIECE = 1 << 20
#: Bytes that begin a code point.
_BEGIN = (np.arange(256) & 0xC0) != 0x80


def _hashes(words: list[str]) -> np.ndarray:
    return words_of(pa.array(words), True).hashes


_LANGS = sorted(COMMON)
_TABLE = np.sort(np.unique(np.concatenate([_hashes(w) for w in COMMON.values()])))
#: Cells of a histogram: the character classes, then the common words, then all other words.
N_CLASS, N_WORD = len(CLASSES), len(_TABLE) + 1


def _counts(index: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each row, how often each of n numbers occurs in index[offsets[row]:offsets[row + 1]]."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(row * n + index, minlength=(len(offsets) - 1) * n).reshape(-1, n)


def histograms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: code points by character class, and words by common word (A-Z as a-z)."""
    data, rows = text_buffer(column)
    begin = _BEGIN[data]
    classes = _CLASS[data[begin]]
    by_class = _counts(classes, np.concatenate(([0], np.cumsum(begin, dtype=np.int32)))[rows], N_CLASS)
    words = words_of(column, True)
    at = np.minimum(np.searchsorted(_TABLE, words.hashes), len(_TABLE) - 1)
    at[_TABLE[at] != words.hashes] = len(_TABLE)
    return by_class, _counts(at, words.offsets, N_WORD)


def _same_row_repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks each key that its row holds twice or more."""
    keys = mix(keys + rows.astype(np.uint64) * U64(0xA24BAED4963EE407))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def base_counts(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (null: empty)."""
    w = words_of(column, False)
    n = len(w.rows) - 1
    # numbers of a piece fit 32 bits: Arrow's texts of a batch are below 2 GB
    inside = np.zeros(len(w.data) + 1, np.int32)
    # code points in words: bytes that begin one, but white space
    solid = _BEGIN[w.data] & (_CLASS[w.data] != 3)
    np.cumsum(solid, out=inside[1:])
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[w.data], dtype=np.int32)))
    # lines
    is_break = w.data == 10
    first = np.unique(np.concatenate((w.rows[:-1], np.flatnonzero(is_break) + 1)))
    # an empty text begins no line of its own, and a break that ends a text begins one in no row
    line_row = np.searchsorted(w.rows, first, "right") - 1
    last = np.append(first[1:], len(w.data))
    end = np.minimum(last, w.rows[np.minimum(line_row + 1, n)])
    end = np.where((end > first) & is_break[np.maximum(end, 1) - 1], end - 1, end)
    words_in = inside[np.maximum(end, first)] - inside[first] > 0
    first, end, line_row = first[words_in], end[words_in], line_row[words_in]
    key = span_hash(w.data, first, end)
    order = np.lexsort((key, line_row))
    key, line_row = key[order], line_row[order]
    again = (key[1:] == key[:-1]) & (line_row[1:] == line_row[:-1])
    dup_lines = np.bincount(line_row[1:][again], minlength=n)
    # windows
    counts = np.diff(w.offsets)
    row = np.repeat(np.arange(n), counts)
    grams = shingles(w.hashes, window)
    whole = row[: len(grams)] == row[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    found = at[_same_row_repeats(grams[at], row[at])]
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return {
        "n_words": counts,
        "word_chars": inside[w.rows[1:]] - inside[w.rows[:-1]],
        "n_symbols": symbols[w.rows[1:]] - symbols[w.rows[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": covered[w.offsets[1:]] - covered[w.offsets[:-1]],
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of counts p from the distribution q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


#: Limits as shares of two distances that each reference has of its own: of a text without any common word, and of a table (a symbol and a space more for each space).
WORD_SHARE, TABLE_SHARE = 0.85, 0.65


def limits(of_class: np.ndarray, of_word: np.ndarray) -> tuple[float, float]:
    """The largest class distance, and the largest word distance of a text with a smaller share of common words than the reference. A reference without common words sets no limit for words."""
    table = of_class.copy()
    table[[CLASSES.index("space"), CLASSES.index("symbol")]] += of_class[CLASSES.index("space")]
    bare = np.zeros(N_WORD)
    bare[-1] = 1
    by_class = TABLE_SHARE * js_distance(table[None] / table.sum(), of_class)[0]
    return by_class or np.inf, (WORD_SHARE * js_distance(bare[None], of_word)[0]) or np.inf


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language of COMMON, the summed histograms of all its documents. The driver gets one row of fixed width a language. A language without words has no reference."""

    def part(batches):
        total = {}
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                by_class, by_word = histograms(piece.column("text"))
                langs = np.array(piece.column("lang").to_pylist(), object)
                # each document counts as one, whatever its length: a few long junk texts don't make the reference
                both = np.hstack([x / np.maximum(x.sum(1, keepdims=True), 1) for x in (by_class, by_word)])
                for k in _LANGS:
                    total[k] = total.get(k, 0) + both[langs == k].sum(0)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "cells": [x.tolist() for x in total.values()]}, schema=pa.schema([("lang", pa.string()), ("cells", pa.list_(pa.float64()))]))

    parts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isin(_LANGS)).mapInArrow(releasing(part), "lang string, cells array<double>")
    sums = parts.select("lang", F.posexplode("cells").alias("cell", "x")).groupBy("lang", "cell").agg(F.sum("x").alias("x")).collect()
    out = {k: np.zeros(N_CLASS + N_WORD) for k in _LANGS}
    for r in sums:
        out[r["lang"]][r["cell"]] = r["x"]
    return {k: (x[:N_CLASS] / x[:N_CLASS].sum(), x[N_CLASS:] / x[N_CLASS:].sum()) for k, x in out.items() if x[N_CLASS:].sum() > 0}


MEASURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _judge(refs, min_chars, min_words, most_class, most_word, column, langs):
    base = base_counts(column)
    by_class, by_word = histograms(column)
    n = len(column)
    distance, most = np.full((2, n), np.nan), np.array([[most_class], [most_word]]).repeat(n, 1)
    langs = np.array(langs, object)
    for k, (of_class, of_word) in refs.items():
        own = langs == k
        if own.any():
            distance[0, own], distance[1, own] = js_distance(by_class[own], of_class), js_distance(by_word[own], of_word)
            class_limit, word_limit = limits(of_class, of_word)
            few = by_word[own, -1] > of_word[-1] * by_word[own].sum(1)
            most[0, own] = min(most_class, class_limit)
            most[1, own] = np.where(few, min(most_word, word_limit), most_word)
    distance[0, by_class.sum(1) < min_chars] = np.nan
    distance[1, base["n_words"] < min_words] = np.nan
    failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
    with np.errstate(invalid="ignore"):
        far = (distance > most).any(0)
    return base, distance, failed, ~(failed | far)


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", min_chars: int = 200, min_words: int = 50, most_class: float = 0.3, most_word: float = 0.42) -> DataFrame:
    """One row for each row of docs: base counts, both distances from the language's reference, base_failed and kept.

    The references are sums over all rows of docs. most_class and most_word are the largest
    limits; each reference's own limits() lie below them, so that word lists, tables and junk
    without common words go. A distance is null, and rejects nothing, under
    the minimum length, for a null or unknown language, or for a language without words. A null
    text counts as empty: no words, so base_failed. Repeated rows give repeated rows; an empty
    table gives an empty one. Other columns of docs are not read.
    """
    refs = references(docs, text, lang)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                base, distance, failed, kept = _judge(refs, min_chars, min_words, most_class, most_word, piece.column("text"), piece.column("lang").to_pylist())
                floats = [pa.array(x, pa.float64(), from_pandas=True) for x in distance]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *floats, pa.array(failed), pa.array(kept)], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(releasing(run), MEASURES)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", min_chars: int = 200, min_words: int = 50, most_class: float = 0.3, most_word: float = 0.42) -> DataFrame:
    """The rows of docs that measure() keeps, with all their columns and in one pass over them after the references."""
    refs = references(docs, text, lang)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                kept = _judge(refs, min_chars, min_words, most_class, most_word, piece.column(text), piece.column(lang).cast(pa.string()).to_pylist())[3]
                yield piece.filter(pa.array(kept))

    return docs.mapInArrow(releasing(run), docs.schema)
