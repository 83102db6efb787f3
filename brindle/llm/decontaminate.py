"""Benchmark decontamination by template canonicalisation: numbers, names and units become typed placeholders, windows of template words are hash-joined, and slots are checked for consistency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .divergence import COMMON

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Ends a name that NAME begins, until a form is made.
END = "\u0004"
UNITS = (
    "km|m|cm|mm|kg|g|mg|lb|lbs|oz|ml|l|mi|ft|mph|kmh|mile|miles|meter|meters|metre|metres|kilometers|kilometres|gram|grams|kilogram|kilograms|pound|pounds|liter|liters|litre|litres|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|"
    "dollar|dollars|euro|euros|cent|cents|usd|eur|gbp|percent|degrees|stunde|stunden|tage|jahre|heures|jours|ans|horas|dias|meses"
)
#: Words that aren't names where they begin a sentence.
FUNCTION_WORDS = sorted({
    *(w for x in COMMON.values() for w in x if w.isalpha()),
    *"how why where whose each every after before then suppose given find calculate compute solve write let during while because since some many most both another these those there here now today yesterday does did do is are was were can could should may might must if given between over under until".split(),
    *"wie wo warum wer wen wem welche welcher welches jeder jede wenn dann danach nachdem bevor jetzt heute gestern combien comment pourquoi quand quel quelle quels quelles chaque si après avant alors cuánto cuánta cuántos cuántas cómo dónde cuándo quién qué cuál cada después antes entonces".split(),
})


def _trie(words: list[str]) -> str:
    """Matches any of words. A pattern that tries each word in turn takes several times as long."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    out = "|".join(f"{c}{_trie(x)}" for c, x in sorted(heads.items()))
    return "" if not out else f"(?:{out})?" if "" in words else f"(?:{out})"


#: Any capitalised word but those, wherever it stands.
CAPITALISED = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}])(?!{_trie([w.capitalize() for w in FUNCTION_WORDS])}(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
NUMBERS = r"\p{N}+(?:[.,:/-]\p{N}+)*"
#: A unit is one only after a number.
AFTER_NUMBER = rf"(?<={NUMBER}[\s%]{{0,1}}){NAME}?(?:{UNITS}){END}?(?![\p{{L}}\p{{N}}])"
MARKS = rf"[^\p{{L}}\p{{N}}\s{NAME}{NUMBER}{UNIT}{END}]+"
#: Forms of a text that are matched each with the same: lower-cased words with numbers and units as placeholders; those with names as placeholders too; exact words, for items that neither can identify.
PLAIN, OPEN, EXACT = 0, 1, 2
#: Words of a window; how many of them must not be placeholders; the share of an item's windows that makes a leak.
WINDOW, LITERALS, SHARE = 8, 5, 0.5


def _let(x: Column, body) -> Column:
    """body(x), with x as a lambda's variable: it is evaluated once however often body has it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def marked(text: Column) -> Column:
    """The lower-cased words of a text (null: none) without punctuation, numbers and units as placeholders, and names between NAME and END. Each word with a letter or digit gives one, so words() has its value at the same place."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), CAPITALISED, f"{NAME}$0{END}")
    x = F.regexp_replace(F.lower(x), NUMBERS, NUMBER)
    x = _let(x, lambda v: F.when(F.contains(v, F.lit(NUMBER)), F.regexp_replace(v, AFTER_NUMBER, UNIT)).otherwise(v))
    return F.filter(F.split(F.regexp_replace(x, MARKS, ""), r"\s+"), lambda w: w != "")


def plain(word: Column) -> Column:
    return F.translate(word, NAME + END, "")


def opened(word: Column) -> Column:
    return F.when(F.contains(word, F.lit(NAME)), F.regexp_replace(word, f"{NAME}[^{END}]*{END}", NAME)).otherwise(word)


def words(text: Column) -> Column:
    """The words that template() gives a template word for, lower-cased, without punctuation: the values of slots."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def exact(text: Column) -> Column:
    """The lower-cased words of a text (null: none), without the punctuation around them; signs such as + stay."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<!\S)[(\[\"'\u201c\u2018\u00bf\u00a1]+|[.,;:!?)\]\"'\u201d\u2019]+(?!\S)", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


#: How a form's words come from those of marked(); EXACT has words of its own.
FORMS = {PLAIN: plain, OPEN: opened}


def _windows(h: Column, size: int) -> Column:
    """Hashes of the windows of so many words, in order, from the words' hashes; none if there are fewer words. Windows of two halves are put together, so each level is one pass."""

    def joined(x: Column, a: int, y: Column, b: int) -> Column:
        n = F.greatest(F.size(h) - (a + b - 1), F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(y, a + 1, n), lambda p, q: F.xxhash64(p, q))

    def of(have: dict[int, Column], left: int, at: int, done: Column | None) -> Column:
        # have: windows of 1, 2, 4, ... words; done: windows of the first `at` words
        if not left:
            return done
        step = max(have)
        if step * 2 <= size:
            return _let(joined(have[step], step, have[step], step), lambda x: of({**have, step * 2: x}, left, at, done))
        take = max(k for k in have if k <= left)
        more = have[take] if done is None else joined(done, at, have[take], take)
        return _let(more, lambda x: of(have, left - take, at + take, x))

    return of({1: h}, size, 0, None)


def _window(words: str, size: int) -> Column:
    """The hash that _windows() has for a window of just these words."""

    def half(at: int, n: int) -> Column:
        return F.xxhash64(half(at, n // 2), half(at + n // 2, n // 2)) if n > 1 else F.xxhash64(F.element_at(words, at + 1))

    out, at = None, 0
    while at < size:
        take = 1 << (size - at).bit_length() - 1
        out = half(at, take) if out is None else F.xxhash64(out, half(at, take))
        at += take
    return out


def _hashed(words: Column, form: Column | None = None) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w if form is None else form(w)))


def item_windows(benchmark: DataFrame, scratch: Scratch, id: str, text: str, window: int, literals: int) -> DataFrame:
    """(item, size, at, key, total, slots) of each window that may be matched; item: (id, form); slots: (place, value) of its placeholders. An item shorter than a window is one window. Windows with fewer than `literals` words that aren't placeholders can't be identified. An item without any other window has the windows of its exact words instead."""
    held = benchmark.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    open_ = lambda x: x.rlike(f"[{NAME}{NUMBER}{UNIT}]")

    def windows(rows: DataFrame, form: int) -> DataFrame:
        own = exact(F.col("text")) if form == EXACT else F.transform(marked(F.col("text")), FORMS[form])
        own = rows.select(F.struct("id", F.lit(form).alias("form")).alias("item"), own.alias("t"), words(F.col("text")).alias("w")).where(F.size("t") >= (1 if form == EXACT else literals))
        own = own.withColumn("size", F.least(F.size("t"), F.lit(window)))
        starts = own.select("item", "size", "t", "w", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("size") + 1)).alias("at"))
        part = starts.withColumn("part", F.slice("t", F.col("at"), F.col("size")))
        places = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.lit(form != EXACT) & open_(F.element_at("part", k + 1)))
        slots = F.transform(places, lambda k: F.struct(k.alias("place"), F.try_element_at("w", F.col("at") + k).alias("value")))
        if form != EXACT:
            part = part.where(F.size(F.filter("part", lambda x: ~open_(x))) >= F.least(F.lit(literals), F.col("size")))
        key = F.coalesce(*(F.when(F.col("size") == n, _window("part", n)) for n in range(1 if form == EXACT else min(literals, window), window + 1)))
        return part.select("item", "size", "at", key.alias("key"), slots.alias("slots"))

    found = scratch.table(windows(held, PLAIN).union(windows(held, OPEN)), "known")
    rest = scratch.table(held.join(found.select(F.col("item.id").alias("known")).distinct(), F.col("id") == F.col("known"), "left_anti"), "unknown")
    if rest.take(1):
        found = found.union(windows(rest, EXACT))
    return found.withColumn("total", F.size(F.collect_set("key").over(W.partitionBy("item"))).cast("bigint"))


def text_windows(docs: DataFrame, variants: list[tuple[int, int]]) -> DataFrame:
    """(row, variant, at, key) of docs' rows (row, text): the windows of each (form, size) of variants. A text's words are made once for all."""

    def one(m: Column, form: int, size: int) -> Column:
        return _let(_hashed(m, FORMS[form]), lambda h: _windows(h, size))

    def of(m: Column) -> Column:
        return F.array(*(one(m, *v) for v in known))

    known = [v for v in variants if v[0] != EXACT]
    sizes = [size for form, size in variants if form == EXACT]
    lists = [_let(marked(F.col("text")), of)] * bool(known) + [_let(_hashed(exact(F.col("text"))), lambda h: F.array(*(_windows(h, n) for n in sizes)))] * bool(sizes)
    order = [*known, *((EXACT, n) for n in sizes)]
    each = docs.select("row", F.posexplode(F.concat(*lists)).alias("variant", "keys"))
    return each.select("row", F.element_at(F.array(*(F.lit(variants.index(v)) for v in order)), F.col("variant") + 1).alias("variant"), F.posexplode("keys").alias("at", "key")).withColumn("at", F.col("at") + 1)


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, most_broadcast: int = 200_000) -> DataFrame:
    """(doc, text_hash, item, matched, total, changed): the items that a text holds, with how many of the item's windows it has (in the form that has most), and whether slots changed.

    Windows whose slots give one value of the item two values in the text, at one alignment, don't count.
    A text with enough of an item's windows has one of those that fewest items share, however they
    are chosen, if they are all but `enough` - 1: only those lead to an item, so windows that many
    items share pair a text with none of them. The items' windows are broadcast up to
    most_broadcast rows (about 20 bytes each) and shuffled beyond that.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = scratch.table(item_windows(benchmark, scratch, item_id, item_text, window, literals), "items")
    variants = sorted((r["form"], r["size"]) for r in items.select("item.form", "size").distinct().collect())
    held = docs.select(F.struct(F.col(id).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("text_hash")).alias("row"), F.col(text).cast("string").alias("text"))
    if not variants:
        return held.limit(0).select("row.doc", "row.text_hash", F.lit(None).cast("bigint").alias("item"), F.lit(0).cast("bigint").alias("matched"), F.lit(0).cast("bigint").alias("total"), F.lit(False).alias("changed"))
    number = F.element_at(F.create_map(*(x for n, (form, size) in enumerate(variants) for x in (F.lit(16 * size + form), F.lit(n)))), 16 * F.col("size") + F.col("item.form"))
    items = items.withColumn("variant", number)
    enough = F.when(F.col("item.form") == EXACT, F.col("total")).otherwise(F.greatest(F.ceil(share * F.col("total")), F.lit(1)))
    keys = items.select("variant", "key").distinct()
    if keys.limit(most_broadcast + 1).count() <= most_broadcast:
        keys = F.broadcast(keys)
    found = scratch.table(text_windows(held, variants).join(keys, ["variant", "key"], "left_semi").distinct(), "found")
    # the windows that lead to an item
    each = items.select("item", "variant", "key", "total").distinct()
    shared = each.groupBy("variant", "key").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("items", "key"))
    leading = each.join(shared, ["variant", "key"]).withColumn("rank", rank).where(F.col("rank") <= F.col("total") - enough + 1)
    candidates = found.join(leading, ["variant", "key"]).select("row", "item").distinct()
    held_keys = found.select("row", "variant", "key").distinct()
    near = candidates.join(each, "item").join(held_keys, ["row", "variant", "key"]).groupBy("row", "item", "total").agg(F.count(F.lit(1)).alias("matched")).where(F.col("matched") >= enough).select("row", "item", "total")
    near = scratch.table(near, "near")
    windows = near.join(items.select("item", "variant", "key", F.col("at").alias("item_at")), "item").join(found, ["row", "variant", "key"])
    # slots of those windows: the text's own words at the same places
    texts = held.join(near.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("w"))
    slots = items.where(F.size("slots") > 0).select("item", F.col("at").alias("item_at"), "slots")
    aligned = windows.join(slots, ["item", "item_at"]).select("row", "item", "at", (F.col("at") - F.col("item_at")).alias("shift"), F.explode("slots").alias("slot"))
    valued = aligned.join(texts, "row").select("row", "item", "shift", F.col("slot.value").alias("theirs"), F.try_element_at("w", F.col("at") + F.col("slot.place")).alias("ours"))
    by_value = valued.groupBy("row", "item", "shift", "theirs").agg((F.min("ours") < F.max("ours")).alias("split"), F.max(F.coalesce(F.col("ours") != F.col("theirs"), F.lit(True))).alias("changed"))
    checked = by_value.groupBy("row", "item", "shift").agg(F.max("split").alias("split"), F.max("changed").alias("changed"))
    good = windows.withColumn("shift", F.col("at") - F.col("item_at")).join(checked, ["row", "item", "shift"], "left").where(~F.coalesce("split", F.lit(False)))
    out = good.groupBy("row", "item", "total").agg(F.countDistinct("key").alias("matched"), F.max(F.coalesce("changed", F.lit(False))).alias("changed")).where(F.col("matched") >= enough)
    best = out.groupBy("row", F.col("item.id").alias("id")).agg(F.max(F.struct("matched", "total")).alias("most"), F.max("changed").alias("changed"))
    return best.select("row.doc", "row.text_hash", F.col("id").alias("item"), "most.matched", "most.total", "changed")


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, item_ids (sorted, each once), reparameterised (an item whose slots changed is among them).

    A null or empty text matches nothing; an item with too few literal words only its exact words. Repeated rows give repeated
    rows; an empty table gives an empty one, an empty benchmark no contaminated row.
    """
    found = leaks(docs, benchmark, id, text, **more).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("changed").alias("changed"))
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("changed", F.lit(False)).alias("reparameterised"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that hold no item, all their columns unchanged whatever their names. Null and empty texts hold none; repeated rows stay or go together; an empty table gives an empty one."""
    found = leaks(docs, benchmark, id, text, **more).select("doc", "text_hash").distinct()
    return docs.join(found, docs[id].eqNullSafe(found["doc"]) & (F.xxhash64(docs[text].cast("string")) == found["text_hash"]), "left_anti")
