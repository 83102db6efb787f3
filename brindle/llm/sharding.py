"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until they are good splitters; then one exchange. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: A key is 63 + 63 bits: 32 of the text's hash, 31 of the id's, then the row's place in the input, for rows that tie in both. So equal texts lie together and yet any of them can be cut.
BITS = 126
#: Bits below those of the text's hash: cells of this width hold one text.
TEXT = 94
FIRST, NEXT = 12, 8


def _bits(shift: int, width: int) -> Column:
    """width bits of the key, above its lowest shift bits."""
    if shift >= 63:
        return F.shiftright("hi", shift - 63).bitwiseAND(F.lit((1 << width) - 1))
    if shift + width <= 63:
        return F.shiftright("tie", shift).bitwiseAND(F.lit((1 << width) - 1))
    low = 63 - shift
    return F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << (width - low)) - 1)), low) + F.shiftright("tie", shift)


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, the key (hi, tie) and the columns named in carry (as __name)."""
    held = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hi = F.shiftleft(F.xxhash64(held).bitwiseAND(F.lit(0xFFFFFFFF)), 31) + F.xxhash64(F.col(id)).bitwiseAND(F.lit(0x7FFFFFFF))
    return docs.select(
        F.col(id).alias("doc_id"), (F.octet_length(held) + F.lit(16)).cast("bigint").alias("size"), F.crc32(F.encode(held, "UTF-8")).alias("text_crc32"), hi.alias("hi"), F.monotonically_increasing_id().alias("tie"), *(F.col(c).alias(f"__{c}") for c in carry)
    )


def splitters(rows: DataFrame, pieces: int, tolerance: float, total: int, edge: float = 0.0) -> tuple[list[tuple[int, int]], int]:
    """pieces - 1 keys, in order, and how many rounds of counting they took. Fewer than i / pieces of the bytes, within tolerance times a piece's share, lie below the i-th.

    Each round counts rows and bytes by the next bits of the key in the cells that still hold a
    splitter; the driver gets at most 2 ** NEXT sums for each of them. A cell of one row can't be
    cut; a cell of one text isn't, if one of its edges is within edge times a piece's share.
    """
    share = total / pieces
    done: dict[int, int] = {}
    #: splitter number -> (cell's key above its shift, bytes below the cell)
    open_ = {i: (0, 0) for i in range(1, pieces)}
    shift, rounds = BITS, 0
    while open_ and shift > 0:
        width = min(FIRST if shift == BITS else NEXT, shift - TEXT if shift > TEXT else shift)
        cells = sorted({cell for cell, _ in open_.values()})
        if shift == BITS:
            active = rows.select(F.lit(0).alias("at"), _bits(shift - width, width).alias("cell"), "size")
        else:
            if shift >= 63:
                keys = F.create_map(*(F.lit(x) for n, cell in enumerate(cells) for x in (cell, n)))
                at = F.try_element_at(keys, F.shiftright("hi", shift - 63))
            else:
                names = F.create_map(*(F.lit(x) for n, cell in enumerate(cells) for x in (f"{cell >> (63 - shift)}.{cell & ((1 << (63 - shift)) - 1)}", n)))
                at = F.try_element_at(names, F.concat_ws(".", F.col("hi").cast("string"), F.shiftright("tie", shift).cast("string")))
            active = rows.select(at.alias("at"), _bits(shift - width, width).alias("cell"), "size").where(F.col("at").isNotNull())
        counted: dict[int, list[tuple[int, int, int]]] = {}
        for r in active.groupBy("at", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
            counted.setdefault(cells[r["at"]], []).append((r["cell"], r["bytes"], r["n"]))
        shift -= width
        rounds += 1
        for i, (cell, below) in list(open_.items()):
            target, own = i * share, below
            for child, size, n in sorted(counted.get(cell, [])):
                if own + size > target:
                    at = (cell << width) + child
                    lower, upper = target - own, own + size - target
                    if min(lower, upper) <= (max(tolerance, edge) if shift == TEXT else tolerance) * share or n == 1 or shift == 0:
                        done[i] = (at if lower <= upper else at + 1) << shift
                        del open_[i]
                    else:
                        open_[i] = (at, own)
                    break
                own += size
            else:
                # only where all bytes lie below the target: an empty table
                done[i] = 1 << BITS
                del open_[i]
    ordered = sorted(done.values())
    return [(min(k >> 63, 2**63 - 1), k & (2**63 - 1)) for k in ordered], rounds


def _piece(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters are not above the row's key, by binary search in an array of literals."""
    if not cuts:
        return F.lit(0)
    table = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in cuts))
    key = F.struct(F.col("hi").alias("a"), F.col("tie").alias("b"))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        right = F.element_at(table, middle + 1) <= key
        more = state["low"] < state["high"]
        return F.struct(F.when(more & right, middle + 1).otherwise(state["low"]).alias("low"), F.when(more & ~right, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    # element_at may be evaluated where low = high = len(cuts): a last element keeps it in range
    table = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in [*cuts, (2**63 - 1, 2**63 - 1)]))
    return F.aggregate(steps, start, step, lambda s: s["low"])


def shard(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), tolerance: float = 0.001, rows_in_piece: int = 5_000_000, edge: float = 0.02) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot, and the columns named in carry (as __name).

    Shards are ranges of the key and have nearly equal bytes: each boundary misses its target by
    at most tolerance times a shard's share, or by less than the one row that lies across it; by
    up to edge times a share where it then lies between two texts. So rows with equal text lie
    in one shard, unless they are too many bytes for that; slots are gapless from 0 in the order
    of the key. size: UTF-8 bytes of the text (null: none) plus 16. Null and repeated ids are
    rows like others, ties are broken by the row's place in the input, columns of docs with the
    names used here are not read. An empty table gives an empty one.

    Splitters of rows, found in the same way, cut shards into pieces of about rows_in_piece rows
    at most, of which each is sorted by itself: no task grows with the input, or with the number
    of short texts in a shard.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    rows = scratch.table(keyed(docs, id, text, carry), "keyed")
    stats = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    of_bytes, _ = splitters(rows, shards, tolerance, stats["bytes"], edge)
    parts = math.ceil(stats["n"] / rows_in_piece)
    of_rows = splitters(rows.withColumn("size", F.lit(1)), parts, 0.05, stats["n"])[0] if parts > 1 else []
    cuts = sorted([(k, True) for k in of_bytes] + [(k, False) for k in of_rows])
    piece = _piece([k for k, _ in cuts])
    placed = rows.withColumn("piece", piece)
    shard_of = [0]
    for _, next_shard in cuts:
        shard_of.append(shard_of[-1] + next_shard)
    order = F.row_number().over(W.partitionBy("piece").orderBy("hi", "tie")) - 1
    out = placed.withColumn("slot", order.cast("bigint"))
    if of_rows:
        counts = {r["piece"]: r["count"] for r in placed.groupBy("piece").count().collect()}
        before = [0] * len(shard_of)
        for p in range(1, len(shard_of)):
            before[p] = before[p - 1] + counts.get(p - 1, 0) if shard_of[p] == shard_of[p - 1] else 0
        out = out.withColumn("slot", F.col("slot") + F.element_at(F.array(*(F.lit(x).cast("bigint") for x in before)), F.col("piece") + 1))
    number = F.element_at(F.array(*(F.lit(x) for x in shard_of)), F.col("piece") + 1)
    return out.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), "slot", *(f"__{c}" for c in carry))
