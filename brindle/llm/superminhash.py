"""Near-duplicates by SuperMinHash: signatures from correlated permutation ranks, banding, checks on whole shingle sets, union-find."""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, pieces, releasing, shingles, words_of

#: Positions of a signature (255 fit a byte), and bands of ROWS positions. Two sets of similarity 0.8 share no band with probability below (1 - 0.8 ** 5) ** 51 = 2e-9.
M, ROWS = 255, 5
BANDS = M // ROWS
#: A pair whose signatures agree in a smaller share of the positions isn't compared in full: at similarity 0.8 the share's standard deviation is below 0.025, so this is 6 of them.
LEAST_ESTIMATE = 0.65
_GOLD = U64(0x9E3779B97F4A7C15)
_OFFSET_BITS = 40


def signatures(hashes: np.ndarray, offsets: np.ndarray, m: int = M, block: int = 1 << 15) -> np.ndarray:
    """A row of m values for each set hashes[offsets[i]:offsets[i + 1]] (not empty).

    Each element draws, for the ranks j = 0, 1, ..., a position that it hasn't drawn before
    (Fisher-Yates) and a number in [j, j + 1); a position keeps the least number drawn for it.
    A set stops at the rank that can't lower its largest value. All elements of a block take a
    rank at once, so a set longer than a block needs no more memory.
    """
    n = len(offsets) - 1
    out = np.full((n, m), float(m + 1))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        for low in range(int(offsets[at]), int(offsets[to]), block) if to == at + 1 else (int(offsets[at]),):
            high = min(low + block, int(offsets[to])) if to == at + 1 else int(offsets[to])
            own = np.searchsorted(offsets[at : to + 1], np.arange(low, high), "right") - 1
            _draw(out[at:to], hashes[low:high], own, m)
        at = to
    return out


def _draw(h: np.ndarray, elements: np.ndarray, own: np.ndarray, m: int) -> None:
    flat = h.reshape(-1)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    live = np.arange(len(elements))
    for j in range(m):
        last = np.minimum(h.max(1), m - 1)
        live = live[last[own[live]] >= j]
        if not len(live):
            return
        u = mix(elements[live] + U64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + (mix(u ^ _GOLD) % U64(m - j)).astype(np.int64)
        chosen = order[live, k]
        order[live, k] = order[live, j]
        value = (u >> U64(11)).astype(np.float64) * 2.0**-53 + j
        np.minimum.at(flat, own[live] * m + chosen, value)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    values = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + values[:, :, k])
    return keys


# ---------------------------------------------------------------- sets, in mapped files


def _record(fingerprint: np.ndarray, members: np.ndarray) -> bytes:
    return np.uint64(len(members)).tobytes() + fingerprint.tobytes() + (members >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


class Sets:
    """Reads signatures (16 bits a position) and sets (48-bit hashes, sorted) by row number, from the files that sketch() wrote."""

    def __init__(self, files: dict[int, str], most_open: int = 256):
        self.files, self.open, self.most = files, {}, most_open

    def _at(self, row: int) -> tuple[memoryview, int]:
        part, offset = row >> _OFFSET_BITS, row & ((1 << _OFFSET_BITS) - 1)
        if part not in self.open:
            if len(self.open) >= self.most:
                self.open.clear()
            with open(self.files[part], "rb") as f:
                self.open[part] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return self.open[part], offset

    def size(self, row: int) -> int:
        data, at = self._at(row)
        return int.from_bytes(data[at : at + 8], "little")

    def fingerprint(self, row: int) -> np.ndarray:
        data, at = self._at(row)
        return np.frombuffer(data, np.uint16, M, at + 8)

    def members(self, row: int) -> np.ndarray:
        data, at = self._at(row)
        n = int.from_bytes(data[at : at + 8], "little")
        out = np.zeros((n, 8), np.uint8)
        out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at + 8 + 2 * M).reshape(n, 6)
        return out.reshape(-1).view(np.uint64)

    def linked(self, a: int, b: int, percent: int) -> bool:
        """Whether 100 * intersection >= percent * union, on the whole sets."""
        n, m = self.size(a), self.size(b)
        if 100 * min(n, m) < percent * max(n, m) or (self.fingerprint(a) == self.fingerprint(b)).mean() < LEAST_ESTIMATE:
            return False
        x, y = self.members(a), self.members(b)
        if n > m:
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (n + m - both)


SKETCH = "row bigint, id bigint, text_hash bigint, n bigint, low bigint, high bigint, bands array<bigint>, part bigint, file string"


def sketch(docs: DataFrame, scratch: Scratch, words: int, id: str, text: str) -> DataFrame:
    """A row for each document: its row number (which says where its set lies), size, 128-bit digest of the set, and band keys."""
    folder = scratch.folder("sets")

    def run(batches):
        part = TaskContext.get().partitionId()
        name = os.path.join(folder, f"sets-{part}-{uuid.uuid4().hex}.bin")
        offset = 0
        with open(name, "wb", buffering=1 << 20) as f:
            for batch in batches:
                for piece in pieces(batch, "text", 1 << 20):
                    w = words_of(piece.column("text"), True)
                    sets = []
                    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
                        own = w.hashes[a:b]
                        # fewer words than a shingle has: the whole sequence is one
                        sets.append(np.unique(shingles(own, min(words, len(own)) or 1)))
                    sizes = np.array([len(s) for s in sets], np.int64)
                    some = np.flatnonzero(sizes)
                    bands, digests, rows = [[]] * len(sets), np.zeros((len(sets), 2), np.int64), np.zeros(len(sets), np.int64)
                    if len(some):
                        signature = signatures(np.concatenate([sets[i] for i in some]), np.concatenate(([0], np.cumsum(sizes[some]))))
                        keys = band_keys(signature).view(np.int64)
                        prints = mix(signature.view(np.uint64)).astype(np.uint16)
                        for k, i in enumerate(some):
                            bands[i] = keys[k]
                            digests[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
                    k = 0
                    for i in range(len(sets)):
                        rows[i] = (part << _OFFSET_BITS) + offset
                        data = _record(prints[k], sets[i]) if sizes[i] else bytes(8)
                        k += int(sizes[i] > 0)
                        f.write(data)
                        offset += len(data)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bands]))), pa.int32()), pa.array(np.concatenate([np.asarray(b, np.int64) for b in bands]) if bands else np.zeros(0, np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows), piece.column("id"), piece.column("text_hash"), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, pa.array(np.full(len(sets), part)), pa.array([name] * len(sets))],
                        names=["row", "id", "text_hash", "n", "low", "high", "bands", "part", "file"],
                    )

    return scratch.written(docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text")), "sketch", run, SKETCH)


# ---------------------------------------------------------------- union-find


class Forest:
    """Union-find over integers; a root is the least member of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _contract(edges: DataFrame, most_nodes: int = 200_000) -> DataFrame:
    """Each partition's edges as stars around the least member; a forest is given out when it has most_nodes nodes, so memory is bounded."""

    def run(batches):
        forest = Forest()

        def stars():
            nodes = list(forest.parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.union(a, b)
            if len(forest.parent) > most_nodes:
                yield stars()
                forest = Forest()
        yield stars()

    return edges.select("a", "b").mapInArrow(releasing(run), "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): of each node of the edges, the least node of its component.

    Partitions contract their edges by union-find; then large-star and small-star steps, each of
    which is a shuffle of (node, node) rows, until nothing changes. The number of rounds grows
    as the logarithm of the nodes. The edges of a round are a written table.
    """
    current, last = scratch.written(_contract(edges).distinct(), f"{name}-0"), None
    for k in range(1, 60):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        current = scratch.written(small.where("a <> b").distinct(), f"{name}-{k}")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components of {name} don't settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


# ---------------------------------------------------------------- links


def _verified(pairs: DataFrame, scratch: Scratch, files: dict[int, str], percent: int) -> DataFrame:
    """The pairs (a, b) of rows that are linked."""

    def run(batches):
        sets = Sets(files)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [sets.linked(x, y, percent) for x, y in zip(a, b)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return scratch.written(pairs, "stars", run, "a bigint, b bigint")


def _cross(blocks: DataFrame, scratch: Scratch, files: dict[int, str], percent: int, work: int = 64) -> DataFrame:
    """Edges between members of a bucket that lie in different components so far. blocks comes sorted by (key, i, j); side: 0 in block i, 1 in block j, 2 if i = j."""

    def group(sets: Sets, rows, roots, sides, band):
        prints = np.array([sets.fingerprint(r) for r in rows])
        sizes = np.array([sets.size(r) for r in rows])
        forest = Forest()
        left = np.flatnonzero(sides != 1)
        right = np.flatnonzero(sides != 0)
        for start in range(0, len(left), work):
            some = left[start : start + work]
            close = (prints[some][:, None, :] == prints[right][None, :, :]).mean(2) >= LEAST_ESTIMATE
            close &= roots[some][:, None] != roots[right][None, :]
            close &= 100 * np.minimum(sizes[some][:, None], sizes[right]) >= percent * np.maximum(sizes[some][:, None], sizes[right])
            for x, y in zip(*np.nonzero(close)):
                p, q = int(some[x]), int(right[y])
                if sides[p] == 2 and p >= q or forest.find(int(roots[p])) == forest.find(int(roots[q])):
                    continue
                # a pair is compared only in the first of the bands that it shares
                same = (prints[p] == prints[q]).reshape(BANDS, ROWS).all(1)
                if same[:band].any():
                    continue
                if sets.linked(int(rows[p]), int(rows[q]), percent):
                    forest.union(int(roots[p]), int(roots[q]))
                    yield int(rows[p]), int(rows[q])

    def run(batches):
        sets, held = Sets(files), []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        def flush(table):
            cols = {c: table.column(c).to_numpy() for c in table.column_names}
            edge = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
            found = []
            for low, high in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(table)]))):
                rows, roots = cols["row"][low:high], cols["root"][low:high]
                if high - low > 1 and (roots != roots[0]).any():
                    found += group(sets, rows, roots, cols["side"][low:high], int(cols["band"][low]))
            return out(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            same = np.ones(batch.num_rows, bool)
            for k in key:
                same &= k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            # the group that reaches the end of the batch may go on in the next
            if cut or held and any(held[-1].column(c)[-1].as_py() != int(k[0]) for c, k in zip(("key", "i", "j"), key)):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield flush(pa.Table.from_batches(held))

    return scratch.written(blocks, "cross", run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, first.

    A text's set: its distinct shingles of so many words ([^\\x20\\x09-\\x0D]+, A-Z as a-z), or all
    words as one shingle if there are fewer. Texts with 100 * intersection >= percent * union are
    linked, which is checked on the whole sets of 48-bit hashes; component_id is the least id
    reachable, kept says whether it is the row's own. first marks exactly one row of each
    component, for repeated ids. A null or empty text has an empty set and is linked with nothing.
    A null id never is the least unless all ids of its component are null; then component_id is
    null and kept true. An empty table gives an empty one; other columns are not read.

    Equal sets become one class before anything else, so exact copies cost a row each. In a
    bucket of classes that share a band, every member is compared with the least one; members
    that this leaves outside the least one's component are then compared with all others, in blocks
    of about `block` members, each pair in the first band that it shares. Nothing is capped.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = sketch(docs, scratch, words, id, text)
    files = {r["part"]: r["file"] for r in rows.groupBy("part", "file").count().collect()}
    filled = rows.where("n > 0")
    classes = scratch.written(filled.groupBy("low", "high").agg(F.min("row").alias("row"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    bands = filled.join(classes.select("row"), "row", "left_semi").select("row", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.written(bands.join(shared, "key"), "members")
    stars = members.where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b")).distinct()
    stars = _verified(stars, scratch, files, percent)
    labels = components(stars, scratch, "stars-components")
    # buckets of two are done; others may hold links beside the leader's
    rest = members.where("size > 2").join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = rest.groupBy("key").agg(F.min(F.struct("row", "root"))["root"].alias("main"), (F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key", "main")
    rest = scratch.written(rest.join(mixed, "key").withColumn("outside", F.col("root") != F.col("main")), "mixed")
    # members outside the leader's component, in blocks of their own, meet all blocks; the others meet only those
    blocks = rest.groupBy("key").agg(F.ceil(F.count_if("outside") / block).cast("int").alias("out"), F.ceil(F.count_if(~F.col("outside")) / block).cast("int").alias("in"))
    mine = F.when(F.col("outside"), F.pmod(F.xxhash64("row"), "out")).otherwise(F.col("out") + F.pmod(F.xxhash64("row"), "in")).cast("int")
    partners = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("out") + F.col("in")).otherwise(F.col("out")) - 1)
    spread = rest.join(blocks, "key").select("key", "band", "row", "root", mine.alias("own"), F.explode(partners).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    spread = spread.select("key", i.alias("i"), j.alias("j"), "band", "row", "root", side.alias("side"))
    # a cell is at most block * block comparisons in Python, so tasks are made by cells, not by bytes
    cells = blocks.agg(F.sum(F.col("out") * (F.col("out") + 1) / 2 + F.col("out") * F.col("in"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, int(cells) // 256))
    across = _cross(spread.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j"), scratch, files, percent)
    if across.take(1):
        found = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across)
        labels = components(found, scratch, "all-components")
    rooted = classes.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.coalesce(F.col("least"), F.lit(2**63 - 1)), "row")).alias("x"))
    by_class = scratch.written(rooted.join(least, "root").select("low", "high", "copies", "root", "component_id"), "by-class")
    held = rows.select("row", "id", "text_hash", "n", "low", "high")
    # classes with more than a thousandth of all rows are fewer than 1,000, and would be hot keys
    hot = F.broadcast(by_class.where(F.col("copies") > rows.count() / 1000).drop("copies"))
    some = held.where("n > 0")
    rest = some.join(hot, ["low", "high"], "left_anti").join(by_class.drop("copies"), ["low", "high"])
    # an empty set has no class
    alone = held.where("n = 0").select("row", "text_hash", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("row").alias("root"))
    out = some.join(hot, ["low", "high"]).unionByName(rest).select("row", "text_hash", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "root").union(alone)
    out = scratch.written(out, "rows")
    scratch.drop("sketch", "members", "mixed", "stars", "cross", "sets", "classes", "by-class")
    firsts = out.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return out.join(firsts, "row", "left").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("first", F.lit(False)).alias("first"), "text_hash")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component of near_duplicates(): one with its least id, all columns unchanged. Of rows with equal id and text, any one."""
    found = near_duplicates(docs, words, percent, id, text)
    keep = found.where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    # a name that docs doesn't have
    hash_name = "__text_hash" + "_" * sum(c.startswith("__text_hash") for c in docs.columns)
    hashed = docs.withColumn(hash_name, F.xxhash64(text))

    def same(other: DataFrame):
        return hashed[id].eqNullSafe(other["__id"]) & (hashed[hash_name] == other["__hash"])

    kept = hashed.join(keep, same(keep), "left_semi")
    return kept.join(repeated, same(repeated), "left_anti").union(kept.join(repeated, same(repeated), "left_semi").dropDuplicates([id, hash_name])).drop(hash_name)


def oracle_sql(words: int, percent: int = 80) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id and kept over documents with distinct ids: all pairs that share a shingle, then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct([{shingle} for i in range(1, len(w) - {words - 2})]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        r AS (SELECT DISTINCT x AS a, x AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
        c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
        SELECT doc_id, len(s)::bigint AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON c.a = doc_id"""
