"""Language-model scoring: an n-gram trie in Elias-Fano coded, memory-mapped levels with quantised smoothed probabilities.

Order 3, interpolated absolute discounting. A trie shard holds the two-word contexts of one hash
value: level 1 has their first words, level 2 the second words of each first, level 3 the words
that follow each pair. Each level's word numbers restart in every context; they are stored as one
monotone sequence, relative to where the context before ends, and found by successor search.
"""

from __future__ import annotations

import ctypes
import json
import math
import mmap
import os
import weakref
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, pieces, publish, releasing, words_of

#: The end of a text is a word with this hash.
END = U64(0x5DEECE66D5DEECE6)
DISCOUNT = 0.75
#: log10 of a probability or weight is kept in steps of 1 / GRAIN down to -65535 / GRAIN.
GRAIN = 4096
_FULL = U64(0xFFFFFFFFFFFFFFFF)

# ---------------------------------------------------------------- Elias-Fano


_STEP = U64(0x0101010101010101)
_HIGH = U64(0x8080808080808080)
#: Where the r-th set bit of a byte is, by r * 256 + byte.
_IN_BYTE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for b in range(256)] for r in range(8)], np.int64).reshape(-1)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the rank-th (from 0) set bit of each word is: sums of its bytes' bits in one product, then a table."""
    rank = rank.astype(np.uint64)
    x = words - ((words >> U64(1)) & U64(0x5555555555555555))
    x = (x & U64(0x3333333333333333)) + ((x >> U64(2)) & U64(0x3333333333333333))
    sums = ((x + (x >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _STEP
    place = (np.bitwise_count(((rank * _STEP | _HIGH) - sums) & _HIGH).astype(np.uint64)) << U64(3)
    rank = rank - (((sums << U64(8)) >> place) & U64(255))
    return place.astype(np.int64) + _IN_BYTE[((rank << U64(8)) | ((words >> place) & U64(255))).astype(np.int64)]


class EliasFano:
    """Monotone sequences: low bits packed, high bits in unary, with the ones and zeros before each word of them.

    A sequence alone, or those of many shards in one address space: then field f of sequence k
    begins at at[f][k] of the array f and has size[f][k] elements. Questions are arrays, and `of`
    names the sequence of each, so one numpy operation serves all shards.
    """

    FIELDS = ("low", "high", "ones", "zeros", "one_marks", "zero_marks")

    def __init__(self, n: np.ndarray, width: np.ndarray, arrays: dict[str, np.ndarray], at: dict[str, np.ndarray], size: dict[str, np.ndarray]):
        self.n, self.width, self.arrays, self.at, self.size = n, width, arrays, at, size
        self.last = np.full(len(n), -1, np.int64)
        some = np.flatnonzero(n > 0)
        self.last[some] = self.access(n[some] - 1, some)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        most = int(values[-1]) + 1 if n else 1
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            part = values & U64((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[firsts]] = np.bitwise_or.reduceat(part << shift, firsts)
            over = shift.astype(np.int64) + width > 64
            low[word[over] + 1] |= part[over] >> (U64(64) - shift[over])
        place = (values >> U64(width)).astype(np.int64) + np.arange(n)
        # one zero more than the last value has, so that every bucket has an end
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, np.uint64)
        if n:
            word = place >> 6
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[firsts]] = np.bitwise_or.reduceat(U64(1) << (place & 63).astype(np.uint64), firsts)
        # one entry more than there are words: all bits lie before it
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32)
        zeros = (np.arange(len(high) + 1, dtype=np.int64) * 64 - ones).astype(np.uint32)
        marks = [(np.searchsorted(x, np.arange(0, int(x[-1]) + 1, 64), "right") - 1).clip(0, len(high) - 1).astype(np.uint32) for x in (ones, zeros)]
        arrays = dict(zip(cls.FIELDS, (low, high, ones, zeros, *marks)))
        return cls(np.array([n]), np.array([width]), arrays, dict.fromkeys(cls.FIELDS, np.zeros(1, np.int64)), {k: np.array([len(x)]) for k, x in arrays.items()})

    def _word_of(self, name: str, rank: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word that holds the rank-th one or zero: the last with at most rank of them before it; and how many are before it. Marks tell the word of every 64th; from there a few steps, and halving up to the last word where those don't do."""
        before, base = self.arrays[f"{name}s"], self.at[f"{name}s"][of]
        at = base + self.arrays[f"{name}_marks"][self.at[f"{name}_marks"][of] + (rank >> 6)]
        live = np.flatnonzero(before[at + 1] <= rank)
        for _ in range(3):
            if not len(live):
                break
            at[live] += 1
            live = live[before[at[live] + 1] <= rank[live]]
        if len(live):
            low, high, goal = at[live] + 1, base[live] + self.size[f"{name}s"][of[live]] - 1, rank[live]
            # before[low] <= goal < before[high]
            while (high - low > 1).any():
                middle = (low + high) >> 1
                below = before[middle] <= goal
                low, high = np.where(below, middle, low), np.where(below, high, middle)
            at[live] = low
        return at - base, before[at]

    def lows(self, i: np.ndarray, of: np.ndarray) -> np.ndarray:
        width, data = self.width[of], self.arrays["low"]
        bit = i * width
        word, shift = (bit >> 6) + self.at["low"][of], (bit & 63).astype(np.uint64)
        # shifted by 1 and 63 - shift, as a shift by 64 isn't defined
        got = (data[word] >> shift) | ((data[word + 1] << U64(1)) << (U64(63) - shift))
        return got & ((U64(1) << width.astype(np.uint64)) - U64(1))

    def access(self, i: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.int64)
        of = np.zeros(len(i), np.int64) if of is None else of
        word, before = self._word_of("one", i, of)
        place = word * 64 + _select(self.arrays["high"][self.at["high"][of] + word], i - before)
        return ((place - i) << self.width[of]) | self.lows(i, of).astype(np.int64)

    def _bucket_end(self, high: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many values have these high bits or less: the ones before the high-th zero."""
        word, before = self._word_of("zero", high, of)
        return word * 64 + _select(~self.arrays["high"][self.at["high"][of] + word], high - before) - high

    def find(self, values: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Where each value is, or -1: its bucket's range, then a binary search among low bits."""
        out = np.full(len(values), -1, np.int64)
        of = np.zeros(len(values), np.int64) if of is None else of
        at = np.flatnonzero((values >= 0) & (values <= self.last[of]))
        if not len(at):
            return out
        of, values = of[at], values[at]
        width = self.width[of]
        high = values >> width
        low = (values & ((1 << width) - 1)).astype(np.uint64)
        end = self._bucket_end(high, of)
        start = np.zeros(len(end), np.int64)
        later = np.flatnonzero(high > 0)
        start[later] = self._bucket_end(high[later] - 1, of[later])
        live = np.flatnonzero(start < end)
        at, low, start, end, of = at[live], low[live], start[live], end[live], of[live]
        stop = end.copy()
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            middle = (start[open_] + end[open_]) >> 1
            less = self.lows(middle, of[open_]) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        inside = np.flatnonzero(start < stop)
        good = inside[self.lows(start[inside], of[inside]) == low[inside]]
        out[at[good]] = start[good]
        return out


def save(path: str, arrays: dict[str, np.ndarray], numbers: dict[str, int]) -> None:
    """One file: a line of JSON, padded to 4096-byte pages or more, then the arrays, each at a multiple of 8 bytes."""
    head, at = {"numbers": numbers, "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 9) % 4096)

    def write(f):
        f.write(len(text).to_bytes(8, "little") + text + b"\n")
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))

    publish(path, write)


def load(path: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    return {name: np.frombuffer(data, kind, n, size + 9 + at) for name, (kind, n, at) in head["arrays"].items()}, head["numbers"]


def _pack(name: str, ef: EliasFano) -> tuple[dict, dict]:
    return {f"{name}.{k}": ef.arrays[k] for k in EliasFano.FIELDS}, {f"{name}.n": int(ef.n[0]), f"{name}.width": int(ef.width[0])}


_libc = ctypes.CDLL(None, use_errno=True)
_libc.mmap.restype, _libc.mmap.argtypes = ctypes.c_void_p, (ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long)
_libc.munmap.argtypes = (ctypes.c_void_p, ctypes.c_size_t)
_MAP_FIXED = 0x10


def _map(where: int | None, size: int, flags: int, file: int) -> int:
    got = _libc.mmap(where, size, mmap.PROT_READ, flags, file, 0)
    if got == ctypes.c_void_p(-1).value:
        raise OSError(ctypes.get_errno(), f"mmap of {size} bytes: {os.strerror(ctypes.get_errno())}")
    return got


class Shards:
    """Files name-low to name-(high - 1) of a folder, mapped one behind the other into one stretch of addresses.

    arrays[f] is the whole stretch in the kind of the array f; that of the k-th file begins at
    at[f][k] there and has size[f][k] elements, 0 if the file is missing. numbers[f][k]: its numbers.
    """

    def __init__(self, folder: str, name: str, low: int, high: int):
        files, total = [], 0
        for k in range(high - low):
            path = os.path.join(folder, f"{name}-{low + k}")
            try:
                size = os.stat(path).st_size
            except FileNotFoundError:
                continue
            files.append((k, path, total, size))
            total += -(-size // mmap.PAGESIZE) * mmap.PAGESIZE
        total = max(total, mmap.PAGESIZE)
        start = _map(None, total, mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS, -1)
        data = (ctypes.c_ubyte * total).from_address(start)
        # when the last array over these addresses is gone
        weakref.finalize(data, _libc.munmap, start, total)
        every = np.frombuffer(data, np.uint8)
        self.arrays, self.at, self.size, self.numbers = {}, {}, {}, {}
        for k, path, at, size in files:
            with open(path, "rb") as f:
                _map(start + at, size, mmap.MAP_SHARED | _MAP_FIXED, f.fileno())
            begin = int.from_bytes(every[at : at + 8].tobytes(), "little")
            head = json.loads(every[at + 8 : at + 8 + begin].tobytes())
            for f, (kind, n, inside) in head["arrays"].items():
                if f not in self.arrays:
                    self.arrays[f] = every.view(kind)
                    self.at[f], self.size[f] = np.zeros((2, high - low), np.int64)
                self.at[f][k], self.size[f][k] = (at + begin + 9 + inside) // np.dtype(kind).itemsize, n
            for f, x in head["numbers"].items():
                self.numbers.setdefault(f, np.zeros(high - low, np.int64))[k] = x
        self.found = np.zeros(high - low, bool)
        self.found[[k for k, *_ in files]] = True

    def get(self, name: str, of: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The i-th elements of the array in the files `of`."""
        return self.arrays[name][self.at[name][of] + i]

    def sequences(self, name: str) -> EliasFano:
        part = lambda x: {k: x[f"{name}.{k}"] for k in EliasFano.FIELDS}
        return EliasFano(self.numbers[f"{name}.n"], self.numbers[f"{name}.width"], part(self.arrays), part(self.at), part(self.size))


#: So many shards are mapped, and asked, at once. A process has at most MAPPED such groups of a kind, as the system bounds its mappings (65,530 by default).
GROUP = 4096
MAPPED = 4
#: Questions that are answered at once.
BLOCK = 1 << 15


class Groups:
    """The shards of a kind of file in groups, each opened by make(folder, name, low, high) when it's first needed."""

    def __init__(self, sizes: "Sizes", name: str, make=Shards):
        self.sizes, self.name, self.make, self.open = sizes, name, make, {}

    def __call__(self, shard: np.ndarray):
        """(group, places, shards as numbers within the group) for each group of these shards, which ascend, in blocks that the processor's cache holds."""
        cuts = np.searchsorted(shard, np.arange(0, self.sizes.shards + GROUP, GROUP))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            if g not in self.open:
                while len(self.open) >= MAPPED:
                    del self.open[next(iter(self.open))]
                self.open[g] = self.make(self.sizes.folder, self.name, g * GROUP, min((g + 1) * GROUP, self.sizes.shards))
            for a in range(cuts[g], cuts[g + 1], BLOCK):
                b = min(a + BLOCK, cuts[g + 1])
                yield self.open[g], slice(a, b), shard[a:b] - g * GROUP


def quantise(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(x) * GRAIN), 0, 65535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -GRAIN)


# ---------------------------------------------------------------- words


@dataclass
class Sizes:
    """What all tasks know of the model: folder, shards of words and of contexts, words before each shard of words, training texts, tokens and words."""

    folder: str
    shards: int
    before: list[int]
    texts: int
    tokens: int
    words: int

    # words that aren't of the vocabulary
    @property
    def start(self) -> int:
        return self.words

    @property
    def before_start(self) -> int:
        return self.words + 1

    @property
    def unknown(self) -> int:
        return self.words + 2


def _shard_of_word(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray):
    """(shard, places) for each shard that occurs."""
    order = np.argsort(shard.astype(np.int32), kind="stable")
    ordered = shard[order]
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    for a, b in zip(firsts, np.append(firsts[1:], len(order))):
        yield int(ordered[a]), order[a:b]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and for each value where it is among them."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(first) - 1
    return ordered[first], places


def _by_shard_first(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, and by place within one; and where each place comes in it."""
    key = (shard.astype(np.uint64) << U64(32)) | np.arange(len(shard), dtype=np.uint64)
    key.sort()
    order = (key & U64(0xFFFFFFFF)).astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


class Vocabulary:
    """Word numbers and counts by hash, from mapped files: sorted hashes with a table of where each leading value begins. Numbers ascend with hashes."""

    def __init__(self, sizes: Sizes):
        self.sizes, self.files, self.before = sizes, Groups(sizes, "words"), np.array(sizes.before)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or unknown) and count (or 0) of each word, of hashes that ascend."""
        number = np.full(len(hashes), self.sizes.unknown, np.int64)
        count = np.zeros(len(hashes), np.int64)
        shard = _shard_of_word(hashes, self.sizes.shards)
        for files, places, of in self.files(shard):
            live = np.flatnonzero(files.size["hashes"][of])
            of, own, places = of[live], hashes[places][live], live + places.start
            slot = _slot(own, shard[places], self.sizes.shards, files.size["starts"][of] - 1)
            at, end = files.get("starts", of, slot).astype(np.int64), files.get("starts", of, slot + 1).astype(np.int64)
            live = np.arange(len(own))
            while True:
                live = live[at[live] < end[live]]
                live = live[files.get("hashes", of[live], at[live]) < own[live]]
                if not len(live):
                    break
                at[live] += 1
            good = np.flatnonzero(at < end)
            good = good[files.get("hashes", of[good], at[good]) == own[good]]
            number[places[good]] = at[good] + self.before[shard[places[good]]]
            count[places[good]] = files.get("counts", of[good], at[good])
        return number, count

    def shard_of_number(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, numbers, "right") - 1

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often the words with these numbers, which ascend, occur."""
        out = np.zeros(len(numbers), np.int64)
        shard = self.shard_of_number(numbers)
        for files, places, of in self.files(shard):
            out[places] = files.get("counts", of, numbers[places] - self.before[shard[places]])
        return out


def _slot(hashes: np.ndarray, shard: np.ndarray | int, shards: int, slots: np.ndarray | int) -> np.ndarray:
    """Which of its shard's slots a hash belongs to; monotone, and nearly equal in size."""
    low = -(-(np.asarray(shard, np.int64) << 32) // shards)
    inside = ((hashes >> U64(32)).astype(np.int64) - low).astype(np.float64)
    return np.minimum((inside * (slots * shards / 2.0**32)).astype(np.int64), slots - 1)


#: What this process has mapped of the latest model, so that its later tasks needn't open all files again.
_opened: dict = {}


def _kept(make, sizes: Sizes):
    """make(sizes), or what it gave for the same model before."""
    if _opened.get("folder") != sizes.folder:
        _opened.clear()
        _opened["folder"] = sizes.folder
    if make not in _opened:
        _opened[make] = make(sizes)
    return _opened[make]


_ZSTD = pa.Codec("zstd", compression_level=1)


def _coded(x: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, compressed: all their first bytes, all their second, and so on, as those are alike."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes.reshape(-1), asbytes=True)


def _decoded(data: pa.Buffer, width: int) -> np.ndarray:
    data = memoryview(data)
    n = int.from_bytes(data[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(data[8:], n * width), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def _all(column: pa.ChunkedArray, decode) -> np.ndarray:
    return np.concatenate([decode(x.as_buffer()) for x in column])


def _differences(x: np.ndarray) -> np.ndarray:
    """Of ascending numbers, from 0 on: they are small, and compress. cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


#: Blocks of so many input partitions are added up in one task. A level of that writes all blocks once more.
FAN_IN = 512


def _add_up(blocks: DataFrame, schema: str, merge, partitions: int) -> DataFrame:
    """Blocks (shard, part, ...) with those of FAN_IN neighbouring parts of a shard added up by merge, until a shard has at most FAN_IN. So no task gets a frequent row from more than FAN_IN blocks, however many partitions there are."""
    while partitions > FAN_IN:
        partitions = -(-partitions // FAN_IN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("shard", "part").applyInArrow(merge, schema)
    return blocks


def _sum_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hashes = _all(table.column("hashes"), lambda x: np.cumsum(_decoded(x, 8).view(np.uint64)))
    counts = _all(table.column("counts"), lambda x: _decoded(x, 8))
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    firsts = np.flatnonzero(np.diff(hashes, prepend=hashes[0] ^ U64(1)))
    return hashes[firsts], np.add.reduceat(counts, firsts)


WORD_BLOCKS = "shard int, part int, hashes binary, counts binary"


def _merge_words(table: pa.Table) -> pa.Table:
    hashes, counts = _sum_words(table)
    return pa.table({"shard": table.column("shard").slice(0, 1), "part": table.column("part").slice(0, 1), "hashes": pa.array([_coded(_differences(hashes), 8)], pa.binary()), "counts": pa.array([_coded(counts, 8)], pa.binary())})


def _count_words(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, part, hashes, counts) blocks of the training texts' words, added up within a partition."""

    def run(batches):
        held, size, texts = [], 0, 0

        def out():
            hashes = np.concatenate([h for h, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            firsts = np.flatnonzero(np.diff(hashes, prepend=hashes[0] ^ U64(1)))
            hashes, counts = hashes[firsts], np.add.reduceat(counts, firsts)
            shard = _shard_of_word(hashes, shards)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(np.full(len(some), TaskContext.get().partitionId()), pa.int32()), pa.array([_coded(_differences(hashes[cut[s] : cut[s + 1]]), 8) for s in some], pa.binary()), pa.array([_coded(counts[cut[s] : cut[s + 1]], 8) for s in some], pa.binary())], names=["shard", "part", "hashes", "counts"]
            )

        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                found = np.unique(words_of(piece.column("text"), True).hashes, return_counts=True)
                held.append(found)
                texts += piece.num_rows
                size += len(found[0])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if texts:
            held.append((np.array([END]), np.array([texts])))
            yield out()

    return docs.mapInArrow(releasing(run), WORD_BLOCKS)


def _write_words(folder: str, shards: int):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        hashes, counts = _sum_words(table)
        slots = max(1, len(hashes))
        starts = np.searchsorted(_slot(hashes, s, shards, slots), np.arange(slots + 1)).astype(np.uint32)
        save(os.path.join(folder, f"words-{s}"), {"hashes": hashes, "starts": starts, "counts": counts}, {})
        ends = int(counts[hashes == END].sum())
        return pa.table({"shard": pa.array([s], pa.int32()), "words": [len(hashes)], "tokens": [int(counts.sum())], "texts": [ends]})

    return run


# ---------------------------------------------------------------- contexts


def _ids(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of the different words, which of them each text's words are, each text followed by the end, and where each text begins in those."""
    w = words_of(column, True)
    n = len(w.offsets) - 1
    offsets = w.offsets + np.arange(n + 1)
    hashes = np.full(int(offsets[-1]), END, np.uint64)
    inside = np.ones(len(hashes), bool)
    inside[offsets[1:] - 1] = False
    hashes[inside] = w.hashes
    found, word = _distinct(hashes)
    return *vocabulary.numbers(found), word, offsets


def _shard_of_pair(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of_word(mix((a.astype(np.uint64) << U64(32)) ^ b.astype(np.uint64) ^ U64(0x1234567)), shards)


def _before(words: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """What is before each word; start before a text's first."""
    out = np.concatenate(([0], words[:-1]))
    out[offsets[:-1]] = start
    return out


def _width(sizes: Sizes) -> int:
    return max(1, (sizes.unknown.bit_length() + 7) // 8)


def _grouped(shards: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray):
    """Rows (32-bit numbers) sorted by (shard of the pair, a, b, c), equal ones added up; shards 0: by (a, b, c) alone, and shard 0."""
    pairs, pair = _distinct((a.astype(np.uint64) << U64(32)) | b)
    shard = np.zeros(len(pairs), np.int64)
    if shards:
        shard = _shard_of_pair(pairs >> U64(32), pairs & U64(0xFFFFFFFF), shards)
        order, rank = _by_shard_first(shard)
        pairs, shard, pair = pairs[order], shard[order], rank[pair]
    key = (pair.astype(np.uint64) << U64(32)) | c
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    firsts = np.flatnonzero(first)
    n = np.add.reduceat(n[order], firsts) if len(firsts) else n
    key = key[firsts]
    pair = (key >> U64(32)).astype(np.int64)
    return shard[pair], (pairs >> U64(32)).astype(np.uint32)[pair], pairs.astype(np.uint32)[pair], key.astype(np.uint32), n


TRIGRAM_BLOCKS = "shard int, part int, first binary, second binary, third binary, n binary"


def _blocks(shards: list[int], part: int, columns: list[tuple[np.ndarray, ...]], width: int) -> pa.RecordBatch:
    """A row for each shard: its trigrams' columns a, b, c and n."""
    kinds = (lambda x: _coded(_differences(x), width), lambda x: _coded(x, width), lambda x: _coded(x, width), lambda x: _coded(x, 4))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([part] * len(shards), pa.int32()), *(pa.array([f(c[k]) for c in columns], pa.binary()) for k, f in enumerate(kinds))], names=["shard", "part", "first", "second", "third", "n"])


def _sum_trigrams(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    a = _all(table.column("first"), lambda x: np.cumsum(_decoded(x, width)).astype(np.uint32))
    b, c = (_all(table.column(k), lambda x: _decoded(x, width).astype(np.uint32)) for k in ("second", "third"))
    return _grouped(0, a, b, c, _all(table.column("n"), lambda x: _decoded(x, 4).astype(np.uint32)))[1:]


def _merge_trigrams(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        shard, part, width = table.column("shard")[0].as_py(), table.column("part")[0].as_py(), _width(sizes)
        return pa.Table.from_batches([_blocks([shard], part, [_sum_trigrams(table, width)], width)])

    return run


def _count_trigrams(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(shard, part, first, second, third, n) blocks, added up within a partition. A pair that ends a text is followed by the number `unknown`, so that it's counted as a pair."""

    def run(batches):
        vocabulary, width = _kept(Vocabulary, sizes), _width(sizes)
        held, size = [], 0

        def out():
            a, b, c = (np.concatenate(x) for x in zip(*held))
            shard, a, b, c, n = _grouped(sizes.shards, a, b, c, np.ones(len(a), np.uint32))
            cut = np.searchsorted(shard, np.arange(sizes.shards + 1))
            some = np.flatnonzero(np.diff(cut))
            return _blocks([int(x) for x in some], TaskContext.get().partitionId(), [tuple(x[cut[k] : cut[k + 1]] for x in (a, b, c, n)) for k in some], width)

        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                number, _, word, offsets = _ids(piece.column("text"), vocabulary)
                numbers = number[word]
                one = _before(numbers, offsets, sizes.start)
                two = _before(one, offsets, sizes.before_start)
                last = offsets[1:] - 1
                held.append(tuple(np.concatenate(x).astype(np.uint32) for x in ((two, one[last]), (one, numbers[last]), (numbers, np.full(len(last), sizes.unknown)))))
                size += len(numbers)
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(releasing(run), TRIGRAM_BLOCKS)


def _relative(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """values, increasing from each of firsts on, as one increasing sequence: each context adds the end of the one before."""
    lasts = np.append(firsts[1:], len(values)) - 1
    base = np.concatenate(([0], np.cumsum(values[lasts] + 1)[:-1])) if len(firsts) else np.zeros(0, np.int64)
    return values + np.repeat(base, np.diff(np.append(firsts, len(values))))


def _write_trie(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        width, vocabulary = _width(sizes), _kept(Vocabulary, sizes)
        s = table.column("shard")[0].as_py()
        a, b, c, n = _sum_trigrams(table, width)
        del table
        a, b, c, n = (x.astype(np.int64) for x in (a, b, c, n))
        pair = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        n2 = np.add.reduceat(n, pair)
        a2, b2 = a[pair], b[pair]
        real = c != sizes.unknown
        kinds = np.add.reduceat(real.astype(np.int64), pair)
        # level 3
        of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(a))))
        c3, n3, p3 = c[real], n[real], of_pair[real]
        pointers3 = np.concatenate(([0], np.cumsum(kinds)))
        third = _relative(c3, pointers3[:-1][kinds > 0])
        # level 2: a pair with the start of a text second is a context only
        totals = np.full(len(a2), sizes.texts, np.int64)
        inner = a2 < sizes.words
        totals[inner] = vocabulary.counts(a2[inner])
        own2 = quantise(np.maximum(n2 - DISCOUNT, 1e-9) / totals)
        weight2 = quantise(np.maximum(DISCOUNT * kinds, 1e-9) / n2)
        first = np.flatnonzero(np.concatenate(([True], a2[1:] != a2[:-1])))
        second = _relative(b2, first)
        arrays, numbers = {"own2": own2, "weight2": weight2, "own3": quantise((n3 - DISCOUNT) / n2[p3])}, {}
        for name, values in (("words1", a2[first]), ("pointers2", np.append(first, len(a2))), ("words2", second), ("pointers3", pointers3), ("words3", third)):
            more = _pack(name, EliasFano.of(values))
            arrays |= more[0]
            numbers |= more[1]
        save(os.path.join(sizes.folder, f"trie-{s}"), arrays, numbers)
        # how many different words follow each first word here, for its weight
        followers = np.diff(np.append(first, len(a2)))
        one = a2[first]
        known = one < sizes.words
        shard = vocabulary.shard_of_number(one[known])
        rows = [(int(k), _coded(_differences(one[known][p]), width), _coded(followers[known][p], 4)) for k, p in _by_shard(shard)]
        starts = int(followers[one == sizes.start].sum())
        rows.append((-1, b"", _coded(np.array([starts]), 4)))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _write_weights(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        s, width = table.column("shard")[0].as_py(), _width(sizes)
        kinds = _all(table.column("n"), lambda x: _decoded(x, 4))
        if s < 0:
            save(os.path.join(sizes.folder, "start"), {"weight": quantise(np.array([max(DISCOUNT * kinds.sum(), 1e-9) / max(sizes.texts, 1)]))}, {})
        else:
            words = _all(table.column("word"), lambda x: np.cumsum(_decoded(x, width))) - sizes.before[s]
            counts = load(os.path.join(sizes.folder, f"words-{s}"))[0]["counts"]
            sums = np.bincount(words, kinds, len(counts))
            save(os.path.join(sizes.folder, f"weights-{s}"), {"weight": quantise(np.maximum(DISCOUNT * sums, 1e-9) / counts)}, {})
        return pa.table({"shard": pa.array([s], pa.int32())})

    return run


def train(docs: DataFrame, scratch: Scratch, text: str = "text", bytes_in_shard: int = 16 << 20) -> Sizes:
    """Fit the model on all rows of docs and write its files. The driver gets a row for each shard.

    Counts are blocks of arrays that are added up within partitions before each of the three
    shuffles: words by hash, trigrams by context, followers by word. Of words and trigrams, blocks
    of FAN_IN partitions are then added up, and of FAN_IN such, so a task gets a frequent row at
    most FAN_IN times. A context of two words is the unit that isn't split; it has at most as many
    rows as there are words.
    """
    docs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size, last = docs.withColumn("part", F.spark_partition_id()).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    partitions = last + 1
    shards = max(4, math.ceil(size / bytes_in_shard))
    folder = scratch.folder("model")
    counted = _add_up(_count_words(docs, shards), WORD_BLOCKS, _merge_words, partitions).groupBy("shard").applyInArrow(_write_words(folder, shards), "shard int, words bigint, tokens bigint, texts bigint").collect()
    words = [0] * (shards + 1)
    for r in counted:
        words[r["shard"] + 1] = r["words"]
    for s in set(range(shards)) - {r["shard"] for r in counted}:
        save(os.path.join(folder, f"words-{s}"), {"hashes": np.zeros(0, np.uint64), "starts": np.zeros(1, np.uint32), "counts": np.zeros(0, np.int64)}, {})
    before = np.cumsum(words).tolist()
    sizes = Sizes(folder, shards, before[:-1], sum(r["texts"] for r in counted), sum(r["tokens"] for r in counted), before[-1])
    # the word number is looked up with searchsorted on `before`, where an empty shard ties with the next: the right one is the last
    if sizes.unknown >= 1 << 32:
        raise ValueError(f"{sizes.words} words: numbers of words have 32 bits")
    followers = _add_up(_count_trigrams(docs, sizes), TRIGRAM_BLOCKS, _merge_trigrams(sizes), partitions).groupBy("shard").applyInArrow(_write_trie(sizes), "shard int, word binary, n binary")
    followers.groupBy("shard").applyInArrow(_write_weights(sizes), "shard int").collect()
    return sizes


# ---------------------------------------------------------------- scores


class TrieShards:
    """The trie files of a group of shards."""

    def __init__(self, folder: str, name: str, low: int, high: int):
        files = Shards(folder, name, low, high)
        self.found, self.get = files.found, files.get
        if self.found.any():
            self.words1, self.pointers2, self.words2, self.pointers3, self.words3 = (files.sequences(k) for k in ("words1", "pointers2", "words2", "pointers3", "words3"))

    @staticmethod
    def child(pointers: EliasFano, words: EliasFano, parent: np.ndarray, word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the word is among the parent's children, or -1, and how many children that has: a search relative to where the context before ends."""
        low, high = pointers.access(parent, of), pointers.access(parent + 1, of)
        base = np.zeros(len(low), np.int64)
        later = np.flatnonzero(low > 0)
        base[later] = words.access(low[later] - 1, of[later]) + 1
        at = words.find(base + word, of)
        return np.where((at >= low) & (at < high), at, -1), high - low


class Trie:
    """Questions to the trie, in ascending order of shards."""

    def __init__(self, sizes: Sizes):
        self.sizes, self.files = sizes, Groups(sizes, "trie", TrieShards)

    def pairs(self, shard: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair: its node in its shard or -1, and the share that level 2 gives it (0: none)."""
        node, own = np.full(len(a), -1, np.int64), np.zeros(len(a))
        known = np.flatnonzero((a != self.sizes.unknown) & (b != self.sizes.unknown))
        for t, places, of in self.files(shard[known]):
            live = np.flatnonzero(t.found[of])
            if not len(live):
                continue
            places, of = known[places][live], of[live]
            first = t.words1.find(a[places], of)
            live = np.flatnonzero(first >= 0)
            places, of, first = places[live], of[live], first[live]
            at, _ = t.child(t.pointers2, t.words2, first, b[places], of)
            live = np.flatnonzero(at >= 0)
            places, of, at = places[live], of[live], at[live]
            node[places] = at
            own[places] = restore(t.get("own2", of, at))
        return node, own

    def thirds(self, shard: np.ndarray, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context and word: the share that level 3 gives it, the context's weight for level 2 (1 if the context never occurs), and how often the three occur: exact up to some hundreds, as shares and weights are quantised."""
        own, weight, count = np.zeros(len(c)), np.ones(len(c)), np.zeros(len(c))
        known = np.flatnonzero(node >= 0)
        for t, places, of in self.files(shard[known]):
            places = known[places]
            weight[places] = restore(t.get("weight2", of, node[places]))
            live = np.flatnonzero(c[places] != self.sizes.unknown)
            places, of = places[live], of[live]
            at, kinds = t.child(t.pointers3, t.words3, node[places], c[places], of)
            live = np.flatnonzero(at >= 0)
            places, of, at = places[live], of[live], at[live]
            own[places] = restore(t.get("own3", of, at))
            count[places] = np.rint(own[places] * DISCOUNT * kinds[live] / weight[places] + DISCOUNT)
        return own, weight, count


class Scorer:
    """Each different word, pair and triple of a piece is looked up once, in the order of its shard."""

    def __init__(self, sizes: Sizes):
        self.sizes, self.vocabulary, self.trie, self.weights = sizes, _kept(Vocabulary, sizes), Trie(sizes), Groups(sizes, "weights")
        path = os.path.join(sizes.folder, "start")
        self.start = float(restore(load(path)[0]["weight"])[0]) if os.path.exists(path) else 1.0

    def _weight(self, word: np.ndarray) -> np.ndarray:
        """Of words whose known numbers ascend."""
        out = np.ones(len(word))
        out[word == self.sizes.start] = self.start
        known = np.flatnonzero(word < self.sizes.words)
        shard = self.vocabulary.shard_of_number(word[known])
        for files, places, of in self.weights(shard):
            kept = np.full(len(of), 65535, np.uint16)
            live = np.flatnonzero(files.found[of])
            if len(live):
                kept[live] = files.get("weight", of[live], word[known[places][live]] - self.vocabulary.before[shard[places][live]])
            out[known[places]] = restore(kept)
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Discounted, and the rest spread over all words and one unknown."""
        n, v = self.sizes.tokens, self.sizes.words
        if not n:
            return np.ones(len(count))
        return np.maximum(count - DISCOUNT, 0) / n + DISCOUNT * v / n / (v + 1)

    def score(self, column: pa.Array, held_out: np.ndarray) -> dict[str, np.ndarray]:
        if not len(column):
            return dict.fromkeys(("n_tokens", "n_known", "base_score", "score", "seen_share"), np.zeros(0))
        sizes = self.sizes
        number, count, word, offsets = _ids(column, self.vocabulary)
        # words are their places in number from here on; two more stand before a text
        kinds = len(number)
        start, before_start, every = kinds, kinds + 1, kinds + 2
        number = np.concatenate((number, [sizes.start, sizes.before_start]))
        weight, unigram = self._weight(number), self.unigram(count)
        # pairs of a word and the one before it; the last is that before a text's first word
        pairs, pair = _distinct(np.append(_before(word, offsets, start) * every + word, before_start * every + start))
        a, b = pairs // every, pairs % every
        shard = _shard_of_pair(number[a], number[b], sizes.shards)
        order, rank = _by_shard_first(shard)
        shard, a, b, pair = shard[order], a[order], b[order], rank[pair]
        node, own2 = self.trie.pairs(shard, number[a], number[b])
        inner = np.flatnonzero(b < kinds)
        lower = np.zeros(len(b))
        lower[inner] = own2[inner] + weight[a[inner]] * unigram[b[inner]]
        # a word's context is the pair before its own
        pair, begin = pair[:-1], pair[-1]
        triples, triple = _distinct(_before(pair, offsets, begin) * kinds + word)
        context = triples // kinds
        own3, weight3, occurs = self.trie.thirds(shard[context], node[context], number[triples % kinds])
        of_triple = np.empty(len(triples), np.int64)
        of_triple[triple] = pair
        p = np.log10(own3 + weight3 * lower[of_triple])
        # a training row's own occurrences don't count as seen: those of a triple that occurs once are its own
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        seen = occurs[triple] > 0.5
        trained = ~held_out[row]
        seen[trained] = False
        more = np.flatnonzero(trained & (occurs > 1.5)[triple])
        _, own = _distinct(row[more] * len(triples) + triple[more])
        seen[more] = occurs[triple[more]] - np.bincount(own)[own] > 0.5
        base = np.log10((count + 1) / (sizes.tokens + sizes.words + 1))
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        return {"n_tokens": np.diff(offsets), "n_known": add((count > 0).astype(np.int64)[word]), "base_score": add(base[word]), "score": add(p[triple]), "seen_share": add(seen.astype(np.float64)) / np.diff(offsets)}


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, gain double, seen_share double"


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), gain (how much score is above base_score, for each token) and seen_share.

    seen_share: the share of tokens that training rows other than the row itself have after the same two words;
    near 1 for a text of which training has a copy.

    Learns from the rows whose crc32 of the id as text, modulo folds, isn't held (a null id counts
    as an empty text). Words: [^\\x20\\x09-\\x0D]+ with A-Z as a-z, then one end. A null or empty
    text is an end alone. Without training rows every word has probability 1 and scores are 0.
    Repeated rows count each time; an empty table gives an empty one; other columns aren't read.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == held).alias("held_out"))
    sizes = train(rows.where(~F.col("held_out")), Scratch(docs.sparkSession, "ngrams"))

    def run(batches):
        scorer = _kept(Scorer, sizes)
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                got = scorer.score(piece.column("text"), piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("held_out"), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(np.full(piece.num_rows, sizes.tokens), pa.int64()), *(pa.array(x, pa.float64()) for x in (got["base_score"], got["score"], (got["score"] - got["base_score"]) / got["n_tokens"], got["seen_share"]))],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    return rows.mapInArrow(releasing(run), SCORES)
