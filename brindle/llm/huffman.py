"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by table in blocks with bit-offset checkpoints."""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, letters_and_marks, local_path, pieces, publish

MAGIC = b"BRNDHUF1"
#: Ids of a block, and ids between two checkpoints of a block.
BLOCK, STEP = 1 << 16, 1 << 8
MOST_BITS = 18


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code without a code longer than `most` bits (package-merge). An id that never occurs has length 0; a single id has 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # levels[k]: which of the sorted items and packages of level k are items
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate((weights, packages))
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(weights))
        merged = merged[at]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take = 2 * len(used) - 2
    lengths = np.zeros(len(used), np.int64)
    for is_item in reversed(levels):
        items = int(is_item[:take].sum())
        lengths[:items] += 1
        take = 2 * (take - items)
    out[order] = lengths
    return out


class Code:
    """The canonical code of the given lengths: codes of one length are consecutive, by id. table: for each `bits` next bits, the id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.bits = int(lengths.max()) if len(used) else 1
        sorted_lengths = lengths[order].astype(np.int64)
        span = np.int64(1) << (self.bits - sorted_lengths)
        first = np.concatenate(([0], np.cumsum(span)))[:-1]
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = first >> (self.bits - sorted_lengths)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat(order, span)
        self.symbol[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids (most significant first; 8 bytes of padding), and at which bit each STEP ids begin."""
        lengths = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 32 + 3, np.uint64)
        # a code lies in the 64 bits that begin at its 32-bit word; neighbours' bits are disjoint, so sums are unions
        shifted = self.codes[ids].astype(np.uint64) << (64 - (starts & 31) - lengths).astype(np.uint64)
        at = starts >> 5
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        if len(ids):
            np.add.at(words, at[firsts], np.add.reduceat(shifted >> np.uint64(32), firsts))
            np.add.at(words, at[firsts] + 1, np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), firsts))
        return words[: total // 32 + 3].astype(">u4").tobytes(), starts[::STEP].astype(np.uint32)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block. All stretches between checkpoints take a step at once."""
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        out = np.zeros(len(checkpoints) * STEP, np.uint32)
        at, base = checkpoints.astype(np.int64), np.arange(len(checkpoints)) * STEP
        full = n // STEP
        for k in range(min(STEP, n)):
            if k == n - full * STEP and len(at) > full:
                at, base = at[:full], base[:full]
            word = at >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            got = self.symbol[(window >> (64 - self.bits - (at & 31)).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)]
            out[base + k] = got
            at = at + self.lengths[got]
        return out[:n]


# ---------------------------------------------------------------- ids


#: How byte-level vocabularies write a space.
SPACE = "\u0120"


class Words:
    """Ids of texts by the tokenizers library, which gets each word once.

    A chunk begins before each space that a character other than white space follows: a
    byte-level pattern starts a token there whatever comes before. Of chunks of Latin letters
    and a mark, or two such with a line feed between, the library's model gets the letters; any other chunk is encoded by the library
    whole, and so is a text with a special token.
    """

    CUT = re.compile(r" (?=\S)")
    ODD = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        #: ids of chunks that follow a space, by what follows it, and of words with and without a space before them
        self.most, self.known, self.words = most, Known(self._chunk), {}
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(_byte_characters())})
        self.code = "H" if self.type == np.uint16 else "I"
        self.marks = {"": b""} | {c: self._ids(c) for c in ".,;:!?"}
        self.line_feed = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        """Ids of letters, with the sign of a space before them or nothing."""
        key = before + word
        found = self.words.get(key)
        if found is None:
            plain = key if word.isascii() else before + word.encode().decode("latin-1").translate(self.characters)
            found = self.words[key] = array(self.code, [t.id for t in self.library.model.tokenize(plain)]).tobytes()
        return found

    def _plain(self, chunk: str, before: str) -> bytes | None:
        if found := letters_and_marks(chunk):
            letters, marks = found
            if not marks:
                return self._word(letters, before)
            tail = self.marks.get(marks)
            if tail is None:
                tail = self._ids(marks)
                if len(self.marks) < 10_000:
                    self.marks[marks] = tail
            return self._word(letters, before) + tail
        return None

    def _lines(self, chunk: str) -> bytes | None:
        """Of a chunk of two plain ones with one line feed between, which is a token of its own there."""
        a, _, b = chunk.partition("\n")
        first = self._plain(a, SPACE)
        second = self._plain(b, "") if first else None
        return first + self.line_feed + second if second else None

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that follows a space."""
        found = self._lines(chunk) if "\n" in chunk else self._plain(chunk, SPACE)
        return self._ids(" " + chunk) if found is None else found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        for cache in (self.known, self.words):
            if len(cache) > self.most:
                cache.clear()
        out, ids = [], self.known.__getitem__
        for t in texts:
            if not t:
                out.append(b"")
            elif any(s in t for s in self.special):
                out.append(self._ids(t))
            else:
                parts = self.CUT.split(t) if self.ODD.search(t) else t.split(" ")
                # the first chunk has no space before it
                first = parts.pop(0)
                out.append((self._plain(first, "") or self._ids(first)) + b"".join(map(ids, parts)))
        return out


class Known(dict):
    """Ids by chunk; a chunk that isn't there yet is encoded by `encode` and kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self.encode(chunk)
        return found


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies have for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


_words: dict[str, Words] = {}


def _tokenizer(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _raw(docs: DataFrame, folder: str, tokenizer: str, end: int, id: str, text: str) -> DataFrame:
    """Encode once: ids go to files of this job, and a row for each document says where; counts has the file's counts of ids, in its first row."""

    def run(batches):
        part = TaskContext.get().partitionId()
        words = _tokenizer(tokenizer)
        name = os.path.join(folder, f"ids-{part}-{uuid.uuid4().hex}")
        size = max(words.library.get_vocab_size(), end + 1)
        counts, offset, tail = np.zeros(size, np.int64), 0, np.array([end], words.type).tobytes()
        with open(name, "wb", buffering=1 << 20) as f:
            for batch in batches:
                for piece in pieces(batch, "text", 2 << 20):
                    own = [x + tail for x in words.encode(piece.column("text").to_pylist())]
                    data = b"".join(own)
                    counts += np.bincount(np.frombuffer(data, words.type), minlength=size)
                    lengths = np.array([len(x) for x in own], np.int64) // words.type().itemsize
                    f.write(data)
                    starts = offset + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                    offset += int(lengths.sum())
                    yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.full(len(own), part)), pa.array(starts), pa.array(lengths), pa.array([name] * len(own)), pa.nulls(len(own), pa.binary())], names=["id", "part", "at", "n", "file", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part]), pa.array([0]), pa.array([-1]), pa.array([name]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["id", "part", "at", "n", "file", "counts"])

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, part bigint, at bigint, n bigint, file string, counts binary")


def _sum_counts(raw: DataFrame) -> np.ndarray:
    """Counts of all ids: a vector of the vocabulary's size for each partition, added up by groups of partitions, then by the driver."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                own = np.frombuffer(zlib.decompress(x), np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["counts"])

    only = raw.where("n < 0").select("counts").coalesce(64)
    parts = only.mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in parts), np.zeros(1, np.int64))


# ---------------------------------------------------------------- files


class Writer:
    """One file: MAGIC, blocks, then the index (documents' ids and lengths; blocks' places and checkpoints) and where it begins."""

    def __init__(self, f, code: Code):
        self.f, self.code, self.held, self.n = f, code, [], 0
        self.ids, self.lengths, self.nulls, self.blocks, self.checkpoints = [], [], [], [], []
        f.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, id: int | None, ids: np.ndarray) -> None:
        self.ids.append(0 if id is None else id)
        self.nulls.append(id is None)
        self.lengths.append(len(ids))
        while len(ids):
            room = BLOCK - self.n
            self.held.append(ids[:room])
            self.n += len(ids[:room])
            ids = ids[room:]
            if self.n == BLOCK:
                self.flush()

    def flush(self) -> None:
        if self.n:
            data, checkpoints = self.code.encode(np.concatenate(self.held))
            self.f.write(data)
            self.blocks.append((self.at, len(data), self.n, len(checkpoints)))
            self.checkpoints.append(checkpoints)
            self.at += len(data)
            self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        arrays = (np.array(self.ids, "<i8"), np.array(self.nulls, "u1"), np.array(self.lengths, "<i8"), np.array(self.blocks, "<i8").reshape(-1, 4), np.concatenate([*self.checkpoints, np.zeros(0, np.uint32)]).astype("<u4"))
        head = np.array([len(self.ids), len(self.blocks), len(arrays[4]), self.at], "<i8")
        for a in arrays:
            self.f.write(a.tobytes())
        self.f.write(head.tobytes())


class Reader:
    """Reads a file of Writer; ids(first, last) decodes only the blocks that hold them."""

    def __init__(self, path: str, code: Code):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.data[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} isn't a file of this format")
        self.code = code
        docs, blocks, marks, at = np.frombuffer(self.data[-32:], "<i8")
        take = lambda kind, n, width: np.frombuffer(self.data[width : width + int(n) * np.dtype(kind).itemsize], kind)
        self.doc_ids = take("<i8", docs, at)
        self.nulls = take("u1", docs, at + 8 * docs)
        self.lengths = take("<i8", docs, at + 9 * docs)
        self.blocks = take("<i8", 4 * blocks, at + 17 * docs).reshape(-1, 4)
        self.marks = take("<u4", marks, at + 17 * docs + 32 * blocks)
        self.mark_at = np.concatenate(([0], np.cumsum(self.blocks[:, 3]))).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        at, size, n, _ = (int(x) for x in self.blocks[k])
        return self.code.decode(self.data[at : at + size], self.marks[self.mark_at[k] : self.mark_at[k + 1]], n)

    def documents(self):
        """(id or None, ids) of each document, in order; holds one block and what a document has of others."""
        k, held, at = 0, np.zeros(0, np.uint32), 0
        for i in range(len(self.doc_ids)):
            need, parts = int(self.lengths[i]), []
            while need:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                part = held[at : at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield None if self.nulls[i] else int(self.doc_ids[i]), parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])


def write(docs: DataFrame, uri: str, tokenizer: str, end: int = 2, id: str = "doc_id", text: str = "text", ids_in_file: int = 16 << 20) -> dict:
    """Write the ids of all rows of docs, each with `end` after it, to files under uri in ascending order of the id; return the manifest.

    Ids are the tokenizers library's with add_special_tokens=False. A null or empty text has the
    end id alone. Null ids come first, repeated ids one after another; an empty table gives a
    manifest without files. uri must be a mounted folder, as files are memory-mapped. The
    manifest (manifest.json) names the files with their counts; codebook.npy has the code lengths.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    raw = scratch.table(_raw(docs, scratch.folder("raw"), tokenizer, end, id, text), "places")
    lengths = code_lengths(_sum_counts(raw))
    folder = local_path(uri)
    os.makedirs(folder, exist_ok=True)
    publish(os.path.join(folder, "codebook.npy"), lambda f: np.save(f, lengths))
    narrow = raw.where("n >= 0").select("id", "part", "at", "n", "file")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, -(-total // ids_in_file))
    kind = _tokenizer(tokenizer).type

    def pack(batches):
        code, writer, name = Code(np.load(os.path.join(folder, "codebook.npy"))), None, None
        opened: dict[str, np.ndarray] = {}
        docs_in, ids_in = 0, 0
        low = None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"ids-{uuid.uuid4().hex}.huf"
                    f = open(os.path.join(folder, name), "wb", buffering=1 << 20)
                    writer, low = Writer(f, code), row["id"]
                if row["file"] not in opened:
                    if len(opened) > 128:
                        opened.clear()
                    opened[row["file"]] = np.memmap(row["file"], kind, "r")
                writer.add(row["id"], opened[row["file"]][row["at"] : row["at"] + row["n"]])
                docs_in += 1
                ids_in += row["n"]
        if writer is not None:
            writer.close()
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([docs_in], pa.int64()), pa.array([ids_in], pa.int64()), pa.array([low], pa.int64())], names=["part", "name", "docs", "ids", "low"])

    ordered = narrow.repartitionByRange(files, "id", "part", "at").sortWithinPartitions("id", "part", "at")
    done = ordered.mapInArrow(pack, "part bigint, name string, docs bigint, ids bigint, low bigint").collect()
    manifest = {"files": [{"name": r["name"], "docs": r["docs"], "ids": r["ids"], "first_id": r["low"]} for r in sorted(done, key=lambda r: r["part"])], "end": end}
    start = 0
    for f in manifest["files"]:
        f["start"] = start
        start += f["ids"]
    publish(os.path.join(folder, "manifest.json"), lambda f: f.write(json.dumps(manifest).encode()))
    scratch.drop("raw", "places")
    return manifest


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark: SparkSession, uri: str, ids: bool = False) -> DataFrame:
    """One row for each document of the files under uri: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array<int>)."""
    folder = local_path(uri)
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    entries = [(x["name"], x["start"]) for x in manifest["files"]]
    schema = READ + ", ids array<int>" * ids

    def run(batches):
        code = None
        for batch in batches:
            for row in batch.to_pylist():
                code = code or Code(np.load(os.path.join(folder, "codebook.npy")))
                start, held = row["start"], []

                def out():
                    cols = [pa.array(c, pa.int64()) for c in zip(*[h[:4] for h in held])]
                    return pa.RecordBatch.from_arrays([*cols, *([pa.array([h[4].astype(np.int32) for h in held], pa.list_(pa.int32()))] if ids else [])], names=[x.split()[0] for x in schema.split(", ")])

                for doc, own in Reader(os.path.join(folder, row["name"]), code).documents():
                    held.append((doc, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), own if ids else None))
                    start += len(own)
                    if len(held) == 2000:
                        yield out()
                        held = []
                if held:
                    yield out()

    files = spark.createDataFrame(entries, "name string, start bigint")
    return files.repartition(max(1, len(entries)), "name").mapInArrow(run, schema)
