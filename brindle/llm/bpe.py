"""BPE encoding and decoding: frequent words in a minimal acyclic transducer that is memory-mapped; all other words are merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, letters_and_marks, pieces, publish, releasing

# ---------------------------------------------------------------- the transducer


class Transducer:
    """A minimal acyclic automaton of byte strings. Numbers on its transitions add up to a word's rank among all words, which leads to the word's ids.

    Arrays, each a file: keys (state * 256 + byte, sorted), targets and numbers of the
    transitions, final states, and offsets into ids.
    """

    ARRAYS = ("keys", "targets", "numbers", "final", "offsets", "ids")

    def __init__(self, folder: str):
        for name in self.ARRAYS:
            setattr(self, name, np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r"))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, or -1. All words take a step at once."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.final):
            return out
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(words), np.uint8)
        live, state, rank = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            over = lengths[live] == step
            ended = live[over]
            good = self.final[state[ended]]
            out[ended[good]] = rank[ended[good]]
            live = live[~over]
            if not len(live) or not len(self.keys):
                break
            key = state[live] * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, at = live[found], at[found]
            rank[live] += self.numbers[at]
            state[live] = self.targets[at]
            step += 1
        return out

    def output(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tobytes()


def compile_transducer(entries: dict[bytes, bytes], folder: str) -> None:
    """Build it from the sorted words by sharing equal states as soon as they can't change any more, and write its arrays."""
    words = sorted(entries)
    # a state: [final, {byte: state}, number of words at or below it]
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple, int]] = []
    path: list[list] = [[False, {}]]

    def freeze(node) -> int:
        arcs = tuple(node[1].items())
        key = (node[0], arcs)
        if key not in register:
            register[key] = len(states)
            states.append((node[0], arcs, node[0] + sum(states[t][2] for _, t in arcs)))
        return register[key]

    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(node)
        for _ in word[shared:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = freeze(node)
    root = freeze(path[0])
    # the root is state 0
    renumber = lambda s: 0 if s == root else s + 1 if s < root else s
    keys, targets, numbers = [], [], []
    final = np.zeros(len(states), bool)
    for s, (is_final, arcs, _) in enumerate(states):
        final[renumber(s)] = is_final
        before = int(is_final)
        for byte, target in sorted(arcs):
            keys.append(renumber(s) * 256 + byte)
            targets.append(renumber(target))
            numbers.append(before)
            before += states[target][2]
    order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
    arrays = {
        "keys": np.array(keys, np.int64)[order], "targets": np.array(targets, np.int64)[order], "numbers": np.array(numbers, np.int64)[order], "final": final,
        "offsets": np.concatenate(([0], np.cumsum([len(entries[w]) // 4 for w in words]))).astype(np.int64), "ids": np.frombuffer(b"".join(entries[w] for w in words), np.uint32),
    }
    for name, array in arrays.items():
        publish(os.path.join(folder, f"{name}.npy"), lambda f, a=array: np.save(f, a))


# ---------------------------------------------------------------- the vocabulary

#: Of Latin letters up to U+017F, without spaces and controls, all are composed, and lower case is settled: such a part needs no library.
PLAIN = regex.compile(r"[!-~\u00a1-\u017f]+\Z")
PLAIN_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


BYTE_OF = {c: b for b, c in enumerate(_byte_symbols())}


class Vocabulary:
    """A tokenizer file of the kind: BPE with word ends, byte-level symbols, lower case, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        tokens: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in tokens.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        self.names = [names.get(i, "").encode() for i in range(self.size)]
        library = Tokenizer.from_file(path)
        #: Only these two parts of the library are used, on words: its Unicode tables then are the same.
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = tokens
        alphabet = _byte_symbols()
        self.inner = [tokens.get(c, -1) for c in alphabet]
        self.final = [tokens.get(c + self.suffix, -1) for c in alphabet]
        merges = [(tokens[a], tokens[b], tokens[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*merges))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        # ranks of the pairs of first symbols, which all have small ids
        small = max(*self.inner, *self.final) + 1
        self.first_rank = np.full((small, small), len(merges), np.int64)
        self.first_rank[left[::-1][(left < small)[::-1] & (right < small)[::-1]], right[::-1][(left < small)[::-1] & (right < small)[::-1]]] = np.arange(len(merges))[::-1][(left < small)[::-1] & (right < small)[::-1]]
        self.made_by_rank = made
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        #: Marks that may follow plain words.
        self.marks = {c: np.uint32(self.final[ord(c)]).tobytes() for c in ".,;:!?"}
        # a table of bytes of tokens, each followed by a space, for decode()
        self.lengths = np.array([len(x) + 1 for x in self.names], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(x + b" " for x in self.names), np.uint8)

    def parts(self, chunk: str) -> list[bytes | int]:
        """The UTF-8 of each word of a chunk without spaces, or the id of a special token."""
        out: list[bytes | int] = []
        for k, part in enumerate(self.split.split(chunk) if self.split and "<" in chunk else [chunk]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                # the library gives each byte as a character
                out += [bytes(map(BYTE_OF.__getitem__, word)) for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)) if word]
        return out

    def parts_of_many(self, chunks: list[str]) -> list[list[bytes | int]]:
        """parts() of each chunk; all plain ones by one pass of the pattern, in which each chunk ends with a line feed."""
        out = [None if PLAIN.match(c) and "<|" not in c else self.parts(c) for c in chunks]
        plain = [c for c, p in zip(chunks, out) if p is None]
        words: list[bytes | int] = []
        rows = iter([k for k, p in enumerate(out) if p is None])
        for word in PLAIN_WORD.findall("\n".join([*plain, ""]).lower()) if plain else ():
            if word == "\n":
                out[next(rows)] = words
                words = []
            else:
                words.append(word.encode())
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge one word, the lowest rank first, the leftmost of equals first; a heap keeps it n log n for long words."""
        n = len(symbols)
        ids, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes], longest: int = 48) -> list[bytes]:
        """The ids (unsigned 32-bit) of many words. Each round makes one merge, the lowest in rank, then leftmost, in every word that has one left."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > longest).tolist():
            w = words[i]
            out[i] = np.array(self.merge([*(self.inner[c] for c in w[:-1]), self.final[w[-1]]]), np.uint32).tobytes()
        live = np.flatnonzero(sizes <= longest)
        if not len(live):
            return out
        lengths = sizes[live]
        data = np.frombuffer(b"".join([words[i] for i in live.tolist()]), np.uint8)
        ends = np.cumsum(lengths)
        ids = np.array(self.inner, np.int64)[data]
        ids[ends - 1] = np.array(self.final, np.int64)[data[ends - 1]]
        none = len(self.made_by_rank)
        # rank[i]: of the pair that begins at i
        rank = np.full(len(ids), none, np.int64)
        rank[:-1] = self.first_rank[ids[:-1], ids[1:]]
        rank[ends - 1] = none
        finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), starts)
            least, where = np.divmod(best, len(ids))
            go = least < none
            if not go.all():
                stuck = ~go
                finished.append((live[stuck], lengths[stuck], ids[np.repeat(stuck, lengths)]))
                keep = np.repeat(go, lengths)
                moved = np.cumsum(keep) - 1
                ids, rank, where, least = ids[keep], rank[keep], moved[where[go]], least[go]
                live, lengths = live[go], lengths[go]
                if not len(live):
                    break
                starts = np.cumsum(lengths) - lengths
            ids[where] = self.made_by_rank[least]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            last = where + 1 == starts + lengths - 1
            first = where == starts
            lengths = lengths - 1
            # the pairs to the right and left of the new symbol
            right, left = where[~last], where[~first]
            rank[where[last]] = none
            rank[right] = self._rank(ids[right], ids[right + 2])
            rank[left - 1] = self._rank(ids[left - 1], ids[left])
            ids, rank = ids[keep], rank[keep]
        at, counts, flat = (np.concatenate(x) for x in zip(*finished))
        flat = flat.astype(np.uint32).tobytes()
        stops = (4 * np.cumsum(counts)).tolist()
        begin = 0
        for i, stop in zip(at.tolist(), stops):
            out[i] = flat[begin:stop]
            begin = stop
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], len(self.pair_keys))

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids (unsigned 32-bit) of each chunk without spaces."""
        out: list[bytes | None] = [None] * len(chunks)
        simple, rest = [], []
        for i, chunk in enumerate(chunks):
            if found := letters_and_marks(chunk):
                simple.append((i, found[0].lower(), found[1]))
            else:
                rest.append(i)
        parts = self.parts_of_many([chunks[i] for i in rest])
        # plain words are kept as text, others as bytes
        words: list[str | bytes] = list({w for _, w, _ in simple})
        words += {w for p in parts for w in p if isinstance(w, bytes)}
        merged = dict(zip(words, self.merge_many([w.encode() if isinstance(w, str) else w for w in words])))
        for i, word, mark in simple:
            if not mark:
                out[i] = merged[word]
                continue
            tail = self.marks.get(mark)
            if tail is None:
                tail = self.merge_many([mark.encode()])[0]
                if len(self.marks) < 2_000 and len(mark) < 16:
                    self.marks[mark] = tail
            out[i] = merged[word] + tail
        for i, p in zip(rest, parts):
            out[i] = b"".join([np.uint32(w).tobytes() if isinstance(w, int) else merged[w] for w in p])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, joined by spaces: what a tokenizer file without a decoder gives."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        index = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.bytes[index].tobytes()[:-1]


# ---------------------------------------------------------------- tables


def split(text: str) -> list[str]:
    """Chunks between spaces and line feeds, which this kind of tokenizer drops; a chunk may be empty."""
    return text.replace("\n", " ").split(" ")


def _windows(text: str, most: int = 1 << 20):
    """The text in parts that end before a space, for texts too long to be split at once."""
    at = 0
    while at < len(text):
        to = len(text) if at + most >= len(text) else text.find(" ", at + most)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


class Encoder:
    """Encodes texts by a vocabulary and a transducer; keeps the ids of the words seen last, in about most_bytes and what one call of learn() adds."""

    #: Bytes of an entry of known besides the word and its ids.
    ENTRY = 200

    def __init__(self, path: str, folder: str | None, most_bytes: int = 32 << 20):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Transducer(folder) if folder else None
        self.most_bytes, self.held, self.known = most_bytes, 0, {}

    def learn(self, words: set[str]) -> None:
        """After this, all of the words are known."""
        if self.held > self.most_bytes:
            self.known.clear()
            self.held = 0
        missing = new = [w for w in words if w not in self.known]
        if self.lexicon and missing:
            ranks = self.lexicon.lookup([w.encode("utf-8", "surrogatepass") for w in missing])
            for w, r in zip(missing, ranks.tolist()):
                if r >= 0:
                    self.known[w] = self.lexicon.output(r)
            missing = [w for w, r in zip(missing, ranks.tolist()) if r < 0]
        for w, ids in zip(missing, self.vocabulary.encode_chunks(missing)):
            self.known[w] = ids
        self.held += sum(self.ENTRY + len(w) + len(self.known[w]) for w in new)

    def encode(self, text: str | None) -> np.ndarray:
        """The text's ids, as unsigned 32-bit integers."""
        out = []
        for window in _windows(text or ""):
            words = split(window)
            try:
                out.append(b"".join([self.known[w] for w in words]))
            except KeyError:
                self.learn(set(words))
                out.append(b"".join([self.known[w] for w in words]))
        return np.frombuffer(b"".join(out), np.uint32)


def build_lexicon(docs: DataFrame, path: str, folder: str, text: str = "text", words: int = 100_000, least: int = 8) -> int:
    """Compile the words that occur most: of those that occur `least` times or more in some partition of docs, the `words` with the greatest sums. Results don't depend on which they are. Returns how many."""

    def count(batches):
        seen = Counter()

        def out():
            some = [(w, n) for w, n in seen.items() if n >= least and len(w) <= 40]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                for t in piece.column("text").to_pylist():
                    for window in _windows(t or ""):
                        seen.update(split(window))
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()

    found = docs.select(F.col(text).alias("text")).mapInArrow(releasing(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    chosen = [r["word"] for r in found.select("word").collect()]
    entries = Vocabulary(path).encode_chunks(chosen)
    compile_transducer({w.encode(): ids for w, ids in zip(chosen, entries)}, folder)
    return len(chosen)


ENCODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, text: str = "text", ids: str | None = "ids", digests: bool = False) -> DataFrame:
    """All columns of docs and, for each row, its ids (array<int>, under the name given) and, if asked for, n_tokens, ids_sha256 and decoded_sha256.

    The ids are those of the tokenizers library with add_special_tokens=False, whatever columns
    docs has (one with a name used here is replaced); decoded is its decode() with
    skip_special_tokens=False. A null or empty text has no ids, and decodes to an empty text.
    Repeated rows give repeated rows, an empty table gives an empty one. path is a
    tokenizer file that every executor can read.

    White space is dropped by this kind of tokenizer and no token crosses a space, so words are
    encoded one by one. A text of any length is taken in windows of whole words.
    """
    folder = Scratch(docs.sparkSession, "lexicon").folder("automaton")
    build_lexicon(docs, path, folder, text)
    added = ([f"{ids} array<int>"] if ids else []) + (ENCODED.split(", ") if digests else [])
    kept = [c for c in docs.columns if c not in {x.split()[0] for x in added}]
    at = kept.index(text) if text in kept else None
    source = docs.select(*kept) if at is not None else docs.select(*kept, F.col(text).alias("__text"))
    name = text if at is not None else "__text"

    def run(batches):
        # ends with the task: a worker is used again by other tasks, which need the memory
        encoder = Encoder(path, folder)
        for batch in batches:
            for piece in pieces(batch, name, 1 << 20):
                yield one(encoder, piece)

    def one(encoder: Encoder, piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column(name).to_pylist()
        words: set[str] = set()
        for t in texts:
            if t and len(t) <= 1 << 20:
                words.update(split(t))
        encoder.learn(words)
        own = [encoder.encode(t) for t in texts]
        columns = [piece.column(c) for c in kept]
        if ids:
            flat = np.concatenate([*own, np.zeros(0, np.uint32)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))), pa.int32()), pa.array(flat)))
        if digests:
            columns.append(pa.array([len(x) for x in own], pa.int64()))
            columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()))
            columns.append(pa.array([hashlib.sha256(encoder.vocabulary.decode(x)).hexdigest() for x in own], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *(x.split()[0] for x in added)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept)
    return source.mapInArrow(releasing(run), ", ".join([fields, *added]))
