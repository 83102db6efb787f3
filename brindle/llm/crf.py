"""Personal data: fixed patterns, and spans that a linear-chain conditional random field over word shapes adds."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, releasing, span_hash, words_of

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = KINDS[:4]
LABELS = ("O", *KINDS)
#: Labels whose neighbouring words make one span, with the least and most digits (of an IBAN: letters and digits) of a span; of the others each word is a span.
JOINED = {"card": (12, 19), "phone": (7, 15), "iban": (15, 34)}

# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried once, from its first digit: what follows a run is the same for all its ends.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- word shapes

TRIGGERS = "token key secret password passwd pwd apikey api_key auth bearer access phone tel telephone mobile cell fax call contact card visa credit account iban number no ip host server address addr email mail e-mail = : commit sha revision hash version build id order isbn ssn social security iban konto teléfono téléphone telefon handy date on born total invoice".split()
_TRIGGER = np.sort(words_of(pa.array(TRIGGERS), True).hashes)

_KIND = np.full(256, 7, np.uint8)  # beyond ASCII
_KIND[:128] = 6  # other marks
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
for _c in ".,;:!?":
    _KIND[ord(_c)] = 3
_KIND[ord("+")] = 4
for _c in "()\"'[]{}<>":
    _KIND[ord(_c)] = 5
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
#: Numbers of values of each feature, in the order of shapes().
SIZES = (10, 5, 2, 5, 8, 8, 2, 5, 3, len(TRIGGERS) + 1, 4)
_LENGTHS = np.array([2, 3, 4, 7, 12, 13, 20, 32, 65])


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word that says all its features: a mixed-radix number over SIZES."""

    def count(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(marks, out=sums[1:])
        return sums[ends] - sums[starts]

    kind = _KIND[data]
    length = ends - starts
    digits, lower, upper = count(kind == 2), count(kind == 0), count(kind == 1)
    wordy = count(_WORDY[data])
    share = np.where(digits == 0, 0, np.where(digits == wordy, np.where(wordy >= 13, 4, 3), np.where(2 * digits < wordy, 1, 2)))
    hexlike = (count(_HEX[data]) == wordy) & (wordy >= 24) & (digits > 0) & (digits < wordy)
    mixed = np.where((digits > 0) & (lower > 0) & (upper > 0), 4, np.where((digits > 0) & (lower + upper > 0), 3, np.where((lower > 0) & (upper > 0), 2, np.where(upper > 0, 1, 0))))
    # the word without marks at its ends, lower-cased, among the triggers
    small = np.where(kind == 1, data + 32, data).astype(np.uint8)
    core_end = np.where((length > 1) & (kind[np.maximum(ends, 1) - 1] == 3), ends - 1, ends)
    known = np.full(len(starts), len(_TRIGGER))
    short = np.flatnonzero(length <= 10)
    hashed = span_hash(small, starts[short], core_end[short])
    at = np.minimum(np.searchsorted(_TRIGGER, hashed), len(_TRIGGER) - 1)
    known[short] = np.where(_TRIGGER[at] == hashed, at, len(_TRIGGER))
    features = (
        np.searchsorted(_LENGTHS, length, "right"), share, count(data == 64) > 0, np.minimum(count(data == 46), 4), kind[starts], kind[ends - 1], hexlike, mixed, np.minimum(count(data == 45), 2), known,
        np.searchsorted([1, 7, 12], digits, "right"),
    )
    code = np.zeros(len(starts), np.int64)
    for value, size in zip(features, SIZES):
        code = code * size + value.astype(np.int64)
    return code


def features_of(codes: np.ndarray) -> np.ndarray:
    """The columns of the weights that belong to each code, one for each feature."""
    out = np.zeros((len(codes), len(SIZES)), np.int64)
    offsets = np.concatenate(([0], np.cumsum(SIZES)[:-1]))
    for k in range(len(SIZES) - 1, -1, -1):
        out[:, k] = codes % SIZES[k] + offsets[k]
        codes = codes // SIZES[k]
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """weights: (before, own, after) x feature value x label; moves: label x label. Text ends count as a neighbour labelled O with no features."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of each label for each word; words of one text are codes[offsets[i]:offsets[i + 1]]."""
        if not len(codes):
            return np.zeros((0, len(LABELS)))
        values, inverse = np.unique(codes, return_inverse=True)
        before, own, after = (w[features_of(values)].sum(1).astype(np.float32) for w in self.weights)
        out = own[inverse]
        first = np.zeros(len(codes) + 1, bool)
        first[offsets] = True
        out[1:] += np.where(first[1:-1, None], 0, before[inverse[:-1]])
        out[:-1] += np.where(first[1:-1, None], 0, after[inverse[1:]])
        return out

    def viterbi(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label of each word, all texts at once.

        A word whose score for O leads by more than any two moves can differ is O on every best
        path, so only the stretches between such words are searched, and the result is the same.
        """
        score = self.emissions(codes, offsets)
        out = np.zeros(len(codes), np.int64)
        if not len(codes):
            return out
        open_ = score[:, 0] - score[:, 1:].max(1) <= 2 * (self.moves.max() - self.moves.min()) + 1e-3
        first = np.zeros(len(codes) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([False], open_[:-1]))
        after = np.concatenate((open_[1:], [False]))
        starts = np.flatnonzero(open_ & (~before | first[:-1]))
        ends = np.flatnonzero(open_ & (~after | first[1:])) + 1
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        if not len(starts):
            return out
        best = self.moves[0] + score[starts]
        back = []
        for t in range(1, int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, "left"))
            paths = best[:n, :, None] + self.moves[None]
            back.append(paths.argmax(1).astype(np.int8))
            best[:n] = paths.max(1) + score[starts[:n] + t]
        label = (best + self.moves[:, 0]).argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, "left"))
            out[starts[:n] + t] = label[:n]
            if t:
                label[:n] = back[t - 1][np.arange(n), label[:n]]
        return out


def _model(x: np.ndarray) -> Model:
    n, total = len(LABELS), sum(SIZES)
    return Model(x[: 3 * total * n].reshape(3, total, n), x[3 * total * n :].reshape(n, n))


def likelihood(rows: list[tuple[str, list[tuple[int, int, str]]]]):
    """A function from all weights to the log likelihood of the rows' labels and its gradient, by forward-backward, all texts in one batch."""
    w = words_of(pa.array([t for t, _ in rows], pa.string()), False)
    gold = np.zeros(len(w.starts), np.int64)
    for i, (text, spans) in enumerate(rows):
        for a, b, kind in spans:
            a, b = (w.rows[i] + len(text[:x].encode()) for x in (a, b))
            gold[(w.starts < b) & (w.ends > a)] = LABELS.index(kind)
    codes = shapes(w.data, w.starts, w.ends)
    n, n_labels, total = len(rows), len(LABELS), sum(SIZES)
    own = np.diff(w.offsets)
    row = np.repeat(np.arange(n), own)
    place = np.arange(len(codes)) - w.offsets[row]
    # the longest texts first: at each place, those that have a word there are the first ones
    order = np.argsort(-own, kind="stable")
    line = np.argsort(order)[row]
    lengths = own[order]
    last_of = own[row] - 1
    longest = int(lengths.max(initial=0))
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest + 1)]
    # words of one code share their features, so scores and gradients go through a small 0/1 matrix of codes by features
    values, inverse = np.unique(codes, return_inverse=True)
    has = np.zeros((len(values), total))
    np.put_along_axis(has, features_of(values), 1, 1)
    near = []
    for at, shift in ((np.flatnonzero(place > 0), -1), (np.arange(len(codes)), 0), (np.flatnonzero(place < last_of), 1)):
        own = inverse[at + shift]
        order = np.argsort(own, kind="stable")
        firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
        near.append((at, own, at[order], firsts, own[order][firsts]))

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        model = _model(x)
        weights, moves = model.weights, model.moves
        score = np.zeros((len(codes), n_labels))
        for k, (places, own, *_) in enumerate(near):
            score[places] += (has @ weights[k])[own]
        grid = np.zeros((longest, n, n_labels))
        grid[place, line] = score
        forward, backward = np.zeros_like(grid), np.zeros_like(grid)
        sums = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
        z = np.zeros(n)
        for t in range(longest):
            k = live[t]
            forward[t, :k] = (sums(forward[t - 1, :k, :, None] + moves[None], 1) if t else moves[0]) + grid[t, :k]
        for t in range(longest - 1, -1, -1):
            k, more = live[t], live[t + 1]
            z[more:k] = sums(forward[t, more:k] + moves[:, 0], 1)
            backward[t, more:k] = moves[:, 0]
            if more:
                backward[t, :more] = sums(moves[None] + (grid[t + 1, :more] + backward[t + 1, :more])[:, None, :], 2)
        wrong = np.exp(forward[place, line] + backward[place, line] - z[line][:, None])
        ends, begins = place == last_of, place == 0
        g_edge = wrong[begins].sum(0), wrong[ends].sum(0)
        wrong[np.arange(len(gold)), gold] -= 1
        g_weights, g_moves = np.zeros_like(weights), np.zeros_like(moves)
        for k, (_, _, order, firsts, which) in enumerate(near):
            if len(order):
                g_weights[k] = has[which].T @ np.add.reduceat(wrong[order], firsts)
        for t in range(1, longest):
            k = live[t]
            g_moves += np.exp(forward[t - 1, :k, :, None] + moves[None] + (grid[t, :k] + backward[t, :k])[:, None, :] - z[:k, None, None]).sum(0)
        g_moves[0] += g_edge[0]
        g_moves[:, 0] += g_edge[1]
        firsts, lasts = gold[begins], gold[ends]
        np.subtract.at(g_moves, (0, firsts), 1)
        np.subtract.at(g_moves, (lasts, 0), 1)
        inner = np.flatnonzero(place > 0)
        np.subtract.at(g_moves, (gold[inner - 1], gold[inner]), 1)
        path = score[np.arange(len(gold)), gold].sum() + moves[gold[inner - 1], gold[inner]].sum() + moves[0, firsts].sum() + moves[lasts, 0].sum()
        return float(path - z.sum()), -np.concatenate((g_weights.ravel(), g_moves.ravel()))

    return at


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 150, rate: float = 0.12, penalty: float = 2e-3) -> Model:
    """Maximise the penalised likelihood of (text, spans) by Adam. The table may have 20,000 rows; its words must be few enough for the driver. Rows without words teach nothing."""
    if len(rows) > 20_000:
        raise ValueError("at most 20,000 labelled rows")
    x = np.zeros((3 * sum(SIZES) + len(LABELS)) * len(LABELS))
    if not any(t.split() for t, _ in rows):
        return _model(x)
    at, m, v = likelihood(rows), np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        g = -at(x)[1] / len(rows) + penalty * x / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return _model(x)


@functools.cache
def default_model() -> Model:
    """Fitted on labelled_table(), once a process."""
    return train(labelled_table())


# ---------------------------------------------------------------- the labelled table


def labelled_table(rows: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table, made from templates with a fixed seed: (text, spans of code points)."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = "the an er on in re nd ou ea ti es or st en of it is ed ha to tion ble ing ly sch ung heit ge der que aux ment eau la os ción rr mente ó é ü".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ".", ",", "!", "?", ";"])
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    base = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    names = "Anna Maria Jean Peter Karl Lucia Tomas Elena Omar Mei Ravi Sofia Ivan Noor Paul Clara".split()
    surnames = "Smith Keller Dubois Garcia Novak Rossi Tanaka Okafor Jensen Moreau Lopez Weber Singh Brown".split()

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        return r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+49 {digits(3)} {digits(4)} {digits(3)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"])

    def email() -> str:
        return r.choice([f"{r.choice(names).lower()}.{digits(2)}@mail{digits(1)}.example.com", f"{r.choice(surnames).lower()}@example.org", f"{word().strip('.,!?;')}.{digits(2)}@mail{digits(1)}.example.com"])

    def card() -> str:
        return r.choice([digits(16), digits(16), digits(15), f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}"])

    def card_groups() -> str:
        return " ".join(digits(4) for _ in range(4)) if r.random() < 0.8 else f"{digits(4)} {digits(6)} {digits(5)}"

    def local_phone() -> str:
        return r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}/{digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"({digits(3)}) {digits(3)}-{digits(4)}", digits(10)])

    def iban() -> str:
        land, rest = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT"]), digits(r.choice([18, 20, 22]))
        bank = r.choice(["", "", "ABNA", "WEST", "BARC"])
        flat = land + digits(2) + bank + rest
        return flat if r.random() < 0.4 else " ".join(flat[k : k + 4] for k in range(0, len(flat), 4))

    def ssn() -> str:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    def secret() -> str:
        return r.choice([hexes(40), hexes(32), hexes(40).upper(), hexes(64), base(40), base(32)])

    pairs = [
        ("token = \"{}\"", "secret", secret), ("token={}", "secret", secret), ("api_key: {}", "secret", secret), ("password = {}", "secret", secret), ("secret \"{}\"", "secret", secret), ("Bearer {}", "secret", secret), ("{}", "card", card), ("card number {}", "card", card), ("{}", "email", email), ("mail {}", "email", email), ("{}", "ip", ip), ("server {}", "ip", ip), ("{}", "phone", phone), ("call {}", "phone", phone), ("Tel: {}", "phone", phone),
        ("card {}", "card", card_groups), ("visa: {}", "card", card_groups), ("tel {}", "phone", local_phone), ("Telefon: {}", "phone", local_phone), ("mobile {}", "phone", local_phone), ("phone number {}", "phone", local_phone), ("IBAN {}", "iban", iban), ("{}", "iban", iban), ("SSN {}", "ssn", ssn), ("social security number {}", "ssn", ssn), ("ssn: {}", "ssn", ssn),
    ]
    plain = [
        lambda: f"commit {hexes(40)}", lambda: f"sha {hexes(64)}", lambda: f"revision {hexes(32)}", lambda: f"in {r.randint(1700, 2030)}", lambda: f"{r.randint(1, 99)}.", lambda: f"{r.randint(1, 20)}.0.", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 999)},{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
        lambda: f"order {digits(8)}", lambda: f"= {digits(2)}", lambda: "@" + word(), lambda: f"https://example.com/{word()}/{digits(3)}", lambda: f"{word()}{r.choice(['###', '***', '$$$', '%%%', '&&&'])}", lambda: word().upper() + "!!", lambda: f"| {word()} |", lambda: word().capitalize(), lambda: f"({word()})", lambda: f"key {word()}", lambda: f"the name {word()}", lambda: f"{digits(6)}", lambda: f"id {digits(9)}", lambda: r.choice(names), lambda: r.choice(surnames),
        lambda: " ".join(digits(4) for _ in range(r.choice([1, 2, 3, 4, 5]))), lambda: f"in {digits(4)} and {digits(4)}", lambda: " ".join(digits(r.choice([1, 2, 3])) for _ in range(r.randint(2, 9))), lambda: f"on {digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"pages {digits(3)}-{digits(3)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"total {digits(3)}.{digits(2)}", lambda: f"call {word()}", lambda: f"phone {word()}", lambda: f"card {word()}", lambda: f"tel {word()}", lambda: word().upper(), lambda: r.choice(["DE", "FR", "GB", "ES"]),
    ]
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 7)):
                new = word()
                # sentences begin with a capital
                text += (new.capitalize() if text[-2:] in ("", ". ", "! ", "? ") or r.random() < 0.15 else new) + " "
            pick = r.random()
            if pick > 0.93:
                # symbols after every word
                for _ in range(r.randint(3, 8)):
                    new = word()
                    text += (new.capitalize() if r.random() < 0.2 else new) + r.choice(["###", "***", "$$$", "%%%", "&&&", "!!"]) + " "
                continue
            if pick < 0.5:
                frame, kind, make = r.choice(pairs)
                value = make()
                start = len(text) + frame.index("{}")
                spans.append((start, start + len(value), kind))
                text += frame.format(value) + r.choice(["", "", "", ".", ",", "###", "$$$", "!!", "%%%"]) + " "
            else:
                text += r.choice(plain)() + " "
        out.append((text.strip() + ("" if r.random() < 0.7 else " " + word()), spans))
    return out


# ---------------------------------------------------------------- spans


_digits = lambda w: sum(48 <= c <= 57 for c in w)
_alnum = lambda w: sum(chr(c).isalnum() for c in w if c < 128)
#: What a word must have whatever the model says.
NEEDS = {"email": lambda w: b"@" in w, "ip": lambda w: w.count(b".") >= 3 and _digits(w) >= 4, "card": lambda w: _digits(w) >= 4 and _digits(w) == _alnum(w) and b"+" not in w, "phone": lambda w: _digits(w) >= 1, "secret": lambda w: len(w) >= 16 and _digits(w) >= 1, "iban": lambda w: _alnum(w) >= 1, "ssn": lambda w: _digits(w) == 9}


def _trim(word: bytes, kind: str) -> tuple[int, int]:
    """The word without marks at its ends; nothing if it can't be of the kind at all."""
    a, b = 0, len(word)
    if not NEEDS[kind](word):
        return 0, 0
    opening = b"+(" if kind == "phone" else b""
    while a < b and not _WORDY[word[a]] and word[a] not in opening:
        a += 1
    while b > a and not _WORDY[word[b - 1]]:
        b -= 1
    if kind == "secret":
        # what names the secret, as in token=..., isn't part of it
        a = max(a, *(word.rfind(mark, a, b) + 1 for mark in (b"=", b":", b'"', b"'")))
    return a, b


def _added(w, labels: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, kind's number, end), in bytes of all texts, of the spans that labels say."""
    data, out, last = w.data, [], (-2, 0, -1)
    marked = np.flatnonzero(labels)
    size = 0
    for at, row in zip(marked.tolist(), (np.searchsorted(w.offsets, marked, "right") - 1).tolist()):
        label = int(labels[at])
        kind = LABELS[label]
        word = data[w.starts[at] : w.ends[at]].tobytes()
        a, b = _trim(word, kind)
        if a == b:
            continue
        start, end = int(w.starts[at]) + a, int(w.starts[at]) + b
        own = (_alnum if kind == "iban" else _digits)(word[a:b])
        if kind in JOINED and last == (at - 1, label, row) and size + own <= JOINED[kind][1]:
            out[-1] = (row, out[-1][1], label - 1, end)
            size += own
        else:
            if out and not _enough(data, out[-1], size):
                out.pop()
            out.append((row, start, label - 1, end))
            size = own
        last = (at, label, row)
    if out and not _enough(data, out[-1], size):
        out.pop()
    return out


_IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}")


def _enough(data: np.ndarray, span: tuple[int, int, int, int], size: int) -> bool:
    _, start, kind, _ = span
    low, high = JOINED.get(KINDS[kind], (0, size))
    return low <= size <= high and (KINDS[kind] != "iban" or _IBAN.match(data[start : start + 4].tobytes()) is not None)


def find_spans(column: pa.Array, model: Model) -> list[tuple[list, list]]:
    """For each text: the spans of the patterns, and those with the ones that the model adds where no pattern's span lies; (start, kind's number, end) in order. Time and memory grow as the texts and their spans."""
    w = words_of(column, False)
    added = _added(w, model.viterbi(shapes(w.data, w.starts, w.ends), w.offsets))
    if added:
        # code points before each byte
        before = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum((w.data & 0xC0) != 0x80, out=before[1:])
    by_row = {row: list(own) for row, own in itertools.groupby(added, key=lambda x: x[0])}
    out = []
    for row, text in enumerate(column.to_pylist()):
        base = base_spans(text or "")
        spans = base
        if row in by_row:
            first = int(before[w.rows[row]])
            starts = [x for x, _, _ in base]
            ends = list(itertools.accumulate((y for *_, y in base), max))
            more = []
            for _, start, kind, end in by_row[row]:
                a, b = int(before[start]) - first, int(before[end]) - first
                # of the patterns' spans that begin before b, does any end after a?
                k = bisect.bisect_left(starts, b)
                if not k or ends[k - 1] <= a:
                    more.append((a, kind, b))
            spans = sorted(base + more)
        out.append((base, spans))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, personal boolean"


def detect(docs: DataFrame, model: Model | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, counts of the patterns, base_sha256 of their spans, all spans, in code points, their number, and personal: whether there is any.

    spans has those of the patterns and of the model (fitted on labelled_table() if none is
    given), joined by commas. A null or empty text has none. Repeated rows give repeated rows,
    an empty table an empty one; other columns are not read. Whole texts are searched.
    """
    model = model or default_model()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                found = find_spans(piece.column("text"), model)
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
                digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([_joined(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([bool(s) for _, s in found], pa.bool_())], names=["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(releasing(run), f"doc_id bigint, {FOUND}")


def mask(docs: DataFrame, model: Model | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets, as [email]; overlapping spans by the first one's.

    length: a column that gets the new number of code points where the text changes (a null stays null); other columns
    don't change, whatever their names. A null or empty text stays as it is. Repeated rows stay
    repeated; an empty table gives an empty one.
    """
    model = model or default_model()
    names = docs.columns

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, 1 << 20):
                texts, out = piece.column(text).to_pylist(), []
                for t, (_, spans) in zip(texts, find_spans(piece.column(text), model)):
                    if t is None or not spans:
                        out.append(t)
                        continue
                    parts, at = [], 0
                    for a, k, b in spans:
                        if a >= at:
                            parts += [t[at:a], f"[{KINDS[k]}]"]
                            at = b
                        elif b > at:
                            at = b
                    out.append("".join([*parts, t[at:]]))
                columns = {n: piece.column(n) for n in names}
                columns[text] = pa.array(out, pa.string())
                if length in names:
                    old = piece.column(length)
                    columns[length] = pa.array([c if new is None or new == t else len(new) for c, t, new in zip(old.to_pylist(), texts, out)], old.type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(releasing(run), docs.schema)
