"""Each operator against brute force, an exact round trip or held-out accuracy, and on the edge cases."""

import cProfile
import collections
import hashlib
import math
import os
import random
import re
import shutil
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA, against_oracle, same
from pyspark.sql import functions as F

from brindle.llm import bpe, crf, decontaminate, divergence, huffman, license_scan, ngram_trie, queries, sharding, superminhash, url_rules
from brindle.llm.common import Scratch, local_path, words_of

from .conftest import prose, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# ---------------------------------------------------------------- 1


def test_licenses_against_sql(spark, duck):
    against_oracle(spark, duck, queries.license_digests, queries.ORACLE_SQL["op1_license_digests"])


def test_licenses(spark, edges, nothing):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    variant = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ,") + "\n"
    docs = table(spark, [(1, variant), (2, mit[:-20]), (3, "/* SPDX-License-Identifier: MIT */"), (4, "text\nLicenced under the Apache Licence, v2.0\n"), (5, "no license here"), (6, None), (6, None)])
    found = {r["doc_id"]: r for r in license_scan.scan(docs, ).collect()}
    assert found[1]["license"] == "MIT" and found[2]["license"] is None
    assert found[3]["license"] == "MIT" and found[3]["n_notices"] == 1
    assert found[5]["n_notices"] == 0 and found[6]["digest"] == hashlib.sha256(b"").hexdigest()
    out = license_scan.scan(edges)
    assert out.count() == edges.count() and license_scan.scan(nothing).count() == 0
    assert {r["doc_id"]: r["notices"] for r in out.collect()}[15] == "MIT"
    own = spark.createDataFrame([("Own", "My very own words.")], "license string, text string")
    assert rows_of(license_scan.scan(table(spark, [(1, "my VERY own words")]), own), "license") == [("Own",)]
    # notices are found whether the known licences are pairs or a table
    as_table = spark.createDataFrame(list(license_scan.KNOWN), "license string, text string")
    assert [rows_of(license_scan.scan(docs, k).orderBy("doc_id"), "license", "n_notices", "notices") for k in (as_table, tuple(license_scan.KNOWN))] == [rows_of(license_scan.scan(docs).orderBy("doc_id"), "license", "n_notices", "notices")] * 2
    with pytest.raises(ValueError, match="1,000"):
        license_scan.scan(docs, spark.createDataFrame([("x", f"license {i}") for i in range(1001)], "license string, text string"))


def test_notices_by_hand(spark):
    lines = [
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("licensed under cc/by-nc", "CC-BY-NC"), ("Licenced under CC-BY-NC-ND 3.0", "CC-BY-NC-ND-3.0"), ("# SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "CC-BY-NC-ND-3.0"), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("Licensed under CC BY-ND 2.0.", "CC-BY-ND-2.0"),
    ]
    docs = table(spark, [(i, f"Some prose.\n{x}\nMore prose.") for i, (x, _) in enumerate(lines)])
    assert {r["doc_id"]: (r["n_notices"], r["notices"]) for r in license_scan.scan(docs).collect()} == {i: (1, k) for i, (_, k) in enumerate(lines)}


def test_wrapped_licenses(spark):
    import textwrap

    whole = [(k, x) for k, x in license_scan.KNOWN if "\n" in x and "http://www" not in x]
    docs, wanted = [], {}
    for k, x in whole:
        for width in (20, 33, 40, 52, 60, 65, 70, 72, 76, 79, 80, 100):
            lines = [line for p in x.split("\n\n") for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
            wanted[len(docs)] = k
            docs.append((len(docs), "\n".join(["Copyright (c) 2001, 2020 Holder Notices Inc.", "Copyright Someone Else", *lines])))
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(table(spark, docs)).collect()}
    assert got == wanted
    gone = ["Copyright 2020 X", "copyright (C) Someone", "Copyright Someone", "Copyright by X", "(c) 2020 X", "(C) Someone", "\u00a9 X", " * Copyright: 2020", "Copyright Noticed Ltd", "Copyright \u00c9lodie", "Copyright Ho"]
    stays = ["copyright notice and", "COPYRIGHT HOLDERS BE", "copyright holder", "copyright law.", "copyright", "copyright, patent", "copyrighted works", "(c) You must retain"]
    out = spark.createDataFrame([(i, f"a\n{x}\nb") for i, x in enumerate(gone + stays)], "i int, x string").select("i", license_scan.canonical(F.col("x")).alias("c"))
    assert [i for i, c in sorted(rows_of(out, "i", "c")) if c == "a b"] == list(range(len(gone)))


def test_long_licenses(spark):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files):
        pytest.skip(f"no licence texts in {folder}")
    texts = [open(f"{folder}/{f}", encoding="utf-8").read() for f in files]
    got = dict(rows_of(license_scan.scan(table(spark, list(enumerate(texts)))), "doc_id", "license"))
    assert [got[i] for i in range(len(texts))] == list(files.values())


# ---------------------------------------------------------------- 2


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1), (1, 1), (1, 10**9), (5, 5), (1000, 10**6), (100_000, 300_000), (5000, 2**45)):
        v = np.unique(rng.integers(0, most, n)) if n else np.zeros(0, np.int64)
        e = ngram_trie.EliasFano.of(v)
        assert (e.access(np.arange(len(v))) == v).all()
        if len(v):
            x = rng.integers(0, most + 5, 3000)
            assert (e.find(v) == np.arange(len(v))).all() and ((e.find(x) >= 0) == np.isin(x, v)).all()
    v = np.sort(rng.integers(0, 50, 1000))
    assert (ngram_trie.EliasFano.of(v).access(np.arange(1000)) == v).all()


def test_scores_against_brute_force(spark):
    docs = [(i, prose(i // 2, 60 + i)) for i in range(80)] + [(90, None), (91, ""), (92, "The the THE")]
    got = ngram_trie.score(table(spark, docs)).collect()
    tokens = {i: words(t) + ["</s>"] for i, t in docs}
    c1, c2, c3, n_train, d = collections.Counter(), collections.Counter(), collections.Counter(), 0, ngram_trie.DISCOUNT
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            n_train += 1
            c1.update(t)
            p = ["<0>", "<1>", *t]
            c2.update(zip(p, p[1:]))
            c3.update(zip(p, p[1:], p[2:]))
    n, v = sum(c1.values()), len(c1)
    f1 = collections.Counter(a for a, _ in c2)
    f2 = collections.Counter((a, b) for a, b, _ in c3)
    c1["<1>"] = n_train

    def p3(a, b, c):
        p = max(c1[c] - d, 0) / n + d * v / n / (v + 1)
        if c1[b]:
            p = max(c2[b, c] - d, 0) / c1[b] + d * f1[b] / c1[b] * p
        if c2[a, b]:
            p = max(c3[a, b, c] - d, 0) / c2[a, b] + d * f2[a, b] / c2[a, b] * p
        return p

    held, base_held = 0.0, 0.0
    by_doc = {i: collections.Counter(zip(["<0>", "<1>", *t], ["<1>", *t], t)) for i, t in tokens.items()}
    for r in got:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in t)
        p = ["<0>", "<1>", *t]
        mine = sum(math.log10(p3(*x)) for x in zip(p, p[1:], p[2:]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c1[x] > 0 for x in t), n)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - mine) < 3e-4 * len(t)
        own = {} if r["held_out"] else by_doc[r["doc_id"]]
        seen = sum(c3[x] - own.get(x, 0) > 0 for x in zip(p, p[1:], p[2:])) / len(t)
        assert abs(r["seen_share"] - seen) < 1e-9 and abs(r["gain"] - (r["score"] - r["base_score"]) / len(t)) < 1e-9
        if r["held_out"]:
            held, base_held = held + mine, base_held + base
    assert held > base_held
    # all words and the unknown one: probabilities after a context add up to 1
    for context in (("<0>", "<1>"), ("the", "of"), (tokens[0][3], tokens[0][4])):
        assert abs(sum(p3(*context, w) for w in [*(x for x in c1 if x != "<1>"), "?"]) - 1) < 1e-9


def test_scores_with_blocks_added_up(spark, monkeypatch):
    docs = table(spark, [(i, prose(i // 3, 40)) for i in range(60)]).repartition(9, "doc_id").cache()
    plain = rows_of(ngram_trie.score(docs).orderBy("doc_id"), *(x.split()[0] for x in ngram_trie.SCORES.split(", ")))
    monkeypatch.setattr(ngram_trie, "FAN_IN", 2)
    assert rows_of(ngram_trie.score(docs).orderBy("doc_id"), *(x.split()[0] for x in ngram_trie.SCORES.split(", "))) == plain
    # a text is three rows': one whose training rows hold another of them is seen as a whole
    trained = collections.Counter(i // 3 for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2)
    for x in plain:
        copies = trained[x[0] // 3] - (not x[1])
        assert x[-1] == 1 if copies else x[-1] < 1


def test_scoring_does_not_grow_with_shards(spark, monkeypatch):
    docs = [(i, prose(i // 2, 60 + i)) for i in range(80)] + [(90, None), (91, ""), (92, "The the THE"), (93, "never seen " * 3)]
    trained = table(spark, docs).where("doc_id < 92")
    texts, held = pa.array([t for _, t in docs]), np.array([i > 91 for i, _ in docs])
    few, many = (ngram_trie.train(trained, Scratch(spark, "ngrams"), bytes_in_shard=n) for n in (1 << 20, 40))
    assert few.shards == 4 and many.shards > 600 and (few.words, few.tokens) == (many.words, many.tokens)
    calls, found = [], []
    for sizes in (few, many):
        scorer = ngram_trie.Scorer(sizes)
        scorer.score(texts, held)
        # all files stay mapped, and a piece's questions are answered together whatever their shards
        with monkeypatch.context() as m:
            m.setattr(ngram_trie, "open", None, raising=False)
            profile = cProfile.Profile()
            found.append(profile.runcall(scorer.score, texts, held))
        calls.append(sum(x.callcount for x in profile.getstats()))
    assert calls[1] < 2 * calls[0], calls
    # groups and blocks of questions change nothing; nor do those that are closed again
    for name, n in (("GROUP", 64), ("MAPPED", 2), ("BLOCK", 50)):
        monkeypatch.setattr(ngram_trie, name, n)
    monkeypatch.setattr(ngram_trie, "_opened", {})
    found.append(ngram_trie.Scorer(many).score(texts, held))
    for k, wanted in found[0].items():
        assert all(np.allclose(wanted, x[k], rtol=0, atol=1e-12) for x in found[1:]), k


def test_coded_blocks():
    rng = np.random.default_rng(0)
    for x, width in ((np.zeros(0, np.int64), 3), (rng.integers(0, 1 << 24, 5000), 3), (rng.integers(0, 1 << 62, 100), 8), (np.arange(7, dtype=np.uint32), 4)):
        assert (ngram_trie._decoded(pa.py_buffer(ngram_trie._coded(x, width)), width) == x).all()
    x = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (np.cumsum(ngram_trie._decoded(pa.py_buffer(ngram_trie._coded(ngram_trie._differences(x), 8)), 8).view(np.uint64)) == x).all()


def test_scores_edges(spark, edges, nothing):
    out = ngram_trie.score(edges).collect()
    assert len(out) == edges.count() and all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in out)
    assert ngram_trie.score(nothing).count() == 0
    # no training rows at all
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ngram_trie.score(table(spark, [(only_held, "a b")])).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


# ---------------------------------------------------------------- 3


def test_templates(spark):
    bench = spark.createDataFrame([(1, "If Anna has 12 apples and gives 5 apples to Peter after walking 3 km how many apples does Anna have left"), (2, "short one"), (3, None), (4, "")], "item_id bigint, text string")
    base = "Well then. If {0} has 40 apples and gives {3} apples to {1} after walking 9 km how many apples does {2} have left ok"
    docs = table(spark, [(1, base.format("Maria", "Karl", "Maria", 7)), (2, base.format("Maria", "Karl", "Susan", 7)), (3, None), (4, ""), (5, prose(1)), (6, bench.first()["text"]), (6, bench.first()["text"]), (None, base.format("Maria", "Karl", "Maria", 40))])
    got = [(r["doc_id"], r["contaminated"], r["item_ids"], r["reparameterised"]) for r in decontaminate.report(docs, bench).collect()]
    same(got, [(1, True, [1], True), (2, False, [], False), (3, False, [], False), (4, False, [], False), (5, False, [], False), (6, True, [1], False), (6, True, [1], False), (None, True, [1], True)])
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns


def _brute_words(text, form):
    """Template words and slot values of a text, word by word: 0 plain, 1 with names too."""
    import regex

    out = []
    text = re.sub(r"[.,:/-](?=\D|$)", " \\g<0>", text or "")
    before_number = False
    for raw in text.split():
        core = regex.sub(r"[^\p{L}\p{N}]+", "", raw)
        if not core:
            continue
        low = core.lower()
        if core.isdigit():
            out.append(("#", low, True))
        elif before_number and low in decontaminate.UNITS.split("|"):
            out.append(("u", low, True))
        elif form == 1 and regex.fullmatch(r"\p{Lu}\p{Ll}+", core) and low not in decontaminate.FUNCTION_WORDS:
            out.append(("n", low, True))
        else:
            out.append((low, low, False))
        before_number = core.isdigit()
    return out


def _brute_leaks(items, text):
    """What report() says of a text, by comparing each window of each item with each window of the text."""
    found, changed_any = [], False
    for i, item in items:
        for form in (0, 1):
            mine, theirs = _brute_words(text, form), _brute_words(item, form)
            size = min(8, len(theirs))
            if size < 5:
                continue
            wins = [(at, tuple(x[0] for x in theirs[at : at + size])) for at in range(len(theirs) - size + 1) if sum(not x[2] for x in theirs[at : at + size]) >= 5]
            total = len({w for _, w in wins})
            hits = [(at, k, w) for at, w in wins for k in range(len(mine) - size + 1) if tuple(x[0] for x in mine[k : k + size]) == w]
            if not total or len({w for *_, w in hits}) < 0.5 * total:
                continue
            slots = collections.defaultdict(lambda: collections.defaultdict(set))
            for at, k, _ in hits:
                for j in range(size):
                    if theirs[at + j][2]:
                        slots[k - at][theirs[at + j][1]].add(mine[k + j][1])
            good = [(at, k, w) for at, k, w in hits if all(len(v) == 1 for v in slots[k - at].values())]
            if len({w for *_, w in good}) >= 0.5 * total:
                found.append(i)
                changed_any |= any(v != {x} for at, k, _ in good for x, v in slots[k - at].items())
    return sorted(set(found)), changed_any


def test_templates_against_brute_force(spark):
    r = random.Random(11)
    names, verbs = ["Anna", "Karl", "Maria", "Tom", "Lena", "Bob"], "has buys sells counts carries paints finds".split()
    nouns = "red apples,old books,small boxes,green pens,heavy bags of flour".split(",")

    def sentence():
        a, b = r.choice(names), r.choice(names)
        return f"{a} {r.choice(verbs)} {r.randint(2, 40)} {r.choice(nouns)} and {r.choice(verbs)} {r.randint(2, 9)} km later {r.choice(['with', 'for'])} {b} ."

    def change(text):
        for old in names:
            if r.random() < 0.3:
                text = text.replace(old, r.choice(names))
        if r.random() < 0.3:
            text = re.sub(r"[0-9]+", lambda m: str(r.randint(2, 40)), text)
        if r.random() < 0.2:
            text = r.choice([text.lower(), text.upper(), text.title()])
        w = text.split()
        for _ in range(r.choice([0, 0, 1, 4])):
            w[r.randrange(len(w))] = r.choice(["new", "Karl", "7", "km"])
        return " ".join(w)

    items = [(i, " ".join(sentence() for _ in range(r.randint(1, 3)))) for i in range(25)]
    # a beginning that many items share
    items += [(100 + i, f"Read the text and then choose the right answer of all below . {sentence()}") for i in range(20)]
    docs = [(k, " ".join([sentence(), change(r.choice(items)[1]), r.choice(["", "then ok", "Well ."])])) for k in range(250)] + [(900, "Read the text and then choose the right answer of all below .")]
    got = {r["doc_id"]: (r["item_ids"], r["reparameterised"]) for r in decontaminate.report(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {k: _brute_leaks(items, t) for k, t in docs}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert 50 < sum(bool(f) for f, _ in want.values()) < 251 and any(c for _, c in want.values())


def test_case_does_not_hide_a_copy(spark):
    item = "If Anna asks Peter and Peter asks Maria then Maria and Anna call Karl before Karl meets Anna"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = table(spark, list(enumerate([item, item.lower(), item.upper(), item.title(), "so " + item.lower().replace("anna", "berta")])))
    assert [r["contaminated"] for r in decontaminate.report(docs, bench).orderBy("doc_id").collect()] == [True, True, True, True, False]


def test_columns_that_clash(spark):
    bench = spark.createDataFrame([(1, prose(1, 40))], "item_id bigint, text string")
    docs = table(spark, [(1, prose(1, 40)), (2, None), (None, prose(2)), (None, prose(1, 40))]).withColumn("__doc", F.lit(1)).withColumn("__hash", F.lit(2)).withColumn("doc", F.lit(3)).withColumn("item", F.lit(4))
    assert sorted((r["doc_id"] or 0) for r in decontaminate.drop_leaks(docs, bench).collect()) == [0, 2]
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns and decontaminate.report(docs, bench).where("contaminated").count() == 2


def test_items_with_few_literals(spark):
    items = ["What is 12 times 34?", "Is 1 + 2 = 3?", "Solve 7.", "12 13 14 15 16 17 18 19 20 21 22", "Wer kennt Karl Otto Meier Schmidt?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = table(spark, [(i, f"Some words before. {x.upper()} And after.") for i, x in enumerate(items)] + [(10, "What is 12 times 35?"), (11, "Is 1 - 2 = 3?"), (12, "12 13 14 15 16 17 18 19 20 21 23"), (13, "Solve 71."), (14, None), (15, "")])
    got = {r["doc_id"]: (r["item_ids"], r["reparameterised"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {i: ([i] if i < 5 else [], False) for i in [*range(5), *range(10, 16)]}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == list(range(10, 16))


def test_names_that_begin_sentences(spark):
    base = "{0} has 3 cats. {0} buys 5 dogs. {0} sells 2 birds. How many pets does {0} have now?"
    bench = spark.createDataFrame([(1, base.format("Tom")), (2, "Lena walked to the old red mill.\nLena carried four heavy bags of flour.")], "item_id bigint, text string")
    second = "{0} walked to the old red mill.\n{0} carried four heavy bags of flour."
    docs = table(spark, [(1, base.format("Ann")), (2, "Well. " + base.format("Tom")), (3, base.format("Ann").replace("Ann sells", "Bob sells")), (4, second.format("Karla")), (5, second.format("Lena")), (6, "He said: " + base.format("Ann").replace("3", "7"))])
    got = {r["doc_id"]: (r["item_ids"], r["reparameterised"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: ([1], True), 2: ([1], False), 3: ([], False), 4: ([2], True), 5: ([2], False), 6: ([1], True)}


def test_leaks_against_brute_force(spark):
    import duckdb

    d = f"{DATA}/sf0.01"
    items = duckdb.sql(f"SELECT item_id, text FROM '{d}/benchmark.parquet'").fetchall()
    index, sizes = collections.defaultdict(set), {}
    for i, t in items:
        w = t.lower().split()
        sizes[i] = len(w) - 4
        for k in range(len(w) - 4):
            index[tuple(w[k : k + 5])].add((i, k))
    wanted = {}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall():
        w, hit = t.lower().split(), collections.defaultdict(set)
        for k in range(len(w) - 4):
            for j, q in index.get(tuple(w[k : k + 5]), ()):
                hit[j].add(q)
        found = sorted(j for j, s in hit.items() if len(s) >= 0.5 * sizes[j])
        if found:
            wanted[i] = found
    got = {r["doc_id"]: r["item_ids"] for r in queries.template_windows(spark, d).where("contaminated").collect()}
    assert got == wanted and wanted


def test_leaks_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, prose(1, 40))], "item_id bigint, text string")
    assert decontaminate.report(edges, bench).count() == edges.count()
    assert decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.drop_leaks(nothing, bench).count() == 0


# ---------------------------------------------------------------- 4


def check_shards(out, shards):
    rows = out.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return rows, [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]


def test_shards_are_near_equal(spark):
    r = random.Random(1)
    docs = [(i, prose(i, r.choice([5, 50, 500]))) for i in range(600)] + [(1000 + i, prose(7, 100)) for i in range(300)]
    rows, sizes = check_shards(sharding.shard(table(spark, docs), 8, rows_in_piece=40), 8)
    longest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * longest + 2 * 0.02 * sum(sizes) / 8
    wanted = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == wanted
    # equal texts lie together: in runs of shards that no other boundary splits twice
    own = sorted({r["shard"] for r in rows if r["doc_id"] >= 1000})
    assert own == list(range(own[0], own[-1] + 1))


def test_equal_texts_share_a_shard(spark):
    r = random.Random(5)
    docs = [(i, prose(i // 3, 30 + i // 3 % 50)) for i in range(1500)] + [(5000 + i, "hot") for i in range(6000)] + [(20_000 + i, None) for i in range(2000)]
    r.shuffle(docs)
    rows, sizes = check_shards(sharding.shard(table(spark, docs), 10, rows_in_piece=500), 10)
    assert max(sizes) - min(sizes) <= 2 * 0.02 * sum(sizes) / 10 + 600
    text, by = dict(docs), collections.defaultdict(set)
    for x in rows:
        by[text[x["doc_id"]]].add(x["shard"])
    # but for the two texts that are more than a shard's share
    assert all(len(v) == 1 for k, v in by.items() if k not in ("hot", None)) and len(by["hot"]) > 1


def test_pieces_are_bounded_in_rows(spark):
    rows = sharding.keyed(table(spark, [(i, "same" if i % 2 else None) for i in range(4000)]))
    cuts, _ = sharding.splitters(rows.withColumn("size", F.lit(1)), 8, 0.05, 4000)
    counts = [r["count"] for r in rows.withColumn("piece", sharding._piece(cuts)).groupBy("piece").count().collect()]
    assert len(counts) == 8 and max(counts) <= 500 * 1.11


def test_shards_edges(spark, edges, nothing):
    rows, _ = check_shards(sharding.shard(edges, 4), 4)
    assert len(rows) == edges.count()
    assert all(r["size"] == 16 and r["text_crc32"] == 0 for r in rows if r["doc_id"] == 3)
    assert sharding.shard(nothing, 40).count() == 0
    # one row repeated: only its place in the input can split it
    rows, sizes = check_shards(sharding.shard(table(spark, [(1, "same")] * 400), 4), 4)
    assert max(sizes) - min(sizes) <= 2 * 20
    assert "__source" in sharding.shard(edges, 2, carry=("source",)).columns


# ---------------------------------------------------------------- 5


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))


def test_transducer(tmp_path):
    entries = {w.encode(): np.arange(k % 3 + 1, dtype=np.uint32).tobytes() for k, w in enumerate(["", "a", "ab", "abc", "bc", "xbc", "thing", "things", "ing", "é"])}
    bpe.compile_transducer(entries, str(tmp_path))
    t = bpe.Transducer(str(tmp_path))
    ranks = t.lookup([*entries, b"zz", b"thin", b"abcd"])
    assert (ranks[-3:] == -1).all() and sorted(ranks[:-3]) == list(range(len(entries)))
    assert all(t.output(r) == entries[w] for w, r in zip(entries, ranks))
    # suffixes are shared: fewer states than letters
    assert len(t.final) < sum(len(w) for w in entries)
    bpe.compile_transducer({}, str(tmp_path / "none"))
    assert (bpe.Transducer(str(tmp_path / "none")).lookup([b"a"]) == -1).all()


def test_encoding_is_the_librarys(word_bpe):
    r = random.Random(7)
    texts = ["", " ", None, "a" * 3000, "!!!???###%%%", "\U0001F600 x\u0000y", "it's <|startoftext|>y <|endoftext|> ſt İ ß Σς ㎏ ﬁ é ạ̀ <|end"]
    texts += ["".join(r.choice("abcde thingé ÉÀ'.,#1Ω\n\t\u3000ͅǅŉİ<|>") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    e = bpe.Encoder(queries.tokenizer("word_bpe_49k.json"), None)
    for t in texts:
        want = word_bpe.encode(t or "", add_special_tokens=False).ids
        got = e.encode(t)
        assert got.tolist() == want, t
        assert e.vocabulary.decode(got).decode() == word_bpe.decode(want, skip_special_tokens=False)


def test_encoders_hold_bounded_memory(word_bpe):
    e = bpe.Encoder(queries.tokenizer("word_bpe_49k.json"), None, most_bytes=20_000)
    for k in range(60):
        text = prose(k, 150)
        e.learn(set(bpe.split(text)))
        assert e.encode(text).tolist() == word_bpe.encode(text, add_special_tokens=False).ids
        assert e.held <= 20_000 + 151 * (e.ENTRY + 120) and e.held == sum(e.ENTRY + len(w) + len(i) for w, i in e.known.items())
    # nothing that grows stays in the module, so a worker that is used again begins empty
    assert not [k for k, v in vars(bpe).items() if isinstance(v, dict) and not k.startswith("__") and k != "BYTE_OF"]


def test_encoding_of_tables(spark, edges, nothing, word_bpe):
    path = queries.tokenizer("word_bpe_49k.json")
    out = bpe.encode(edges, path, digests=True)
    assert out.columns == [c for c in edges.columns if c != "ids"] + ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = collections.Counter(r["text"] for r in edges.collect())
    for r in out.collect():
        want = word_bpe.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word_bpe.decode(want, skip_special_tokens=False).encode()).hexdigest()
        texts[r["text"]] -= 1
    assert not any(texts.values()) and bpe.encode(nothing, path).count() == 0


# ---------------------------------------------------------------- 6


def test_fixed_rules(spark):
    urls = ["http://A.Example.COM/en/712?x", "https://foo.com/en/5", "foo.com/en/5", None, "http://b.net/de/", "http://example.net/de/81#x", "ftp://x.org/es/?q", "http://com/en/1", "http://notcom/en/1", "http://example.com/en/", "a://b://c/d", "http://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert got == {
        0: ("a.example.com", "/en/712", "example.com/en/7", "allow"), 1: ("foo.com", "/en/5", "com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b.net", "/de/", "net/de/", "block"), 5: ("example.net", "/de/81", "example.net/de/8", "block"),
        6: ("x.org", "/es/", "org/es/", "block"), 7: ("com", "/en/1", "com/en/", "block"), 8: ("notcom", "/en/1", None, "allow"), 9: ("example.com", "/en/", "com/en/", "block"), 10: ("b:", "//c/d", None, "allow"), 11: ("h", "", None, "allow"),
    }


def test_fixed_rules_are_those_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_rules.RULES) == contract
    pages = spark.createDataFrame([(i, "http://sub." + name) for i, name in enumerate(contract)], "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["rule"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()} == contract


def test_mined_rules_against_brute_force(spark):
    r = random.Random(3)
    urls, quality = [], []
    for i in range(600):
        host, path = r.choice(["spam", "blog", "m"]) + "." + r.choice(["a", "b"]) + ".org", r.choice(["x", "y", "pills"])
        urls.append(f"http://{host}/{path}/{r.randrange(900)}?{r.choice(['ref', 'id'])}=1")
        quality.append(0 if ("spam." in host and path == "pills") or r.random() < 0.05 else 1)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality) if i % 2] + [(None, 0, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    tokens = [r["t"] for r in pages.select(url_rules.tokens_of(pages["url"]).alias("t")).collect()]
    import itertools

    all_, bad = collections.Counter(), collections.Counter()
    for i in range(1, 600, 2):
        for n in range(1, len(tokens[i]) + 1):
            for s in itertools.combinations(tokens[i], n):
                all_[s] += 1
                bad[s] += quality[i] == 0
    n, base = 300, sum(quality[i] == 0 for i in range(1, 600, 2)) / 300
    enough = min(2 * base, 1 - (1 - base) / 2)
    rules = {s for s in all_ if bad[s] >= 10 and bad[s] / all_[s] >= enough and bad[s] - all_[s] * base >= 3 * math.sqrt(all_[s] * base * (1 - base))}
    want = {i for i, t in enumerate(tokens) if any(set(s) <= set(t) for s in rules)}
    got = {r["page_id"] for r in url_rules.judge(pages, labels, rules=(), min_support=10, min_sigmas=3).where("verdict = 'block'").collect()}
    assert got == want and want


def test_planted_rules_at_any_size(spark, duck):
    """A token that makes URLs bad blocks them, whatever the table's size and the share of bad ones elsewhere; tokens that say nothing don't. The SQL says the same."""
    for n, rate in ((2000, 0.05), (40_000, 0.3)):
        r = random.Random(n)
        rows = []
        for i in range(n):
            host = r.choice(["a", "b", "c", "d"])
            spam = r.random() < 0.02
            rows.append((i, f"http://{host}.org/{'pills' if spam else r.choice(['x', 'y', 'z'])}/{i}", int(r.random() > (0.9 if spam else rate)), 0))
        pages = spark.createDataFrame([x[:2] for x in rows], "page_id bigint, url string")
        labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id bigint, quality int, toxic int")
        got = url_rules.judge(pages, labels, rules=()).where("verdict = 'block'").collect()
        assert {x["page_id"] for x in got} == {i for i, u, *_ in rows if "/pills/" in u}
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("labels", labels.toArrow())
    want = con.execute(url_rules.oracle_sql()).fetchall()
    same(rows_of(url_rules.judge(pages, labels), "page_id", "host", "path", "rule", "verdict", "confidence"), want)
    assert sum(x[5] is not None for x in want) > 100


def test_toxic_is_bad_whatever_the_quality(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'fine'}.org/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels, rules=()).where("verdict = 'block'").collect()
    assert {x["page_id"] for x in got} == set(range(0, 400, 4))


def test_urls_edges(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0, 0)] * 3, "doc_id bigint, quality int, toxic int")
    assert url_rules.judge(none, labels).count() == 0
    pages = spark.createDataFrame([(1, "http://a/b", "z"), (1, "http://a/b", "z"), (None, "http://c", None), (2, "http://x/" + "y/" * 20_000, None)], "page_id bigint, url string, tokens string")
    assert url_rules.judge(pages, labels, min_support=1).count() == 4


# ---------------------------------------------------------------- 7


def brute_components(texts, n, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


def test_signatures_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    from brindle.llm.common import mix

    s = superminhash.signatures(np.concatenate((mix(a), mix(b), mix(a[:3]))), np.array([0, 1000, 2000, 2003]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12 and (s < superminhash.M).all()
    # blocks give what one run gives, and each draw of an element is another position
    again = superminhash.signatures(mix(a), np.array([0, 1000]), block=64)
    assert (again[0] == s[0]).all()
    one = superminhash.signatures(mix(a[:1]), np.array([0, 1]))
    assert sorted(np.floor(one[0]).astype(int)) == list(range(superminhash.M))


def near_table(seed=2):
    r = random.Random(seed)
    texts = []
    for k in range(25):
        base = words(prose(k, r.choice([3, 12, 60, 200])))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w).upper() if r.random() < 0.5 else "\n".join(w))
    # a chain: each is linked with the next alone
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[k * 15 : k * 15 + 200]) for k in range(8)]
    texts += [texts[0]] * 30 + ["", None, " ", "one", "one", "One two"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("n", [2, 5])
@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_against_brute_force(spark, n, block):
    texts = near_table()
    sets, roots = brute_components(texts, n)
    got = {r["doc_id"]: r for r in superminhash.near_duplicates(table(spark, list(enumerate(texts))), words=n, block=block).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), roots[i], roots[i] == i), (i, texts[i])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001)], "a bigint, b bigint").repartition(7)
    got = dict(rows_of(superminhash.components(edges, Scratch(spark, "test"), "path"), "node", "root"))
    assert got == {**{i: 0 for i in range(1, 501)}, 1001: 1000}


def test_near_duplicates_edges(spark, edges, nothing):
    out = superminhash.near_duplicates(edges, words=5).collect()
    assert len(out) == edges.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert all(r["component_id"] == 1 for r in by[1] + by[2])
    assert by[3][0]["n_shingles"] == 0 and by[3][0]["kept"] and by[9][0]["component_id"] == by[10][0]["component_id"] == 9
    assert superminhash.near_duplicates(nothing).count() == 0 and superminhash.keep_one(nothing).count() == 0
    kept = superminhash.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(6) == 1 and 7 not in ids and 3 in ids and 4 in ids and ids.count(None) == 2


def test_one_of_repeated_rows_stays(spark):
    docs = table(spark, [(1, prose(1))] * 5 + [(2, prose(1)), (3, None), (3, None), (4, prose(9))])
    assert sorted(r["doc_id"] for r in superminhash.keep_one(docs).collect()) == [1, 3, 4]


def test_no_process_for_each_file(tmp_path):
    # a process that the JVM starts has all its memory for a moment; Hadoop starts a chmod for each file that the JVM writes
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec {shutil.which("chmod")} "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from brindle.llm import superminhash
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
docs = spark.createDataFrame([(i, "some words that are there " * 3 + str(i // 2)) for i in range(20)], "doc_id bigint, text string")
assert superminhash.near_duplicates(docs).where("kept").count() == 10
docs.write.parquet("{tmp_path}/other")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"})
    started = (tmp_path / "started").read_text().splitlines()
    assert any("/other/" in x for x in started) and not [x for x in started if ".parquet" in x and "/shared/" in x]


def test_written_tables(spark):
    scratch = Scratch(spark, "test")
    df = spark.range(50_000).selectExpr("id", "if(id % 3 = 0, null, cast(id as string)) AS s", "if(id % 5 = 0, null, array(id, null)) AS a", "id % 2 = 0 AS b").repartition(7)
    got = scratch.written(df, "some", most=1 << 16)
    assert got.dtypes == df.dtypes
    assert got.exceptAll(df).count() == df.exceptAll(got).count() == 0
    assert scratch.written(df.limit(0), "none").count() == 0 and os.listdir(scratch.folder("none")) == []
    assert not os.path.exists(os.path.join(local_path(scratch.uri), "some-drafts"))
    # a damaged page is an error, not other rows
    path = os.path.join(scratch.folder("some"), os.listdir(scratch.folder("some"))[0])
    at = pq.ParquetFile(path).metadata.row_group(0).column(0)
    with open(path, "r+b") as f:
        f.seek((at.data_page_offset + at.dictionary_page_offset + at.total_compressed_size) // 2)
        byte = f.read(1)[0]
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte ^ 255]))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        got.select("id").collect()


# ---------------------------------------------------------------- 8


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300, 20_000):
        counts = (1e6 / np.arange(1, n + 1) ** 1.3).astype(int)
        counts[rng.integers(0, n, n // 3)] = 0
        counts[0] = 5
        lengths = huffman.code_lengths(counts)
        used = lengths > 0
        assert (used == (counts > 0)).all() and lengths.max() <= huffman.MOST_BITS and (2.0 ** -lengths[used].astype(float)).sum() <= 1
        code = huffman.Code(lengths)
        ids = rng.choice(np.flatnonzero(counts), 3000)
        for m in (0, 1, 255, 256, 257, 3000):
            data, marks = code.encode(ids[:m])
            assert (code.decode(data, marks, m) == ids[:m]).all()
    # without a limit that binds, the cost is Huffman's
    import heapq

    counts = rng.integers(1, 1000, 60)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((counts * huffman.code_lengths(counts)).sum()) == cost
    assert huffman.code_lengths(2 ** np.arange(20), 6).max() == 6


def test_token_files(spark, edges, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    manifest = huffman.write(edges, f"{tmp_path}/ids", path, end=2, ids_in_file=20_000)
    assert len(manifest["files"]) > 1
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in huffman.read(spark, f"{tmp_path}/ids", ids=True).collect())
    want = collections.Counter((r["doc_id"] if r["doc_id"] is not None else -1, tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in edges.collect())
    assert collections.Counter((g[0], tuple(g[4])) for g in got) == want
    start = 0
    for _, s, n, crc, ids in sorted(got, key=lambda g: g[1]):
        assert s == start and n == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids))
        start += n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted(g[0] for g in got)
    huffman.write(nothing, f"{tmp_path}/none", path)
    assert huffman.read(spark, f"{tmp_path}/none").count() == 0


def test_chunks_are_the_librarys():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t, w, r = Tokenizer.from_file(path), huffman.Words(path), random.Random(3)
    texts = ["a <|endoftext|> b  <|endoftext|>c  ", "  x", "x  ", "\n\n a \n b  c d  e", "", "İstanbul, ŉx.\nYes"] + ["".join(r.choice("ab c  \n\t'sé1. \u3000\x1c\x85É,;") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, w.encode(texts)):
        assert np.frombuffer(ids, w.type).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_known_chunks_cost_no_calls():
    words, r = huffman.Words(queries.tokenizer("byte_bpe_50k.json")), random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) + r.choice(["", ",", "\nx", " \t", "7"]) for _ in range(2000)) for _ in range(5)] + [None, "", " ", "a  b \n"]
    want = [np.array(words.library.encode(t or "", add_special_tokens=False).ids, words.type).tobytes() for t in texts]
    assert words.encode(texts) == want
    profile = cProfile.Profile()
    assert profile.runcall(words.encode, texts) == want
    profile.create_stats()
    # the texts have 10,000 different chunks
    assert sum(s[1] for s in profile.stats.values()) < 30 * len(texts) + 100


# ---------------------------------------------------------------- 9


@pytest.fixture(scope="module")
def model():
    return crf.default_model()


def test_likelihood_against_enumeration():
    import itertools

    rows = [("call 555-123-4567 now", [(5, 17, "phone")]), ("a", []), ("", []), ("key=0123456789abcdef0 x", [(4, 21, "secret")])]
    at, r = crf.likelihood(rows), np.random.default_rng(2)
    total, n = sum(crf.SIZES), len(crf.LABELS)
    x = r.normal(0, 0.5, (3 * total + n) * n)
    value, gradient = at(x)
    model, want = crf._model(x), 0.0
    for text, spans in rows:
        w = words_of(pa.array([text]), False)
        scores = model.emissions(crf.shapes(w.data, w.starts, w.ends), w.offsets).astype(float)
        if len(scores):
            of = lambda y: sum(s[k] for s, k in zip(scores, y)) + sum(model.moves[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: B023, E731
            gold = [next((crf.LABELS.index(k) for a, b, k in spans if s < b and e > a), 0) for s, e in zip(w.starts, w.ends)]
            want += of(gold) - math.log(sum(math.exp(of(y)) for y in itertools.product(range(n), repeat=len(scores))))
    assert abs(value - want) < 1e-4
    for k in [*r.integers(0, len(x), 20), *range(len(x) - n * n, len(x), 7), *np.argsort(-np.abs(gradient))[:20]]:
        step = np.zeros_like(x)
        step[k] = 1e-5
        assert abs((at(x + step)[0] - at(x - step)[0]) / 2e-5 - gradient[k]) < 1e-4
    assert not crf.train([("", [])]).weights.any()


def test_accuracy_on_written_sentences(model):
    """Sentences written by hand, in shapes that labelled_table() doesn't have; what is in brackets is a span."""
    sentences = [
        "Please charge my card {card:4111 1111 1111 1112} before Friday.", "Meine IBAN ist {iban:DE89 3704 0044 0532 0130 00}, danke.", "You can reach her on tel {phone:555-123-4567} until noon", "His SSN {ssn:123-45-6789} was printed on the form.", "Send it to {email:jo_smith+news@mail.server.co.uk} today",
        "export API_KEY={secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b}", "The box answers at {ip:192.168.10.77} only.", "Ring {phone:+44 20 7946 0958} and ask for Jo", "paid with {card:4539578763621486} last week", "The meeting of 2021-03-04 was moved to 2021-03-11.", "Chapter 12, pages 345-367, of the 1998 edition", "In 1990 1991 1992 1993 and 1994 the harvest failed.",
        "commit 2fd4e1c67a2d28fced849ee1bb76e7391b93eb12 fixed the build", "It cost $1,250.00 and weighed 12.5 kg in version 1.4.2", "password: {secret:Xk29fPq7Lm30vRt8Wz51aBc6}", "Telefon {phone:030 1234 5678} bitte", "Order 20394857 has 3 items, invoice 99812.", "See https://example.com/a/123 for the rules", "mobile {phone:(212) 555-0199} or the office", "FR76 is not an account by itself.",
    ]
    texts, gold = [], []
    for x in sentences:
        out, spans = "", set()
        for k, part in enumerate(re.split(r"\{(.*?)\}", x)):
            if k % 2:
                kind, _, value = part.partition(":")
                spans.add((len(out), crf.KINDS.index(kind), len(out) + len(value)))
                part = value
            out += part
        texts.append(out)
        gold.append(spans)
    found = [set(s) for _, s in crf.find_spans(pa.array(texts), model)]
    wrong = [(t, sorted(f ^ g)) for t, f, g in zip(texts, found, gold) if f != g]
    hit, n_found, n_gold = sum(len(f & g) for f, g in zip(found, gold)), sum(map(len, found)), sum(map(len, gold))
    assert hit / n_found >= 0.85 and hit / n_gold >= 0.85, wrong


def test_spans_take_linear_time(model):
    import time

    text = " ".join("é mail a.b@c.example.org card 4111 1111 1111 1112 tel 555-123-4567" for _ in range(5000))
    took = []
    for n in (4, 1):
        start = time.process_time()
        spans = crf.find_spans(pa.array([text[: len(text) // n]]), model)[0][1]
        took.append(time.process_time() - start)
    assert len(spans) == 15_000 and took[1] < 10 * took[0] + 0.5
    assert all(text[a:b] == {"email": "a.b@c.example.org", "card": "4111 1111 1111 1112", "phone": "555-123-4567"}[crf.KINDS[k]] for a, k, b in spans)


def plain_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and crf.luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.findall("[0-9]", m.group())) <= 15])


def test_base_spans_against_plain_patterns():
    r = random.Random(4)
    texts = ["".join(r.choice("ab@..012-+ ()%9") for _ in range(r.randint(0, 60))) for _ in range(8000)]
    texts += ["1.2.3.4.5.6.7.8", "1.2.3.4.5", "0001.2.3.4", "256.1.1.1.1.1.1", "4111111111111111", "4111 1111-1111 1111 and 1", "+1 (555) 123-4567."]
    for x in texts:
        assert crf.base_spans(x) == plain_spans(x), x


def test_held_out_accuracy(model):
    test = crf.labelled_table(300, seed=77)
    hit = extra = missed = 0
    for (_, spans), (_, found) in zip(test, crf.find_spans(pa.array([t for t, _ in test]), model)):
        gold = {(a, crf.KINDS.index(k), b) for a, b, k in spans}
        hit, extra, missed = hit + len(gold & set(found)), extra + len(set(found) - gold), missed + len(gold - set(found))
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_viterbi_is_exact(model):
    texts = [t for t, _ in crf.labelled_table(200, seed=9)] + ["", None, "x"]
    w = words_of(pa.array(texts), False)
    codes = crf.shapes(w.data, w.starts, w.ends)
    labels, scores = model.viterbi(codes, w.offsets), model.emissions(codes, w.offsets).astype(float)
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        if a < b:
            best, back = model.moves[0] + scores[a], []
            for t in range(a + 1, b):
                paths = best[:, None] + model.moves
                back.append(paths.argmax(0))
                best = paths.max(0) + scores[t]
            y = [int((best + model.moves[:, 0]).argmax())]
            for q in reversed(back):
                y.append(int(q[y[-1]]))
            assert y[::-1] == labels[a:b].tolist()


def test_personal_data(spark, edges, nothing, model):
    out = {r["doc_id"]: r for r in crf.detect(edges, model).collect()}
    r = out[13]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and "secret:9:49" in r["spans"]
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{crf.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans({x["doc_id"]: x["text"] for x in edges.collect()}[13])).encode()).hexdigest()
    assert out[1]["spans"] == "" and out[3]["spans"] == "" and len(out) == len({x["doc_id"] for x in edges.collect()})
    masked = crf.mask(edges, model)
    assert masked.columns == edges.columns and masked.count() == edges.count()
    m = {r["doc_id"]: r for r in masked.collect()}
    assert m[13]["text"] == 'token = "[secret]" mail [email] card [card] at [ip] [phone].' and m[13]["n_chars"] == len(m[13]["text"])
    assert m[3]["text"] is None and m[9]["text"] == {r["doc_id"]: r["text"] for r in edges.collect()}[9]
    assert crf.detect(nothing, model).count() == 0 and crf.mask(nothing, model).count() == 0


# ---------------------------------------------------------------- 10


def brute_base(x):
    x = x or ""
    w, seen, dup = words(x, lower=False), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(cover)


def test_base_counts_against_brute_force(spark):
    r = random.Random(6)
    texts = ["", None, "\n\n", "a", "a\n", "a\na", "\na\na\n", "é é", " x\n x\nx", "w " * 30, "a\n\na", "b"] + ["".join(r.choice("ab #|\n\né") for _ in range(r.randint(0, 300))) for _ in range(1500)]
    got = divergence.base_counts(pa.array(texts))
    for i, x in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_base(x), x


def test_divergence(spark, edges, nothing):
    p, q = np.array([[1, 3], [4, 0]]), np.array([0.25, 0.75])

    def js(a, b):
        a = a / a.sum()
        m = (a + b) / 2
        kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m) if x)
        return math.sqrt((kl(a) + kl(b)) / 2)

    assert np.allclose(divergence.js_distance(p, q), [js(p[0], q), js(p[1], q)])
    good = [(i, prose(i, 150)) for i in range(60)]
    junk = [(100, "#$% &*| " * 60 + prose(3, 30)), (101, "1234 " * 100), (102, "#$%"), (103, prose(1, 150), None), (104, prose(1, 150), "zz")]
    out = {r["doc_id"]: r for r in divergence.measure(table(spark, good + junk)).collect()}
    assert all(out[i]["kept"] for i in range(60)) and not out[100]["kept"] and not out[101]["kept"]
    assert out[102]["class_distance"] is None and not out[102]["kept"]
    assert out[103]["kept"] and out[103]["class_distance"] is None and out[104]["kept"]
    kept = divergence.keep_good(table(spark, good + junk))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in out.items() if r["kept"])
    assert divergence.measure(edges).count() == edges.count() and divergence.measure(nothing).count() == 0
    assert divergence.keep_good(nothing).count() == 0 and divergence.keep_good(edges).columns == edges.columns


def test_junk_without_common_words_goes(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    common = {k: divergence.COMMON[k][:12] for k in divergence.COMMON}
    docs, junk, k = [], set(), 0
    for lang, own in common.items():
        for _ in range(60):
            docs.append((k, " ".join(r.choice(own) if r.random() < 0.23 else word() for _ in range(150)) + ".", lang))
            k += 1
        for text in (" ".join(word() for _ in range(120)), " | ".join(word() for _ in range(120)), "\n".join(word().title() + "," for _ in range(120)), " | ".join(r.choice(own) if r.random() < 0.15 else word() for _ in range(120))):
            docs.append((k, text, lang))
            junk.add(k)
            k += 1
    docs.append((k, " ".join(r.choice(common["en"]) if r.random() < 0.45 else word() for _ in range(150)), "en"))
    kept = {r["doc_id"] for r in divergence.measure(table(spark, docs)).where("kept").collect()}
    assert kept == set(range(k + 1)) - junk
    assert {r["doc_id"] for r in divergence.keep_good(table(spark, docs)).collect()} == kept


def test_base_verdict_at_scale(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in queries.distribution_divergence(spark, f"{DATA}/sf0.001").collect():
        n, *_, repeat = brute_base(docs[r["doc_id"]])
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scratch = Scratch(spark, "test-pipeline")
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        before = docs
        docs = scratch.table(stage(spark, docs, d), str(k))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "near-duplicates":
            ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
            _, roots = brute_components([r["text"] for r in before.orderBy("doc_id").collect()], 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({ids[x] for x in roots})
        if name == "personal data":
            assert docs.count() == before.count() and not any(plain_spans(r["text"] or "") for r in docs.collect() if not re.search(r"\d \[|\] ?\d", r["text"]))
    assert before.count() < spark.read.parquet(f"{d}/documents.parquet").count()
    out = p.run(spark, d)
    assert out.count() == docs.count() and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
