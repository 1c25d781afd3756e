"""Decontamination, fingerprints, quality, licences and the pipeline."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, fingerprints, licenses, quality, shingles
from recordloom.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def hits_by_force(text, items, width=10):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        b = words_of(t)
        n = min(width, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), sorted(hit), sorted(found)


def spark_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short Item, here"), (10, "Émile 日本 x9"), (3, None), (4, "..."), (5, "two three four five six seven eight nine ten eleven"), (1, "short item here")]
TEXTS = [
    (0, "Zero; ONE two, three\nfour five six seven eight nine ten! eleven twelve thirteen"), (1, "a short item  here and a short item here"), (2, "émile 日本 x9"), (3, "Émile-日本 x9."), (4, None), (5, ""),
    (6, "one two three four five six seven eight nine"), (7, "shortitem here"), (8, "short item hereafter"), (9, "x " * 4000 + "short item here " + "y " * 4000), (9, "x " * 4000 + "short item here " + "y " * 4000),
]


@pytest.mark.parametrize("block_chars, named", [(4_000_000, False), (60, False), (60, True)])
def test_hits_by_force(spark, docs, block_chars, named):
    """In one block and in many; item ids as numbers and as strings, a null one among them."""
    items = [(str(i) if i is not None else "", t) for i, t in [*ITEMS, (None, "hereafter")]]
    frame = spark.createDataFrame([(f"q-{i}" if i else None, t) for i, t in items], "item_id string, text string") if named else spark_items(spark, [*ITEMS, (None, "hereafter")])
    items = [(f"q-{i}" if i and named else i, t) for i, t in items]
    got = decontaminate.contaminated_spans(docs(TEXTS), frame, block_chars=block_chars)
    rows = got.select("doc_id", "text", "n_words", "hits", decontaminate.n_hit(F.col("hits")).alias("n"), decontaminate.items_of(F.col("hits")).alias("items")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n_words, hit, found = hits_by_force(r.text, items)
        assert (r.n_words, r.n, sorted(r["items"])) == (n_words, len(hit), found)
        covered = {k for h in r.hits for k in range(h.first, h.last + 1)}
        assert covered == set(hit)
        for h in r.hits:
            assert words_of(r.text[h.start : h.end]) == words_of(r.text)[h.first : h.last + 1]


def test_drop_contaminated_keeps_columns(spark, docs):
    frame = docs(TEXTS)
    kept = decontaminate.drop_contaminated(frame, spark_items(spark, ITEMS))
    assert kept.schema == frame.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in TEXTS if not hits_by_force(t, ITEMS)[1]]
    many = decontaminate.drop_contaminated(frame, spark_items(spark, ITEMS), block_chars=60)
    assert many.schema == frame.schema and sorted(r.doc_id for r in many.collect()) == sorted(r.doc_id for r in kept.collect())
    none = spark_items(spark, [])
    assert decontaminate.drop_contaminated(frame, none).count() == len(TEXTS)
    assert decontaminate.contaminated_spans(docs([]), spark_items(spark, ITEMS)).count() == 0
    assert decontaminate.contaminated_spans(frame, none).where("size(hits) > 0").count() == 0


# --- fingerprints -------------------------------------------------------------


def five(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = five(a), five(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB é\t\n\x1c", max_size=30), max_size=6))
def test_words_equal_split(texts):
    data = [t.encode() for t in texts]
    hashes, first = shingles.words(data)
    split = [t.lower().split() for t in data]
    assert np.diff(first).tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) and len(set(zip(flat, hashes.tolist()))) == len(set(flat))


def test_fingerprints_estimate_likeness(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    got = QUERIES["op5_fingerprints"](spark, tables).toPandas().sort_values("doc_id")
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    for near, pairs in ((got.near_edited, zip(texts, edited)), (got.near_next, zip(texts, after))):
        off = near.to_numpy() - np.array([likeness(a, b) for a, b in pairs])
        assert abs(off).max() < 0.15 and abs(off).mean() < 0.03 and abs(off.mean()) < 0.01
    plain = fingerprints.fingerprint_documents(spark.read.parquet(f"{tables}/documents.parquet")).toPandas().sort_values("doc_id")
    assert plain.fingerprint.tolist() == got.fingerprint.tolist()


@pytest.mark.parametrize("per_range", [2, 1000])
def test_fingerprints_odd(docs, odd, per_range):
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fingerprints.edit_with_next(docs(odd), docs_per_range=per_range).collect()
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    want = {(i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, _), t, n in zip(rows, texts, after)}
    assert {(r.doc_id, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].fingerprint == by_id[1].fingerprint == "0" * 512 and by_id[0].near_next == 1.0 and by_id[3].near_next == 0.0
    assert by_id[8].fingerprint == by_id[9].fingerprint
    assert fingerprints.edit_with_next(docs([])).count() == 0
    (alone,) = fingerprints.edit_with_next(docs([(5, "ab cd")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and alone.near_next == 1.0


def test_bins_by_force():
    """One shingle at a time: the least hash of each bin, then the first filled bin in each empty one's order."""
    texts = [b"", b"one", b"a b c d e f g", " ".join(f"w{k % 700}" for k in range(900)).encode()]
    low, filled = fingerprints.bins(texts)
    hashes, at = shingles.shingles(texts, fingerprints.WIDTH)
    shift, full = 64 - 9, (1 << 64) - 1
    assert fingerprints.BINS == 512
    for k, (a, b) in enumerate(zip(at, at[1:])):
        least = {}
        for h in map(int, hashes[a:b]):
            least[h >> shift] = min(least.get(h >> shift, full), h & (1 << 48) - 1)
        assert filled[k] == len(least)
        for bin_ in range(512):
            at_, t = bin_, 0
            while least and at_ not in least:
                at_, t = (int(fingerprints._tries(t)[bin_]), t + 1) if len(least) > 1 else (next(iter(least)), 0)
            want = int(shingles.mix(np.array([(least[at_] + bin_ * 0x9E3779B97F4A7C15) & full], np.uint64))[0]) & 15 if least else 0
            assert low[k, bin_] == want


def test_many_ranges_and_a_hot_id(docs, monkeypatch):
    """More ranges than are taken, and an id that holds most rows; successors as in one sorted list."""
    monkeypatch.setattr(fingerprints, "MOST_RANGES", 50)
    rows = [(i, f"text {i} of some") for i in range(0, 3000, 3)] + [(900, f"hot {i % 40}") for i in range(2000)]
    got = fingerprints.edit_with_next(docs(rows), docs_per_range=1).collect()
    rows = sorted(rows)
    after = rows[1:] + rows[:1]
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, n) in zip(rows, after)]
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted(want)


# --- quality ------------------------------------------------------------------


def made_corpus(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["an", "the", "er", "on", "re", "st", "ing", "ou", "tion", "ha"]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(20, 120))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[k] = str(rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = made_corpus(1600, 1)
    known = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    frame = docs(rows).withColumn("__rl", F.lit(1))
    got = {r.doc_id: r for r in quality.assess(frame, known).collect()}
    test = labels[1000:]
    clean = [got[i].keep for i, q, t in test if q and not t]
    rest = [not got[i].keep for i, q, t in test if not q or t]
    assert np.mean(clean) > 0.97 and np.mean(rest) > 0.9
    assert np.corrcoef([q + 1 - t for _, q, t in test], [got[i].expected_grade for i, *_ in test])[0, 1] > 0.8
    kept = quality.select(frame, known)
    assert kept.schema == frame.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def scalar_features(text):
    """One word at a time: the buckets, then the shape tokens."""
    data = text.encode()
    words = data.lower().split()
    bucket = lambda w: int(shingles.mix(np.array([int.from_bytes(w[:4], "little") + 1], np.uint64))[0]) >> 44
    found = {bucket(w) for w in words if len(w) >= 4}
    share = lambda kind: sum(c in kind for c in data) / max(1, len(data))
    upper, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    signs = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
    n = len(words)
    return found, [min(19, int(1.5 * np.log2(n + 1))), 20 + min(9, int(10 * len(found) / max(1, n))), 40 + min(9, int(20 * share(upper))), 60 + min(19, int(50 * share(signs))), 80 + min(9, int(50 * share(digits)))]


def test_features_by_force():
    texts = [t for t, _ in [*((x, 0) for _, x in made_corpus(60, 9)[0])]] + ["", "a b", "Ärger über 日本語 and 12 34!!", "word " * 3000]
    assert 1 << 20 == quality.BUCKETS
    row, bucket, shape = quality.features([t.encode() for t in texts])
    for k, t in enumerate(texts):
        found, own = scalar_features(t)
        assert set(bucket[row == k].tolist()) == found and shape[k].tolist() == own


def test_model_is_at_its_least_loss():
    """Ordered thresholds, and a penalised likelihood, written out anew, that no small step lowers."""
    rows, labels = made_corpus(300, 2)
    texts = [t.encode() for _, t in rows]
    row, bucket, shape = quality.features(texts)
    grades = np.array([q + 1 - t for _, q, t in labels])
    own = [(bucket[row == i].astype("<u4"), shape[i].astype(np.uint8)) for i in range(len(rows))]
    model = quality.fit_rows(own, grades)
    assert model.grades == [0, 1, 2] and model.thresholds[0] <= model.thresholds[1]
    below = model.at_most(texts)
    assert (below[:, 0] <= below[:, 1] + 1e-12).all()
    df = np.bincount(bucket, minlength=quality.BUCKETS)
    used = np.flatnonzero(model.column >= 0)
    assert used.tolist() == [b for b in range(quality.BUCKETS) if quality.MIN_DOCS <= df[b] < len(rows)]
    idf = np.log(len(rows) / df[used]) / quality.IDF_SCALE

    def loss(thresholds, weight, shape_weight):
        total = 0.0
        for i, g in enumerate(grades):
            s = sum(weight[model.column[b]] for b in own[i][0] if model.column[b] >= 0) + sum(shape_weight[x] for x in own[i][1])
            cumulative = [0.0, *(1 / (1 + np.exp(s - t)) for t in thresholds), 1.0]
            total -= np.log(cumulative[g + 1] - cumulative[g])
        free = np.concatenate([weight / idf, shape_weight / quality.SHAPE_WEIGHT])
        return total / len(rows) + quality.PENALTY * (free @ free)

    at = loss(model.thresholds, model.weight, model.shape_weight)
    rng = np.random.default_rng(4)
    for k in range(12):
        parts = [model.thresholds.copy(), model.weight.copy(), model.shape_weight.copy()]
        which = parts[k % 3]
        place = int(rng.integers(len(which)))
        for step in (1e-3, -1e-3):
            moved = which[place]
            which[place] = moved + step
            assert loss(*parts) > at - 2e-6
            which[place] = moved


def test_op4_query_by_force(spark, tables):
    """The query's rows from the fitted model, one text at a time."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = quality.fit(docs, quality.graded_labels(labels))
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, tables).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        found, shape = scalar_features(text)
        s = sum(model.weight[model.column[b]] for b in found if model.column[b] >= 0) + sum(model.shape_weight[x] for x in shape)
        cumulative = [0.0, *(1 / (1 + np.exp(s - t)) for t in model.thresholds), 1.0]
        of_each = np.diff(cumulative)
        assert abs(got[i].p_best - of_each[model.grades.index(2)]) < 2e-6 and abs(got[i].expected_grade - of_each @ model.grades) < 2e-6
        assert got[i].keep == (got[i].p_best >= quality.KEEP_FROM)


def test_sample_is_bounded_by_documents(spark, docs, monkeypatch):
    """A rated doc_id on very many rows counts once, and texts of too many buckets not at all."""
    rows, labels = made_corpus(200, 5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hot = docs(rows).unionByName(docs(rows[:1]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("k"))
    gathered = []
    monkeypatch.setattr(quality, "fit_rows", lambda own, grades, fit=quality.fit_rows: gathered.append(len(own)) or fit(own, grades))
    quality.fit(hot, quality.graded_labels(known))
    monkeypatch.setattr(quality, "SAMPLE_BUCKETS", 40)
    quality.fit(docs(rows), quality.graded_labels(known))
    assert gathered[0] == 200 and 0 < gathered[1] < 200


def test_quality_odd(spark, docs, odd):
    frame = docs(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (6, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for labels, grade in ((none, None), (one, 2.0)):
        rows = quality.assess(frame, labels).collect()
        assert len(rows) == len(odd) and all(r.keep and r.expected_grade == grade for r in rows)
    rows, labels = made_corpus(60, 3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    both = quality.assess(docs(rows + [(None, None), (200, "z " * 50_000), (3, rows[3][1])]), known).collect()
    assert len(both) == 63 and all(0 <= r.p_best <= 1 for r in both)
    assert quality.assess(docs([]), known).count() == 0


# --- licences -----------------------------------------------------------------


def files(spark, rows):
    return spark.createDataFrame([(p, t, "own") for p, t in rows], "path string, text string, license string")


def test_licences_and_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        ("a/LICENSE", mit), ("a/b/x.txt", "prose only"), ("a/b/c/COPYING.md", f"words\n{gpl}"), ("a/b/c/d/y.txt", None), ("a/b/c/z.txt", "Licensed under the Apache License, Version 2.0."),
        ("q/w.txt", "nothing"), ("top.txt", ""), (None, mit), ("a/b/NOTICE", "no licence here"), ("a/b/x.txt", "prose only"), ("m/LICENSE", gpl), ("m/notice.txt", mit), ("m/n.txt", "long " * 30_000),
    ]
    got = licenses.scan(files(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"path", "own_license", "similarity", "is_license_file", "license", "inherited_from"}
    found = {r.path: (r.own_license, r.license, r.inherited_from) for r in got}
    assert found["a/LICENSE"] == ("MIT", "MIT", None) and found["a/b/x.txt"] == (None, "MIT", "a") == found["a/b/NOTICE"]
    assert found["a/b/c/d/y.txt"] == (None, "GPL-3.0", "a/b/c") and found["a/b/c/z.txt"] == ("Apache-2.0", "Apache-2.0", None)
    assert found["q/w.txt"] == found["top.txt"] == (None, None, None) and found[None] == ("MIT", "MIT", None)
    assert found["m/n.txt"][1] == "GPL-3.0"  # equal cosines: the first licence
    assert licenses.scan(files(spark, [])).count() == 0


def test_no_line_without_an_anchor_could_match():
    t = licenses.Templates(licenses.TEMPLATES)
    for name, vector in t.vectors.items():
        rest = sum(w * w for u, w in vector.items() if u not in t.anchors) ** 0.5
        assert rest < t.threshold * t.length[name]
        assert re.search(t.anchor_pattern(), licenses.TEMPLATES[name].lower())


MIT = licenses.NOTICES["MIT text"].replace("MIT License Copyright (c) ", "MIT License\n\nCopyright (c) 2019-2024 Some One <one@example.org>\n\n")
APACHE_TITLE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL3_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
GPL2_HEADER = """# frobnicate: turn things into other things
# Copyright (C) 2011  Some One
#
# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.

import sys
"""
APACHE_HEADER = """/*
 * Copyright 2014 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package a;
"""
BSD3 = "Copyright (c) 2005, A University\nAll rights reserved.\n\n" + licenses.NOTICES["BSD-3-Clause text"].replace("the copyright holder nor the names of its", "A University nor the names of its")
SAMPLES = [
    ("LICENSE", MIT, "MIT"), ("COPYING", GPL3_TITLE, "GPL-3.0"), ("LICENSE.txt", APACHE_TITLE, "Apache-2.0"), ("LICENSE-APACHE-2.0", APACHE_TITLE, "Apache-2.0"), ("LICENCE", BSD3, "BSD-3-Clause"),
    ("UNLICENSE", licenses.NOTICES["Unlicense text"], "Unlicense"), ("a.py", GPL2_HEADER, "GPL-2.0"), ("A.java", APACHE_HEADER, "Apache-2.0"), ("b.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0"),
    ("c.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"), ("d.py", "code()\n# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("e.html", f"<!-- {licenses.NOTICES['MPL-2.0 header']} --><p>x", "MPL-2.0"),
    ("f.py", f'\n"""A module.\n\n{licenses.NOTICES["LGPL-3.0 terms"]}\n"""\nx = 1', "LGPL-3.0"), ("g.md", "# A title\n\nProse about the software, its source and the public.", None), ("h.txt", "mit", None),
    ("i.txt", "mit dem Hund", None), ("j.txt", MIT.replace("\n", " "), None), ("k.go", "// Copyright 2012 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage k", "BSD-3-Clause"),
    ("l.txt", "SPDX-License-Identifier: Foo-1.0", None), ("COPYING.LESSER", GPL3_TITLE.replace("GENERAL", "LESSER GENERAL", 1), "LGPL-3.0"),
]


@pytest.mark.parametrize("root", ["", "/srv/tree/"])
def test_real_headers_and_licence_files(spark, root):
    rows = [(f"{root}{k}/{name}", text) for k, (name, text, _) in enumerate(SAMPLES)]
    rows += [(f"{root}{k}/deep/er/x.txt", "prose") for k, (name, _, own) in enumerate(SAMPLES) if licenses.re.match(licenses.LICENSE_FILE, name.lower())]
    got = {r.path: r for r in licenses.scan(files(spark, rows)).collect()}
    assert [got[f"{root}{k}/{name}"].own_license for k, (name, _, _) in enumerate(SAMPLES)] == [own for _, _, own in SAMPLES]
    for k, (name, _, own) in enumerate(SAMPLES):
        if licenses.re.match(licenses.LICENSE_FILE, name.lower()):
            assert (got[f"{root}{k}/deep/er/x.txt"].license, got[f"{root}{k}/deep/er/x.txt"].inherited_from) == (own, f"{root}{k}")


def cosine(t, line, name):
    from collections import Counter

    own = {u: f * t.idf.get(u, t.unseen) for u, f in Counter(licenses.terms_of(line)).items()}
    size = sum(w * w for w in own.values()) ** 0.5
    return sum(w * t.vectors[name].get(u, 0.0) for u, w in own.items()) / (size * t.length[name]) if size else 0.0


def test_licences_by_force(spark):
    t, every = licenses.Templates(licenses.TEMPLATES), licenses.all_templates()
    rng = np.random.default_rng(2)
    terms = [*t.idf, "zebra", "the", "of", "mit", "Ω"]
    lines = [" ".join(rng.choice(terms, rng.integers(1, 12))) for _ in range(150)]
    lines += [s + " " + " ".join(rng.choice(terms, rng.integers(0, 4))) for s in licenses.TEMPLATES.values() for _ in range(6)]
    lines += ["the the the of of " * 40 + "license", "zebra " * 200 + licenses.TEMPLATES["MIT"], "mit", "mit zebra", "MIT License"]
    lines += [f"# {s[:90]}" for s in licenses.NOTICES.values()] + [f"# {s}".replace("\n", " ") for s in licenses.NOTICES.values()]
    rows = [(f"d/{i}.txt", s) for i, s in enumerate(lines)]
    got = {r.path: (r.own_license, r.similarity) for r in licenses.own_licenses(files(spark, rows).drop("license"), t).collect()}
    for path, line in rows:
        known = [len({u for u in licenses.terms_of(line) if u in k.idf}) >= 2 for k in (t, every)]
        units = [(k, u) for k, u, ok in ((t, line, known[0]), (every, line if line.startswith("#") else "", known[1])) if ok]
        found = [(round(cosine(k, u, n), 6), licenses.license_of(n)) for k, u in units for n in k.vectors]
        best = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, ""))
        want = (best[1], best[0]) if best[0] >= t.threshold else (None, None)
        assert got[path] == pytest.approx(want) if want[1] is None else (got[path][0] == want[0] and abs(got[path][1] - want[1]) < 2e-6), line


# --- pipeline -----------------------------------------------------------------


def test_pipeline_by_force(spark, tables):
    """run() against each stage's brute-force version on the rows its predecessor kept."""
    import public_tokenizers
    from tests.llm.test_dedup import class_of_each, cut_later_runs
    from tests.llm.test_simhash_near import alike, shingle_set

    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet").toPandas()
    benchmark = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, docs, tables).collect()}
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert np.mean([i in kept for i in clean]) > 0.95
    cut = cut_later_runs(list(kept.items()), lambda t: t.split("\n"), lambda u: u, 3, None, "\n")
    kept = {i: cut[i, t] for i, t in kept.items() if cut[i, t] or not t}
    sets = {i: shingle_set(t) for i, t in kept.items()}
    of = class_of_each(kept, lambda a, b: alike(sets[a], sets[b]))
    least = {}
    for i, c in of.items():
        least[c] = min(least.get(c, i), i)
    kept = {i: t for i, t in kept.items() if i in set(least.values()) and not hits_by_force(t, benchmark)[1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert got.keys() == kept.keys()
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())
    assert len(corpus_pipeline.STAGES) == 5 and public_tokenizers.PATTERN


def test_pipeline_stages_keep_the_columns_of_documents(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_pipeline_stages_take_odd_rows(spark, docs, odd, tables):
    """Null ids and texts, repeated rows, a long text and clashing columns through all stages; what stages wrote on the way goes."""
    import corpus_pipeline
    from recordloom import session

    rows = docs(odd + [(3, "\n\n\n"), (20, "long words and more of them. " * 20_000), (21, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, tables)
        assert kept.schema == rows.schema and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in rows.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, rows, tables)
    assert last.count() == rows.count()
    before = set(session.made_folders())
    corpus_pipeline.run(spark, tables)
    assert len(set(session.made_folders()) - before) == 1
