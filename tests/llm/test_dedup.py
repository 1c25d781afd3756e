"""Substring, line, sentence and SimHash dedup against brute force."""

import collections
import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import graph, line_dedup, sentence_dedup, simhash, substring_dedup, suffix_array
from recordloom.llm.queries import ORACLES, QUERIES


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=300).map(str.encode))
def test_suffix_array_and_common_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    sa, rank = suffix_array.suffix_array(text)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert rank[sa].tolist() == list(range(len(data)))
    common = lambda i, j: len(os.path.commonprefix([data[i:], data[j:]]))
    want = [0] * bool(data) + [common(sa[k - 1], sa[k]) for k in range(1, len(data))]
    assert suffix_array.common_prefixes(text, sa).tolist() == want
    assert np.array_equal(suffix_array.common_prefixes(text, sa, 5) >= 5, np.array(want, int) >= 5)


def cut_by_count(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def noisy_texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé "), rng.integers(2, 9))) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words, n))
    passages = [some(30) for _ in range(5)]
    texts = []
    for _ in range(90):
        t = some(rng.integers(0, 40))
        for _ in range(rng.integers(0, 3)):
            t += " " + passages[min(4, int(rng.integers(0, 12)))] + some(rng.integers(0, 4))
        texts.append(t)
    return [*texts, "", "x" * 700, "y" * 199, "y" * 200, "y" * 201, None, texts[3], texts[3], "ab" * 300]


@pytest.mark.parametrize("k", [{}, {"length": 50, "anchor": 20}, {"length": 50, "anchor": 20, "hot": 3, "shard_bytes": 3000}, {"length": 60, "anchor": 30, "hot": 1, "shard_bytes": 500}])
def test_substrings_by_count(docs, k):
    texts = noisy_texts()
    got = substring_dedup.dedup_substrings(docs(list(enumerate(texts))), **k).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == cut_by_count(texts, k.get("length", 200))
    for r in got:
        assert len(r.starts) == r.n_spans == len(r.ends) and sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed


def test_substrings_odd(docs, odd):
    got = substring_dedup.dedup_substrings(docs(odd)).collect()
    want = cut_by_count([t for _, t in odd], 200)
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted((n, r) for n, r, *_ in want)
    twice = [(1, "z" * 50 + "abc" * 100), (1, "z" * 50 + "abc" * 100)]
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs(twice)).collect()] == [350, 350]
    assert substring_dedup.dedup_substrings(docs([])).count() == 0


def test_repeated_rows_are_searched_once(docs, monkeypatch):
    """Rows of one doc_id and text, many of them, beside the same text under other ids."""
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abcdefgh\x00"), 4000))
    rows = [(1, text)] * 1000 + [(2, text[:300] + "other" * 60), (3, "".join(rng.choice(list("xyz"), 500)))] + [(None, text[1000:1500])] * 3
    cuts = []
    monkeypatch.setattr(substring_dedup, "_cut_contexts", lambda found, length, cut=substring_dedup._cut_contexts: cuts.append(found.count()) or cut(found, length))
    got = substring_dedup.dedup_substrings(docs(rows), hot=1).collect()
    want = dict(zip([r for r in rows], cut_by_count([t for _, t in rows], 200)))
    assert len(got) == len(rows) and cuts[0] <= 4
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == {(i, *x) for (i, _), x in want.items()}


def test_runs_merge_by_binary_search():
    """Windows with zero bytes at their ends stay apart; merged runs are in order."""
    rng = np.random.default_rng(13)
    make = lambda n: np.unique(np.frombuffer(rng.choice(np.frombuffer(b"\x00\x01\xff", np.uint8), n * 4).tobytes(), "S4"))
    for n in (1, 5, 60):
        x, y = make(n), make(n)
        tag = lambda r, k: np.array([(k, i, 0) for i in range(len(r))], substring_dedup._MEMBER)
        windows, members = substring_dedup.merge_sorted((x, tag(x, 0)), (y, tag(y, 1)))
        flat = lambda r: [bytes(v).ljust(4, b"\x00") for v in r]
        assert flat(windows) == sorted(flat(x) + flat(y))
        assert all((x, y)[m["ch"]][m["w"]] == w for w, m in zip(windows, members))


def test_context_hashes_of_regular_texts():
    """Thue-Morse words and their complements, on which polynomials in the bytes agree."""
    word = bytes(97 + (i.bit_count() & 1) for i in range(4096))
    both = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    spans = substring_dedup.Spans(both)
    assert len(set(spans.of(np.array([0, 4096]), np.array([2048, 6144])).tolist())) == 2


def test_long_texts_are_cut_into_segments(docs, monkeypatch):
    rng = np.random.default_rng(8)
    long_one = "".join(rng.choice(list("abcdefgh"), 9000))
    texts = [long_one, "x" + long_one[2500:7000] + "y", long_one[:300]]
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 1000)
    whole = [len(p) for parts, _, _ in substring_dedup._segments([t.encode() for t in texts], 200, 1000) for p in parts]
    assert max(whole) == 1199
    found = [substring_dedup.contexts(p, 200, 88) for p, _, _ in substring_dedup._segments([long_one.encode()], 200, 1000)]
    assert sum(int(f["n"].sum()) for f in found) == 9000 - 199
    got = substring_dedup.dedup_substrings(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == cut_by_count(texts, 200)


def test_op2_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op2_substring_dedup"](spark, tables).toPandas().sort_values("doc_id")
    want = cut_by_count(docs.text, 200)
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == [(a, b, c, hashlib.sha256(x).hexdigest()) for a, b, c, x in want]


def cut_later_runs(rows, units_of, same_of, width, min_words, joiner):
    """First occurrences stay; rows of equal id and text are one document."""
    seen, first = collections.Counter(), {}
    places = []
    for key in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, xxhash_spark(r[1]))):
        same = [same_of(u) for u in units_of(key[1])]
        for at in range(len(same)):
            n = width
            while min_words and at + n < len(same) and sum(len(u.split()) for u in same[at : at + n]) < min_words:
                n += 1
            run = "\n".join(same[at : at + n])
            if at + n <= len(same) and (len(run.split()) >= min_words if min_words else run.strip(" \t\r\n")):
                places.append((key, at, n, run))
    copies = collections.Counter((i, t or "") for i, t in rows)
    for key, at, n, run in places:
        first.setdefault((n, run), (key, at))
        seen[n, run] += copies[key]
    gone = collections.defaultdict(set)
    for key, at, n, run in places:
        if first[n, run] != (key, at):
            gone[key] |= set(range(at, at + n))
    return {k: joiner.join(u for j, u in enumerate(units_of(k[1])) if j not in gone[k]) for k in copies}


def xxhash_spark(text):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


LINES = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, "a\nb"), (6, "q\nr\ns\nq\nr\ns\nt"), (7, "\n\n\n\n"), (8, "\n\n\n"), (9, "b\nc\nd\ne"), (3, "a\nb\nc"), (3, "other\na\nb\nc"),
    (None, "a\nb\nc\nnull id"), (10, None), (11, ""),
]


def test_lines(docs):
    want = cut_later_runs(LINES, lambda t: t.split("\n"), lambda u: u, 3, None, "\n")
    got = line_dedup.dedup_lines(docs(LINES)).collect()
    assert len(got) == len(LINES) and "covered" in got[0]
    assert all(r.kept_text == want[r.doc_id, r.text or ""] for r in got)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (4, 5, 7, 8, 10)} == {4: 0, 5: 0, 7: 0, 8: 0, 10: 0}


def test_rewrite_keeps_columns_and_drops_only_emptied(docs):
    frame = docs(LINES)
    got = line_dedup.rewrite(frame)
    assert got.schema == frame.schema
    rows = got.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in LINES} and all(r.text != 'a\nb\nc' or r.doc_id is None for r in rows)
    assert all(r.n_chars == len(r.text or "") for r in rows) and any(r.text == "other" for r in rows)
    assert line_dedup.rewrite(docs([])).count() == 0


def test_sentences(docs):
    long_one = "This single sentence goes on " * 5 + "to its end."
    passage = "One sentence of five words. Two there! Then a third one with eight words in it? And one more to make sixteen."
    rows = [
        (1, f"{passage} Four."), (2, f"Zero. {passage.replace('. ', '.  ')} Five. Six."), (3, "One here. Two there!"), (4, "One here. Two there!"), (5, f"Before it. {long_one} After it."),
        (6, f"{long_one}\nElse."), (7, None), (8, ""), (9, "no end"), (10, "... !!!\n??"), (1, f"{passage} Four."), (None, f"{passage} Five."), (11, "a\nb\nc\nd\n" * 8), (12, "a\nb\nc\nd\n" * 3),
        (13, f"Half a {passage}"), (14, f"{long_one} After it. {long_one}"), (15, "word " * 30_000 + "end. " + passage), (16, "x. " * 9000),
    ]
    pattern = re.compile(sentence_dedup.SENTENCE)
    want = cut_later_runs(rows, pattern.findall, lambda s: s.strip(" \t\r\n"), sentence_dedup.LEAST, sentence_dedup.MIN_WORDS, "")
    got = sentence_dedup.dedup_sentences(docs(rows)).collect()
    assert len(got) == len(rows) and all(r.kept_text == want[r.doc_id, r.text or ""] for r in got)
    kept = {r.doc_id: r.kept_text for r in got}
    assert kept[2] == "Zero. Six." and kept[3] == kept[4] == rows[2][1] and kept[6] == rows[5][1] and kept[13].startswith("Half a One") and kept[15].endswith("end. ")
    assert all("".join(pattern.findall(t)) == t for _, t in rows if t)
    assert sentence_dedup.dedup_sentences(docs([])).count() == 0


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, tables, name):
    c = duckdb.connect()
    for t in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    got, want = QUERIES[name](spark, tables).toPandas(), c.execute(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def class_of_each(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_classes(docs, odd):
    base = "the quick brown fox jumps over the lazy dog and then runs away from all of the others in the yard " * 12
    rows = [(i, t) for i, t in odd if i is not None] + [(50 + i, base + f"tail {i}") for i in range(25)] + [(90, base), (91, base)]
    prints = {}
    for i, t in rows:
        prints.setdefault(fingerprint(t), []).append(i)
    of_print = class_of_each(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = {}
    for fp, ids in prints.items():
        least = min(i for other, js in prints.items() if of_print[other] == of_print[fp] for i in js)
        want |= {(i, f"{fp:016x}"): least for i in ids}
    got = simhash.classes(docs(rows)).collect()
    assert len(got) == len(rows) and all(want[r.doc_id, r.fingerprint] == r.component_id for r in got)
    kept = simhash.keep_one_of_each(docs(rows + [(None, "no id")]))
    assert {r.doc_id for r in kept.collect()} == {*want.values(), None}
    assert simhash.classes(docs([])).count() == 0


def test_links_of_crowded_files(spark):
    rng = np.random.default_rng(4)
    center = int(rng.integers(0, 1 << 62))
    values = {center ^ sum(1 << int(b) for b in set(rng.integers(0, 64, k))) for k in (1, 2, 3, 3, 4, 4) for _ in range(25)}
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").cache()
    want = class_of_each(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for limit in (4096, 20, 3):
        found = simhash.links(rows, file_limit=limit).collect()
        assert all(((a ^ b) & (1 << 64) - 1) for a, b in found)
        got = {v: v for v in values}

        def find(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in found:
            x, y = find(a % (1 << 64)), find(b % (1 << 64))
            got[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
