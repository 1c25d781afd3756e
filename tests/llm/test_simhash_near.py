"""Near-duplicates of five-word shingles against brute force."""

import re

import numpy as np
import pytest

from recordloom.llm import simhash, simhash_near
from tests.llm.test_dedup import class_of_each


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited_texts():
    """Texts of 60 to 250 words, each with copies of one to eight changed words, some of them copies of copies."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 250))))
        out.append(" ".join(words))
        for k in range(10):
            copy = words.copy()
            for at in rng.choice(len(copy), int(rng.integers(1, 9)), replace=False):
                copy[at] = str(rng.choice(vocabulary))
            out.append(" ".join(copy))
            words = copy if k % 3 == 2 else words
    return out


@pytest.mark.parametrize("turns, file_limit", [(0, 4096), (1, 4096), (2, 4096), (2, 4)])
def test_one_of_each_class_by_force(docs, odd, turns, file_limit):
    rows = [(100 + i, t) for i, t in enumerate(edited_texts())] + ([(i, t) for i, t in odd if i is not None] if turns == 2 else [])
    sets = {s: i for i, s in enumerate({shingle_set(t) for _, t in rows})}
    by_number = {i: s for s, i in sets.items()}
    of = class_of_each(by_number, lambda a, b: alike(by_number[a], by_number[b]))
    least = {}
    for i, t in rows:
        c = of[sets[shingle_set(t)]]
        least[c] = min(least.get(c, i), i)
    kept = simhash_near.keep_one_of_each(docs(rows), turns, file_limit)
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_bit_sliced_forests_by_force():
    """Files of all sizes, prints of one to four words: links are within the radius and connect what all pairs connect."""
    rng = np.random.default_rng(5)
    for width, radius, sizes, noise in [(2, 44, [2, 3, 5, 64, 65, 130, 300, 1, 2], 70), (1, 2, [40, 100, 3], 3), (4, 80, [70, 2, 9], 120), (2, 20, [200], 40), (1, 0, [5, 1], 2)]:
        prints, first = [], np.concatenate([[0], np.cumsum(sizes)])
        for m in sizes:
            centers = rng.integers(0, 1 << 64, (3, width), dtype=np.uint64)
            for _ in range(m):
                x = centers[rng.integers(3)].copy()
                for b in rng.integers(0, 64 * width, rng.integers(0, noise)):
                    x[b // 64] ^= np.uint64(1 << int(b % 64))
                prints.append(x)
        prints = np.array(prints)
        links = simhash.spanning_forests(prints, first, radius)
        apart = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())  # noqa: E731, B023
        assert all(apart(i, j) <= radius for i, j in links)
        for a, b in zip(first, first[1:]):
            own = {tuple(sorted(x)) for x in links.tolist() if a <= x[0] < b}
            assert len(own) <= b - a - 1
            want = class_of_each(range(a, b), lambda i, j: apart(i, j) <= radius)
            assert class_of_each(range(a, b), lambda i, j: (min(i, j), max(i, j)) in own) == want


def test_fingerprints_by_force():
    texts = [t.encode() for t in [*edited_texts()[:6], "", "one", "a b c d e f"]]
    hashes, at = simhash_near.shingle_sets(texts)
    got = simhash_near.fingerprints(hashes, at)
    for k, (a, b) in enumerate(zip(at, at[1:])):
        for w in range(simhash_near.BITS // 64):
            members = [int(h) for h in simhash_near.mix(hashes[a:b] + simhash_near._SALTS[w])]
            assert int(got[k, w]) == sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in members) > len(members))


def test_one_changed_word_is_found(spark, docs, tables):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    rows = [(1000 * j + k, " ".join(f"{w}x{j}" if i != 7 * k + 1 else "other" for i, w in enumerate(words))) for j in range(5) for k in range(20)]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs(rows), tables).collect()) == [0, 1000, 2000, 3000, 4000]


def test_rows_of_a_class_are_one(docs):
    base = " ".join(f"w{k}" for k in range(200))
    near = base.replace("w50 ", "other ")
    rows = [(3, base), (3, base), (3, "something else"), (5, near), (None, base), (None, "alone"), (None, "alone"), (7, "ALONE"), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.text or "") for r in simhash_near.keep_one_of_each(docs(rows)).collect()), key=repr)
    assert got == sorted([(3, base), (3, "something else"), (7, "ALONE"), (None, "")], key=repr)
