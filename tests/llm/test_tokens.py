"""Byte-level BPE and token files against the tiktoken and tokenizers libraries."""

import base64
import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import bpe, common, queries, token_files

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ALPHABET = "ab sS't \t\n\r 　éßñİΣς日本語한🙂‍́12٣½\x1c\x85.,!<|endoftext|>\x0b"


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=40))
def test_ids_and_round_trip(tik, text):
    own = bpe.codec(RANKS, P.PATTERN)
    (ids,) = own.encode([text])
    assert bpe.unpack([ids])[0] == tik.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_offsets_cover_split_characters():
    own = bpe.codec(RANKS, P.PATTERN)
    text = "a🙂 é"
    spans = own.offsets(text)
    assert len(spans) == len(bpe.unpack(own.encode([text]))[0])
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))


def test_byte_alphabet_is_one_to_one():
    assert len(set(bpe.byte_alphabet())) == 256 and bpe.byte_alphabet()[0x20] == "Ġ"


def test_round_trip_table(spark, docs, odd, tik):
    rows = docs(odd)
    got = {}
    for r in bpe.round_trip(rows, RANKS, P.PATTERN, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in odd:
        ids, data = tik.encode_ordinary(text or ""), (text or "").encode()
        assert any(r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(data).hexdigest() and bpe.unpack([r.ids])[0] == ids for r in got[i])
    encoded = bpe.encode_documents(rows, RANKS, P.PATTERN, offsets=True)
    assert all(len(r.starts) == len(r.ids) // 4 == len(r.ends) for r in encoded.collect())
    decoded = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert decoded == {(i, (t or "").encode()) for i, t in odd}
    assert encoded.select(bpe.array_ids("ids").alias("a")).where("size(a) > 3").count() > 0
    assert bpe.round_trip(docs([]), RANKS, P.PATTERN).count() == 0


def ids_of(own, texts):
    return [np.frombuffer(x, f"<u{own.width}").tolist() for x in own.encode(texts)]


def test_word_encoder_equals_library():
    own, whole = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    alphabet = [*ALPHABET, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "THWYJ", "\u0308", "\u0331", "\u030a", "\u030c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert ids_of(own, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_over_all_letters_and_marks():
    """Every letter, mark and number of Unicode, alone, after a capital, and in random company."""
    own, whole = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(6)
    chars = [chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c))[0] in "LMN"]
    marks = [c for c in chars if unicodedata.category(c)[0] == "M" and ord(c) < 0x3000]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÑÖØÞ"
    texts = [" ".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]
    texts += [" ".join(c + m + "a" for c in capitals) + " " + m for m in marks]
    texts += ["".join(rng.choice([rng.choice(chars), rng.choice(marks), rng.choice(capitals), " ", "a", "'s"]) for _ in range(60)) for _ in range(3000)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(own, texts) == want


def test_pieces_are_told_apart_by_bytes():
    """Thue-Morse words, which polynomial hashes modulo 2**64 take for equal whatever their base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    own, whole = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    assert ids_of(own, [word, other, word]) == [whole.encode(t, add_special_tokens=False).ids for t in (word, other, word)]


def test_long_texts_are_cut_at_blanks(monkeypatch):
    own, whole = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    text = "Some long text, with H\u0331al\u012bl and 1234 more words; " * 30_000 + "x" * 5000
    assert len(text) > 1 << 20
    monkeypatch.setattr(token_files, "BATCH_BYTES", 100_000)
    assert ids_of(own, ["short", text]) == [whole.encode(t, add_special_tokens=False).ids for t in ("short", text)]


def test_forgotten_words_come_back(monkeypatch):
    monkeypatch.setattr(common, "CACHE_ENTRIES", 8)
    own, fresh = token_files.WordEncoder(WORDS), token_files.WordEncoder(WORDS)
    texts = [f"some words, number {i} of many; {i * 7}th again and again" for i in range(60)]
    assert [own.encode([t])[0] for t in texts] == fresh.encode(texts)


@pytest.mark.parametrize("limits", [{"file_bytes": 40, "task_bytes": 300}, {"file_bytes": 1}, {}])
def test_files(spark, docs, odd, tmp_path, limits):
    """Null ids first, ties by text; whatever the files' sizes, the rows are those of the library."""
    rows = odd + [(100 + i, "many short words " * (i % 9)) for i in range(60)] + [(None, "a no id"), (None, None), (-3, "H\u0331al\u012bl <|endoftext|>"), (104, "many short words " * 4)]
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs(rows), folder, WORDS, end_id=1, **limits)
    whole = Tokenizer.from_file(WORDS)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want
    assert sum(f["docs"] for f in manifest["files"]) == len(want)
    assert token_files.read_document(folder, 104).tolist() == [*whole.encode("many short words " * 4).ids, 1]
    assert token_files.read_document(folder, -3).tolist() == [*whole.encode(rows[-2][1]).ids, 1]
    assert token_files.read_document(folder, 99) is None and token_files.read_document(folder, -5) is None
    assert sorted(p.name for p in (tmp_path / "files").glob("ids-*")) == sorted(f["name"] for f in manifest["files"])
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenFile(f"{folder}/{manifest['files'][0]['name']}", b"other")


def test_files_of_failed_attempts_go(docs, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "ids-000000-0000-77.tok").write_bytes(b"left behind")
    manifest = token_files.write_token_files(docs([(1, "a"), (2, "b")]), f"file://{tmp_path}/files", WORDS, end_id=1)
    assert {p.name for p in (tmp_path / "files").glob("ids-*")} == {f["name"] for f in manifest["files"]}


def test_dictionary_sample_is_bounded_and_fixed(docs):
    rows = [(7, f"text of words {i % 50} and {i * 31} more of them") for i in range(900)] + [(8, "long " * 60_000)]
    made = [token_files.train_dictionary(docs(rows[::step]), WORDS, len(rows), sample_docs=100) for step in (1, -1)]
    assert made[0] == made[1] != b""


def test_no_documents(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write_token_files(docs([]), folder, WORDS, 1)["files"] == []
    assert token_files.read_token_files(spark, folder).count() == 0


def test_queries(spark, tables, tik):
    docs = spark.read.parquet(f"{tables}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.QUERIES["op7_byte_bpe"](spark, tables).toPandas().sort_values("doc_id")
    ids = [tik.encode_ordinary(t) for t in docs.text]
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.ids_sha256.tolist() == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    whole = Tokenizer.from_file(WORDS)
    nine = queries.QUERIES["op9_token_files"](spark, tables).toPandas().sort_values("doc_id")
    assert nine.ids_crc32.tolist() == [zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in docs.text]
