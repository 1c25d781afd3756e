"""Byte-level BPE encoding and decoding.

The rank file of a byte-level vocabulary becomes a model of the ``tokenizers``
library. Its bytes are mapped to printable characters (``byte_alphabet``), every
pair of tokens that a listed token can be made of becomes a merge at that
token's rank, and the split pattern isolates the stretches that are merged
separately. Each distinct stretch goes through the library once per worker; a
bounded table keeps its ids.

Decoding looks the ids up, reverses the byte table and joins bytes, so a
character whose bytes were split over tokens comes back whole.

Defined cases: a null text is an empty text; an empty text has no ids; repeated
rows give repeated results; further columns of the input are dropped unless
named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import Known, one_thread, pieces, texts

BATCH_BYTES, LIBRARY_TEXTS = 1 << 20, 2000
#: Texts of these characters are split here; others by the library's own engine,
#: so that two Unicode versions never meet.
COMMON = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")


def byte_alphabet() -> list[str]:
    """The printable character for each byte.

    Visible Latin-1 characters stand for themselves, the rest follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        one_thread()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_alphabet()
        shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, text))
        self.split = regex.compile(pattern).findall
        self.known = Known()

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library, some texts at a time, since what it returns is far larger than ids."""
        out: list[bytes] = []
        for at in range(0, len(texts), LIBRARY_TEXTS):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + LIBRARY_TEXTS], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        common = [COMMON.fullmatch(t) is not None for t in texts]
        cut = [self.split(t) if ok else [] for t, ok in zip(texts, common)]
        known = self.known
        new = known.missing(cut)
        known.update(zip(new, self._whole(new)))
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in cut]
        known.forget_long(new)
        odd = [i for i, ok in enumerate(common) if not ok]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The character span of each id; a character split over ids is in each of their spans."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    """One codec per worker process, kept between tasks."""
    return ByteBpe(ranks_path, pattern)


def decimal_digest(ids: bytes) -> str:
    """SHA-256 of the decimal ids joined by commas."""
    return hashlib.sha256(",".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode()).hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) with ids as packed little-endian unsigned 32-bit integers.

    ``offsets`` adds ``starts`` and ``ends``, each id's span in characters.
    ``array_ids`` unpacks the ids.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
    if offsets:
        schema = schema.add("starts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in pieces(batches, "text", BATCH_BYTES):
            values = batch.column("text").to_pylist()
            columns = [batch.column("doc_id"), pa.array(bpe.encode(values), pa.binary())]
            if offsets:
                spans = [bpe.offsets(t) for t in values]
                columns += [pa.array([[s[k] for s in own] for own in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return texts(docs).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of packed ids; ``decoded`` holds the texts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in pieces(batches, "ids", BATCH_BYTES):
            decoded = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, with one codec a worker.

    ``with_ids`` adds the packed ids.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids = bpe.encode(batch.column("text").to_pylist())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array(map(decimal_digest, ids), pa.string()),
                "decoded_sha256": pa.array((hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids), pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    return texts(docs).mapInArrow(run, schema)


def unpack(ids: Iterable[bytes | None]) -> list[list[int]]:
    return [np.frombuffer(x or b"", "<u4").tolist() for x in ids]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def array_ids(ids):
    """Packed ids as an array column."""
    import pandas as pd

    return pd.Series(unpack(ids))
