"""Token-id files with a shared zstandard dictionary.

``write_token_files`` encodes documents with a tokenizer of the ``tokenizers``
library, appends the end id and writes files in ascending doc_id order, a new one
after ``FILE_BYTES`` of frames. Each document is one zstandard frame of its own,
made with a dictionary trained on serialized id arrays, so a short document can be
read alone.

File layout (little-endian)::

    b"TOKF" | version u32 | id width u32 | SHA-256 of the dictionary, 32 bytes
    frames, one per document
    doc_id i64 * n | frame offset u64 * (n + 1) | number of ids u64 * n
    n u64 | number of null doc_ids, which come first, u64 | offset of the doc_id table u64 | b"FKOT"

``dictionary`` and ``manifest.json`` (the files with the position of their first
id) stand beside the files. A task attempt writes files under names of its own;
the manifest lists those of the attempts that Spark counted, and what other
attempts left is deleted.

Each distinct piece goes through the library once per worker: its pre-tokenizer
never joins what a blank or a line feed separates. A bounded table keeps the ids.
Pieces are told apart by their bytes.

Defined cases: a null text is empty and gives the end id alone; a null doc_id comes
before all others; an empty table gives an empty manifest and no rows; equal doc_ids
are ordered by text; the string of a special token in a text gives that token's id,
as the library has it; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import Known, partitions, pieces, texts

MAGIC, TAIL, VERSION = b"TOKF", b"FKOT", 2
BATCH_BYTES = 2 << 20
#: Frames of one file, after which a task begins another.
FILE_BYTES = 128 << 20
#: Text of one task, on average; documents of one, at the least; and the most tasks, since each of
#: them has a hundred sampled ids on the driver. Rows are sorted with spilling, so a task may be large.
TASK_BYTES, LEAST_DOCS, MOST_TASKS = 16 << 20, 256, 20_000
LEVEL = 3
#: Of the dictionary's sample: documents, and serialized bytes of one. Their product bounds what the driver gathers.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 16 << 10


#: Kinds of bytes: blank and line feed, letters (and the bytes of Latin-1 letters), digits, signs, and
#: others. Apostrophes are among the others, since they may take the letter after them.
_BREAK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x0A, 0x20]] = _BREAK
_KIND[0x21:0x7F] = _SIGN
_KIND[0x27] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x61:0x7B] = _LETTER
_LATIN = 0xC3  # begins the UTF-8 of U+00C0 to U+00FF


def _cut_long(text: bytes, limit: int) -> list[bytes]:
    """A text's segments of about ``limit`` bytes, cut at blanks only."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find(b" ", at + limit)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def units_of(texts: list[bytes], special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, sizes, whole, first): the stretches of all texts that are encoded separately, side by side.

    Words of blank-free letters, digits and signs are cut as the pre-tokenizer cuts
    them: runs of letters, single digits, runs of signs; their A-Z and upper-case
    Latin-1 letters are lower-cased, as the normalizer does. Words with any other
    byte or with a ``special`` string stay ``whole`` and as they are, since
    composition comes before lower case. Text i has the units first[i]:first[i + 1].
    """
    joined = b" ".join(texts)
    raw, lower = np.frombuffer(joined, np.uint8), joined.lower()
    buf = np.frombuffer(lower, np.uint8).copy()
    kind = _KIND[buf]
    second = np.flatnonzero(buf[:-1] == _LATIN) + 1
    letters = second[(buf[second] != 0x97) & (buf[second] != 0xB7)]
    kind[letters] = kind[letters - 1] = _LETTER
    upper = letters[buf[letters] <= 0x9E]
    buf[upper] += 0x20
    inside = kind != _BREAK
    new = inside.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    stop = np.append(inside[:-1] & (new[1:] | ~inside[1:]), inside[-1:])
    whole = np.zeros(len(buf) + 1, bool)
    odd = [np.flatnonzero(kind == _OTHER)]
    for string in special:
        at = lower.find(string.lower())
        while at >= 0:
            odd.append(np.array([at]))
            at = lower.find(string.lower(), at + 1)
    odd = np.concatenate(odd)
    if len(odd):
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        words, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        which = np.unique(np.searchsorted(words, odd, "right") - 1)
        depth = np.zeros(len(buf) + 1, np.int32)
        depth[words[which]] += 1
        np.subtract.at(depth, ends[which], 1)
        whole = np.cumsum(depth) > 0
        buf[whole[:-1]] = raw[whole[:-1]]
        new &= ~whole[:-1]
        new[words[which]] = True
        stop &= ~whole[:-1]
        stop[ends[which] - 1] = True
    starts, ends = np.flatnonzero(new), np.flatnonzero(stop) + 1
    texts_end = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(starts, texts_end - 1, "left")]).astype(np.int64)
    return buf[inside], ends - starts, whole[starts], first


class WordEncoder:
    """Ids of texts by a tokenizer file whose pre-tokenizer drops white space and joins letters, single digits and signs.

    Units (see ``units_of``) are looked up; those not yet known go through the
    library, pieces many at a time, parted by blanks, where the end-of-word tokens
    tell them apart.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = tuple(t.content.encode() for t in added)
        self.spaced = any(len(t.split()) != 1 for t in self.special)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.known: Known[bytes] = Known()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _pieces(self, new: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            (ids,) = self._library([b" ".join(some).decode()])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                cut = [0, *(ends * self.width).tolist()]
                data = ids.tobytes()
                yield from (data[a:b] for a, b in zip(cut, cut[1:]))
            else:  # a vocabulary without end-of-word tokens
                yield from (x.tobytes() for x in self._library([p.decode() for p in some]))

    def encode(self, values: list[str]) -> list[bytes]:
        """Each text's ids, ``width`` bytes each.

        Each distinct unit of all texts is looked up once; the ids are then laid out
        in the units' order.
        """
        if self.spaced:  # strings that a blank cuts through
            return [x.tobytes() for x in self._library(values)]
        cut = [_cut_long(t.encode(), BATCH_BYTES) for t in values]
        if all(len(c) == 1 for c in cut):
            return self._encode([c[0] for c in cut])
        return [b"".join(p for k in range(0, len(c), 2) for p in self._encode(c[k : k + 2])) for c in cut]

    def _encode(self, values: list[bytes]) -> list[bytes]:
        buf, sizes, whole, first = units_of(values, self.special)
        if not len(sizes):
            return [b""] * len(values)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode()
        of, distinct = units.indices.to_numpy(), units.dictionary.to_pylist()
        one = np.zeros(len(distinct), np.int64)
        one[of] = np.arange(len(of))
        known = self.known
        new = known.missing([distinct])
        if new:
            odd = {distinct[i] for i in np.flatnonzero(whole[one]).tolist()}
            plain = [u for u in new if u not in odd]
            known.update(zip(plain, self._pieces(plain)))
            odd = [u for u in new if u in odd]
            known.update(zip(odd, (x.tobytes() for x in self._library([u.decode() for u in odd]))))
        ids = list(map(known.__getitem__, distinct))
        known.forget_long(new)
        pool = np.frombuffer(b"".join(ids), f"<u{self.width}")
        own = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        n = own[of]
        end = np.cumsum(n)
        take = np.repeat((np.cumsum(own) - own)[of] - (end - n), n)
        take += np.arange(len(take))
        out = pool[take].tobytes()
        cut = (np.concatenate([[0], end])[first] * self.width).tolist()
        return [out[i:j] for i, j in zip(cut, cut[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes) -> None:
    store, path = _store(uri)
    with store.open_output_stream(path) as out:
        out.write(data)


def _get(uri: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def train_dictionary(docs: DataFrame, tokenizer_path: str, count: int, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, max_bytes: int = 112 << 10) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` of the ``count`` documents, those of least hash.

    Documents of over ``sample_bytes`` serialized bytes are not used for training.
    Too small a sample gives no dictionary (empty bytes).
    """
    import zstandard

    mark = F.xxhash64("doc_id", "text")
    chosen = texts(docs).withColumn("mark", mark)
    if count > sample_docs:
        chosen = chosen.where(F.pmod("mark", F.lit(math.ceil(count / sample_docs))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in pieces(batches, "text", BATCH_BYTES):
            made = pa.array(own.encode(batch.column("text").to_pylist()), pa.binary())
            fits = np.diff(np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1]) <= sample_bytes
            yield pa.RecordBatch.from_arrays([batch.column("mark"), made], ["mark", "ids"]).filter(pa.array(fits))

    rows = chosen.select("mark", "text").mapInArrow(run, "mark long, ids binary").orderBy("mark", "ids").limit(sample_docs).collect()
    samples = sorted(bytes(r.ids) for r in rows if r.ids)
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(max_bytes, max(256, total // 8)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class _Writer:
    """The files of one task attempt, one after another."""

    def __init__(self, folder: str, width: int, digest: bytes) -> None:
        context = TaskContext.get()
        self.store, self.folder = _store(folder)
        self.head = MAGIC + struct.pack("<II", VERSION, width) + digest
        self.stem = f"ids-{context.partitionId():06d}-{{:04d}}-{context.taskAttemptId()}.tok"
        self.written: list[str] = []
        self.out = None

    def add(self, frames: list[bytes], counts: list[int], ids: list[int | None]) -> None:
        if self.out is None:
            self.name = self.stem.format(len(self.written))
            self.written.append(self.name)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
            self.out.write(self.head)
            self.at, self.nulls, self.ids, self.counts, self.offsets = len(self.head), 0, array("q"), array("Q"), array("Q", [len(self.head)])
        self.out.write(b"".join(frames))
        for f in frames:
            self.at += len(f)
            self.offsets.append(self.at)
        self.counts.extend(counts)
        self.nulls += ids.count(None)
        self.ids.extend([i or 0 for i in ids])

    def close(self) -> dict | None:
        """The file's row of the manifest; None if nothing was added."""
        if self.out is None:
            return None
        for table, kind in ((self.ids, "<i8"), (self.offsets, "<u8"), (self.counts, "<u8")):
            self.out.write(np.array(table, kind).tobytes())
        self.out.write(struct.pack("<QQQ", len(self.ids), self.nulls, self.at) + TAIL)
        self.out.close()
        self.out = None
        n, ids = self.nulls, self.ids
        return {"name": self.name, "first": None if n else ids[0], "last": None if n == len(ids) else ids[-1], "docs": len(ids), "ids": sum(self.counts)}

    def discard(self) -> None:
        if self.out is not None:
            self.out.close()
        for name in self.written:
            self.store.delete_file(f"{self.folder}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, sample_docs: int = SAMPLE_DOCS, file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES) -> dict:
    """Write ``docs`` below ``folder`` (a URI that all executors reach); returns the manifest.

    The driver gathers one row per file and, for the dictionary, at most
    ``sample_docs`` serialized documents of bounded size.
    """
    spark, rows = docs.sparkSession, texts(docs)
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    dictionary = train_dictionary(docs, tokenizer_path, count, sample_docs)
    digest = hashlib.sha256(dictionary).digest()
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    _put(f"{folder}/dictionary", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, made = encoder(tokenizer_path), []
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        end = np.array([end_id], f"<u{own.width}").tobytes()
        writer = _Writer(folder, own.width, digest)
        try:
            for batch in pieces(batches, "text", BATCH_BYTES):
                encoded = own.encode(batch.column("text").to_pylist())
                writer.add([press.compress(x + end) for x in encoded], [len(x) // own.width + 1 for x in encoded], batch.column("doc_id").to_pylist())
                if writer.at >= file_bytes:
                    made.append(writer.close())
            made += [f for f in [writer.close()] if f]
        except BaseException:
            writer.discard()
            raise
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("name", pa.string()), *[(c, pa.int64()) for c in ("first", "last", "docs", "ids")]]))

    n = min(MOST_TASKS, max(1, min(partitions(spark), count // LEAST_DOCS), math.ceil(size / task_bytes)))
    order = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(n, order).sortWithinPartitions(order, "text")
    files = sorted(ordered.mapInArrow(run, "name string, first long, last long, docs long, ids long").collect(), key=lambda f: f["name"])
    start, manifest = 0, {"dictionary_sha256": digest.hex(), "tokenizer": tokenizer_path, "files": []}
    for before, f in zip([None, *files], files):
        if before and before["last"] is not None and (f["first"] is None or before["last"] > f["first"]):
            raise RuntimeError("files are not in ascending doc_id order")
        manifest["files"].append({"name": f["name"], "first": f["first"], "last": f["last"], "docs": f["docs"], "start": start})
        start += f["ids"]
    _put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    listed = {f["name"] for f in files}
    for found in store.get_file_info(fs.FileSelector(path)):
        if found.base_name.startswith("ids-") and found.base_name not in listed:
            store.delete_file(found.path)
    return manifest


class TokenFile:
    """One file, read through its index."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        import zstandard

        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, self.nulls, at, tail = struct.unpack("<QQQ4s", self.file.read_at(28, size - 28))
        head = self.file.read_at(44, 0)
        if head[:4] != MAGIC or tail != TAIL or head[12:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file, or made with another dictionary")
        self.kind = f"<u{struct.unpack('<I', head[8:12])[0]}"
        table = self.file.read_at(size - 28 - at, at)
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.offsets = np.frombuffer(table, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(table, "<u8", n, 8 * (2 * n + 1))
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document: one read, one frame."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.expand(self.file.read_at(b - a, a)), self.kind)

    def blocks(self, limit: int = 4 << 20) -> Iterator[list[np.ndarray]]:
        """All documents in order, read in blocks of about ``limit`` bytes."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1)
            a = int(self.offsets[i])
            data = self.file.read_at(int(self.offsets[j]) - a, a)
            yield [np.frombuffer(self.expand(data[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a]), self.kind) for k in range(i, j)]
            i = j


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files: one task per file.

    ``ids`` holds packed little-endian unsigned 32-bit integers; a consumer that
    doesn't select it still has every frame expanded and counted.
    """
    files = [(k, f["name"], f["start"]) for k, f in enumerate(json.loads(_get(f"{folder}/manifest.json"))["files"])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _get(f"{folder}/dictionary")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                file, i = TokenFile(f"{folder}/{name}", dictionary), 0
                for block in file.blocks():
                    packed = [x.astype("<u4").tobytes() for x in block]
                    counts = np.array([len(x) for x in block], np.int64)
                    if (counts != file.counts[i : i + len(block)]).any():
                        raise ValueError(f"{name}: its index and frames differ")
                    starts = start + np.cumsum(counts) - counts
                    null = np.arange(i, i + len(block)) < file.nulls
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[i : i + len(block)], mask=null), pa.array(starts), pa.array(counts), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )
                    i, start = i + len(block), start + int(counts.sum())

    listed = spark.createDataFrame(files, "k int, name string, start long")
    return listed.repartitionById(max(1, len(files)), "k").select("name", "start").mapInArrow(run, schema)


def read_document(folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by the manifest and the file's index."""
    manifest, dictionary = json.loads(_get(f"{folder}/manifest.json")), _get(f"{folder}/dictionary")
    candidates = [f for f in manifest["files"] if f["last"] is not None and (f["first"] is None or f["first"] <= doc_id) and doc_id <= f["last"]]
    if not candidates:
        return None
    file = TokenFile(f"{folder}/{candidates[0]['name']}", dictionary)
    i = file.nulls + int(np.searchsorted(file.doc_ids[file.nulls :], doc_id))
    return file.ids(i) if i < len(file.doc_ids) and file.doc_ids[i] == doc_id else None
