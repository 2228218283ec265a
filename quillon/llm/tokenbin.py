"""Token-id files with Elias-Fano document boundaries.

Format of one file (all numbers little-endian):

  blocks   zstd frames, each of `BLOCK` ids of 2 or 4 bytes, one after another
  ids      zstd frame of the documents' ids as int64 differences
  bounds   Elias-Fano code of the documents' end positions in the id array:
           low bits packed, high bits in unary, one select sample per 256 ones
  footer   JSON: counts, id width, frame offsets, the code's parameters
  tail     footer length (uint32) and the magic bytes

A boundary costs about 2 + log2(ids / documents) bits; `EliasFano.select` finds
any offset from a sample and a short scan, without a table of 64-bit offsets.

Documents are dealt by ranges of doc_id, sorted within each range, tokenized and
streamed to files in the shared folder. A task writes under a name of its own
and hands back a manifest row at its end, so the files of lost or repeated
attempts are never read. The driver holds the manifest only (a row per file).

Texts are tokenized by their white-space-free pieces, each once per worker while it
is kept, and looked up once for some 4 MB of texts: for a tokenizer that drops
white space and never joins across it, this equals encoding the whole text
(tests compare them).

Edge cases: null and empty texts hold the end id only; repeated doc_ids are
documents of their own, ordered by text; null doc_ids come first; an empty table
writes no file and gives no rows; the text's length is not limited.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, in_arrow, pieces, scratch, table, text_slices, width

MAGIC = b"EFTOKEN1"
BLOCK = 1 << 16
SAMPLE = 256
CACHED = 300_000
TRAILING, LOWER, WHITE = (np.isin(np.arange(256), list(x)) for x in (b"!#$%&*,.:;?|", bytes(range(97, 123)), b" \t\n\r\f\v"))


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<i8"))

    def all(self) -> np.ndarray:
        n, bits = self.count, self.low_bits
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
        return ((ones - np.arange(n)) << bits) + (low.astype(np.int64) << np.arange(bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, scan the high bits to the i-th one; then add its low bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            low |= (self.low[k // 8] >> (k % 8) & 1) << b
        return (one - i << self.low_bits) + low


class ChunkTokenizer:
    """Ids of a text as bytes of a fixed width, from its pieces' ids.

    For tokenizers that lower-case, drop white space and never join letters with
    punctuation, the text may be lower-cased and trailing punctuation set apart
    beforehand: fewer distinct pieces. Neither is done where it could matter
    (special tokens; combining marks, which upper-case letters may not compose with).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        ends = [(i, t) for t, i in self.tokenizer.get_vocab().items()]
        self.is_end = np.zeros(max(i for i, _ in ends) + 1, bool)
        self.is_end[[i for i, t in ends if t.endswith("</w>")]] = True

    def split(self, texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
        """(the pieces of all texts in order, the number of pieces before each text and after the last)."""
        odd = [i for i, t in enumerate(texts) if t and (b"<|" in t or b"\xcc" in t or b"\xcd" in t)]
        raw = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).translate(UPPER_TO_LOWER), np.uint8)
        bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        if odd:
            raw = raw.copy()
            for i in odd:
                raw[bounds[i] : bounds[i + 1] - 1] = np.frombuffer(texts[i], np.uint8)
        mark = TRAILING[raw]
        edges = np.flatnonzero(mark[1:] != mark[:-1]) + 1  # runs of punctuation: starts, ends
        if len(mark) and mark[0]:
            edges = edges[1:]  # a run that nothing precedes
        starts, ends = edges[::2], edges[1::2]
        starts = starts[LOWER[raw[starts - 1]] & WHITE[raw[ends]]]
        if odd:
            starts = starts[~np.isin(np.searchsorted(bounds, starts, "right") - 1, odd)]
        word = ~WHITE[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[starts] = True
        data, offsets = raw[word], np.flatnonzero(first[word])
        return _binary(data, np.append(offsets, len(data))), np.searchsorted(np.flatnonzero(first), bounds)

    def learn(self, new: set[bytes]) -> None:
        """Words of letters are encoded many to a call and told apart by their word ends; other pieces one by one."""
        words, rest = [], []
        for x in new:
            (words if x.isalpha() or ((s := x.decode()).isalpha() and s.lower().isalpha()) else rest).append(x)
        for k in range(0, len(words), 1 << 13):
            parts = [words[i : i + 512] for i in range(k, min(k + (1 << 13), len(words)), 512)]
            for some, e in zip(parts, self._batch([b" ".join(some) for some in parts]), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self.is_end[ids]) + 1
                if len(ends) != len(some):
                    rest += some
                    continue
                data, at = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *at], at)), strict=True))
        for k in range(0, len(rest), 10_000):
            some = rest[k : k + 10_000]
            for x, e in zip(some, self._batch(some), strict=True):
                self.known[x] = np.array(e.ids, self.dtype).tobytes()

    def _batch(self, texts: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Each distinct piece of the texts is looked up once; Arrow finds the distinct ones and lays out their ids."""
        chunks, bounds = self.split(texts)
        if not len(chunks):
            return [b""] * len(texts)
        coded = chunks.dictionary_encode()
        flat = _values(coded.dictionary)
        ids = list(map(self.known.get, flat))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = {flat[k] for k in missing}
            found = {x: i for x in new if (i := self.before.get(x)) is not None}
            self.known |= found
            self.learn(new.difference(found))
            for k in missing:
                ids[k] = self.known[flat[k]]
            if len(self.known) > CACHED:  # words in use will come back from the generation before
                self.before, self.known = self.known, {}
        laid = _binary(b"".join(ids), np.cumsum([0, *map(len, ids)])).take(coded.indices)
        return _values(_binary(laid.buffers()[2], np.frombuffer(laid.buffers()[1], np.int64)[bounds]))


def _binary(data, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data if data is not None else b"")])


def _values(column: pa.Array) -> list[bytes]:
    """A whole large_binary array's values, without a scalar object for each."""
    _, offsets, data = column.buffers()
    data, at = data.to_pybytes(), np.frombuffer(offsets, np.int64)[: len(column) + 1].tolist()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


@functools.cache
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One per worker process, kept between its tasks."""
    return ChunkTokenizer(path)


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, folder: str, dtype: np.dtype):
        self.uri = f"{folder}/{uuid.uuid4().hex}.eft"
        self.fs, self.path = _filesystem(self.uri)
        self.out = self.fs.open_output_stream(self.path)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.dtype, self.held, self.n_ids = dtype, bytearray(), 0
        self.frames, self.docs, self.ends, self.at = [], [], [], 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held += ids
        self.n_ids += len(ids) // self.dtype.itemsize
        self.docs.append(doc_id)
        self.ends.append(self.n_ids)
        size = BLOCK * self.dtype.itemsize
        if len(self.held) >= size:
            whole = len(self.held) // size * size
            for k in range(0, whole, size):
                self.frames.append(self._put(self.zip.compress(bytes(self.held[k : k + size]))))
            del self.held[:whole]

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self.frames.append(self._put(self.zip.compress(bytes(self.held))))
        nulls = [i for i, d in enumerate(self.docs) if d is None]
        docs = np.array([d or 0 for d in self.docs], np.int64)
        code = EliasFano.encode(np.array(self.ends, np.int64))
        meta = {"n_docs": len(docs), "n_ids": self.n_ids, "id_bytes": self.dtype.itemsize, "frames": self.frames, "nulls": nulls, "low_bits": code.low_bits}
        parts = {"docs": self.zip.compress(np.diff(docs, prepend=0).astype("<i8").tobytes()), "low": code.low, "high": code.high, "samples": code.samples.tobytes()}
        for name, data in parts.items():
            meta[name] = [self.at, len(data)]
            self._put(data)
        footer = json.dumps(meta).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        return self.uri, len(docs), self.n_ids


class Reader:
    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        (n,) = struct.unpack("<I", tail[:4])
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        part = lambda k: self.file.read_at(self.meta[k][1], self.meta[k][0])
        self.unzip = zstandard.ZstdDecompressor()
        self.docs = np.cumsum(np.frombuffer(self.unzip.decompress(part("docs")), "<i8")).tolist()
        for i in self.meta["nulls"]:
            self.docs[i] = None
        self.bounds = EliasFano(self.meta["n_docs"], self.meta["low_bits"], part("low"), part("high"), np.frombuffer(part("samples"), "<i8"))
        self.dtype = np.dtype(f"<u{self.meta['id_bytes']}")
        self.offsets = np.append(0, np.cumsum(self.meta["frames"]))

    def block(self, k: int) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(self.file.read_at(self.meta["frames"][k], int(self.offsets[k]))), self.dtype)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, self.dtype)
        whole = np.concatenate([self.block(k) for k in range(start // BLOCK, (end - 1) // BLOCK + 1)])
        return whole[start - start // BLOCK * BLOCK :][: end - start]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order, one block at a time."""
        ends, at, k, held = self.bounds.all().tolist(), 0, 0, np.empty(0, self.dtype)
        for doc, end in zip(self.docs, ends, strict=True):
            parts, size = [held], len(held)
            while size < end - at:
                parts.append(self.block(k))
                size += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, at, held[: end - at]
            held, at = held[end - at :], end


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_ids: int = 1 << 26) -> DataFrame:
    """The manifest (part, file, uri, n_docs, n_ids), in ascending order of doc_id by part and file; writing happens in its evaluation, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, done = None, None, []
        for batch in batches:
            coder = coder or tokenizer_of(tokenizer)
            end = np.array([end_id], coder.dtype).tobytes()
            for i, j in pieces(batch.column("text")):
                texts = list(text_slices(batch.column("text").slice(i, j - i)))
                for doc, ids in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), coder.encode(texts), strict=True):
                    writer = writer or Writer(folder, coder.dtype)
                    writer.add(doc, ids + end)
                    if writer.n_ids >= file_ids:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        if done:
            part = TaskContext.get().partitionId()
            uri, n_docs, n_ids = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array(uri), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], ["part", "file", "uri", "n_docs", "n_ids"])

    spark = documents.sparkSession
    fs, path = _filesystem(folder)
    fs.create_dir(path)
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return in_arrow(ordered, run, "part long, file long, uri string, n_docs long, n_ids long")


def read_ids(spark: SparkSession, manifest: list, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start in the whole id array, n_tokens, ids_crc32 and, if asked for, ids.

    manifest: collected rows of write_ids.
    """
    rows, base = [], 0
    for r in sorted(manifest, key=lambda r: (r.part, r.file)):
        rows.append((r.uri, base))
        base += r.n_ids
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                held, size = [], 0
                for doc, at, ids in Reader(uri).documents():
                    held.append((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype("<i4")] if with_ids else [])))
                    size += len(ids) if with_ids else 1
                    if size >= 1 << 16:
                        yield _rows(held, with_ids)
                        held, size = [], 0
                if held:
                    yield _rows(held, with_ids)

    files = spark.createDataFrame(rows, "uri string, base long")
    return in_arrow(files.repartition(max(1, min(len(rows), 4 * width(spark)))), run, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")


def _rows(held: list, with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_rows(documents: DataFrame) -> DataFrame:
    """Write all documents and read the files back."""
    spark = documents.sparkSession
    return read_ids(spark, write_ids(documents, scratch(spark, "ids"), tokenizer_path()).collect())


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))
