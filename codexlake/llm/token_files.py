"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds documents in ascending order of doc_id. Layout, all integers little-endian:

* data frames: the ids of whole documents, unsigned, 2 or 4 bytes each; a frame ends with the document that brings it to FRAME_BYTES;
* a skippable frame (0x184D2A5D): a zstandard frame with the directory in rows of four longs, first (width of an id, documents, 0, 0), then
  (doc_id or the smallest long, frame, offset in ids, ids) for each document;
* a skippable frame (0x184D2A5E): the seek table in the public seekable layout, (compressed bytes, bytes, xxh64's low 32 bits) for each frame before it (the directory's
  holds 0 bytes), then the number of frames, the descriptor byte 0x80 (there are checksums) and the magic 0x8F92EAB1.

Readers take the seek table from the file's end, then the directory, and decompress no frame but those of the documents asked for. An id that doesn't fit the width is an error.
A null doc_id comes first; rows with equal ids are ordered by text and stay separate documents; a null text is empty and has the
end id alone. Task retries write files of their own and only a file that a finished task names is read, so lost executors do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexlake.llm.common import shared_dir, table, text_or_empty, written
from codexlake.llm.tokens import tokenizer, vocabulary_path

FRAME_BYTES = 1 << 18
DIRECTORY_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
NO_ID, CHECKSUMS = -(1 << 63), 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
SKIPPABLE = struct.Struct("<II")


def open_store(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes one file; documents come in order."""

    def __init__(self, uri: str, width: int = 2, level: int = 3) -> None:
        import zstandard

        store, path = open_store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = store.open_output_stream(path, compression=None)
        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._width, self._frames, self._entries, self._held, self._held_ids = width, [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self._width):
            raise ValueError(f"id {int(ids.max())} doesn't fit {self._width} bytes")
        self._entries.append((NO_ID if doc_id is None else doc_id, len(self._frames), self._held_ids, len(ids)))
        self._held.append(ids.astype(f"<u{self._width}").tobytes())
        self._held_ids += len(ids)
        if self._held_ids * self._width >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if self._held:
            raw = b"".join(self._held)
            packed = self._zstd.compress(raw)
            self._out.write(packed)
            self._frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._held, self._held_ids = [], 0

    def close(self) -> None:
        self._flush()
        directory = self._zstd.compress(np.array([(self._width, len(self._entries), 0, 0), *self._entries], dtype="<i8").tobytes())
        self._out.write(SKIPPABLE.pack(DIRECTORY_MAGIC, len(directory)) + directory)
        frames = [*self._frames, (SKIPPABLE.size + len(directory), 0, 0)]
        body = b"".join(ENTRY.pack(*x) for x in frames) + FOOTER.pack(len(frames), CHECKSUMS, FOOTER_MAGIC)
        self._out.write(SKIPPABLE.pack(TABLE_MAGIC, len(body)) + body)
        self._out.close()


class TokenFileReader:
    """Random access to a file's documents; only frames that are asked for are decompressed, and checked against their sums."""

    def __init__(self, uri: str) -> None:
        import zstandard

        store, path = open_store(uri)
        self._in = store.open_input_file(path)
        self._zstd = zstandard.ZstdDecompressor()
        size = self._in.size()
        n, descriptor, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or not descriptor & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums")
        at = size - FOOTER.size - n * ENTRY.size
        self._frames = list(ENTRY.iter_unpack(self._at(at, n * ENTRY.size)))[:-1]
        self._starts = np.concatenate([[0], np.cumsum([x[0] for x in self._frames], dtype=np.int64)]).astype(np.int64)
        magic, length = SKIPPABLE.unpack(self._at(int(self._starts[-1]), SKIPPABLE.size))
        if magic != DIRECTORY_MAGIC:
            raise ValueError(f"{uri}: no directory")
        rows = np.frombuffer(self._zstd.decompress(self._at(int(self._starts[-1]) + SKIPPABLE.size, length)), dtype="<i8").reshape(-1, 4)
        self._width, self.directory = int(rows[0, 0]), rows[1:]
        self.frames_read = 0

    def _at(self, start: int, length: int) -> bytes:
        self._in.seek(start)
        return self._in.read(length)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        packed, size, check = self._frames[k]
        raw = self._zstd.decompress(self._at(int(self._starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: its checksum differs")
        self.frames_read += 1
        return np.frombuffer(raw, dtype=f"<u{self._width}")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the directory's rows, all if none are named."""
        held, ids = -1, None
        for r in range(len(self.directory)) if rows is None else rows:
            doc_id, k, start, n = map(int, self.directory[r])
            if k != held:
                held, ids = k, self.frame(k)
            yield None if doc_id == NO_ID else doc_id, ids[start : start + n]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document with this id."""
        return [ids for _, ids in self.documents(np.flatnonzero(self.directory[:, 0] == doc_id))]

    def close(self) -> None:
        self._in.close()


def write_tokens(docs: DataFrame, where: str, path: str, spaces_kept: bool, end_id: int, width: int = 2) -> DataFrame:
    """The files of docs (doc_id, text), as a manifest: part (in the order of doc_id), uri, docs, tokens."""
    from pyspark import TaskContext

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, out, docs, tokens = f"{where}/files/{part:06d}-{uuid.uuid4().hex}.zst", None, 0, 0
        for b in batches:
            doc_ids, texts = (b.column(k).to_pylist() for k in (0, 1))
            for doc_id, ids in zip(doc_ids, tokenizer(path, spaces_kept).ids(texts), strict=True):
                out = out or TokenFileWriter(uri, width)
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
                docs, tokens = docs + 1, tokens + len(ids) + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [docs], "tokens": [tokens]})

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, uri string, docs long, tokens long"), where, "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document, in its file's order: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = TokenFileReader(uri), []
                for doc_id, ids in reader.documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _rows(rows)

    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("start"))
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(names))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents written as token files and read back from them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_tokens(write_tokens(docs, shared_dir(spark), vocabulary_path("byte_bpe_50k.json"), spaces_kept=True, end_id=0))
