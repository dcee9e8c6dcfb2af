"""Token-ID output (operator 5): files of independent zstandard frames with a seek table at the end.

A file is a run of standard zstandard frames, each holding the ids of whole documents and standing for itself, then a
skippable frame with the index of documents, then a skippable frame with the seek table: sizes and checksum of every frame, and a
footer of fixed length. A reader takes the footer, the table and the index, and decompresses only frames that hold a requested
document; each frame is checked against its XXH64 checksum when it is read. Any zstandard tool can decompress the files.

Documents are dealt to files by ranges of the id, encoded and written by the task that holds the range. A task writes
under a name of its own and reports it; only names in the manifest count, so a task that is lost and run again, or twice at once,
leaves at most an orphan. All files go to the shared folder through its own file system.

Edge cases: a null text counts as empty and gives one id, the end id; null ids come first; repeated ids are told apart by the
text's hash, equal rows follow one another; an empty table gives no file; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import chunked
from .common import bounded_batches, shared_path, strips, text_of, written

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 65_536
#: UTF-8 bytes of text that go to one file, on average, and what a document counts beside its text: its row of the file's index is held until the end.
FILE_BYTES, ROW_BYTES = 32 << 20, 32


class Encoder:
    """The tokenizers library, given each distinct chunk of a batch once, all of them as one text.

    Every chunk of that text but the first begins with its only blank, so a token that begins with a blank begins a chunk.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.leads = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.leads[i] = token.startswith("\u0120")  # the file's character for a blank

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for lo, hi in strips(texts):  # the library's own results are large
            out += [np.array(e.ids, dtype=self.dtype) for e in self.library.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
        return out

    def led(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks that begin with a blank: arrays of ids of runs of chunks, as one text each."""
        return self.raw(["".join(chunks[lo:hi]) for lo, hi in strips(chunks, 1 << 18)])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        c = chunked(texts, self.special)
        runs = self.led(c.chunks[: c.n_led])
        led = np.concatenate(runs) if runs else np.zeros(0, dtype=self.dtype)
        starts = np.flatnonzero(self.leads[led])
        if len(starts) != c.n_led:
            raise ValueError("the vocabulary joins chunks over blanks")
        own = self.raw(c.chunks[c.n_led :])
        ids = np.concatenate([led, *own])
        lens = np.concatenate([np.diff(np.append(starts, len(led))), np.array([len(x) for x in own], dtype=np.int64)])
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        n = lens[c.codes]
        ends = np.cumsum(n)
        data = ids[np.repeat(starts[c.codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[c.bounds]
        out: list[Any] = [b""] * len(texts)
        for i, lo, hi in zip(c.rows.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = data[lo:hi].tobytes()
        if len(c.whole):
            for i, x in zip(c.whole.tolist(), self.raw([t or "" for t in texts.take(pa.array(c.whole)).to_pylist()]), strict=True):
                out[i] = x.tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    return Encoder(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class TokenWriter:
    """Writes one file, document by document."""

    def __init__(self, out: Any, dtype: np.dtype):
        self.out, self.dtype, self.held, self.held_ids = out, dtype, [], 0
        self.frames: list[tuple[int, int, int]] = []  # compressed size, size, checksum
        self.index = [array(t) for t in "qBIII"]  # id, null, frame, offset, length
        self.total = 0
        self.press = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        if n >= FRAME_IDS:
            self.flush()
        for column, value in zip(self.index, (doc_id or 0, doc_id is None, len(self.frames), self.held_ids, n), strict=True):
            column.append(value)
        self.held.append(ids)
        self.held_ids += n
        self.total += n
        if self.held_ids >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            frame = self.press.compress(data)
            self.out.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.held_ids = [], 0

    def close(self) -> None:
        self.flush()
        body = struct.pack("<QB", len(self.index[0]), self.dtype.itemsize) + b"".join(np.array(c, dtype=t).tobytes() for c, t in zip(self.index, ("<i8", "u1", "<u4", "<u4", "<u4"), strict=True))
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        entries = [*self.frames, (len(body) + 8, 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class TokenReader:
    """Reads documents of one file by their place, a frame at a time."""

    def __init__(self, source: Any):
        self.source, end = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.frames, self.starts = table[:-1], starts[:-1]
        body = self._at(int(starts[-2]) + 8, int(table[-1, 0]) - 8)
        k, self.width = struct.unpack_from("<QB", body)
        at = 9
        cols = []
        for t in ("<i8", "u1", "<u4", "<u4", "<u4"):
            cols.append(np.frombuffer(body, dtype=t, count=k, offset=at))
            at += k * np.dtype(t).itemsize
        self.ids, self.nulls, self.frame, self.offset, self.length = cols
        self.open_frame, self.data, self.decompressed = -1, b"", 0

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        f = int(self.frame[i])
        if f != self.open_frame:
            csize, size, check = map(int, self.frames[f])
            self.data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[f]), csize), max_output_size=size)
            if xxhash.xxh64_intdigest(self.data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} is damaged")
            self.open_frame, self.decompressed = f, self.decompressed + 1
        start = int(self.offset[i]) * self.width
        return np.frombuffer(self.data, dtype=f"<u{self.width}", count=int(self.length[i]), offset=start)


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns their manifest, itself a table in shared storage: part, path, n_docs, n_ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_path(spark, "token-files")
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)) + ROW_BYTES)).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), "id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part = encoder(tokenizer), None, None
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                part = batch.column(0)[0].as_py()
                path = f"{folder}/part-{part:08d}-{uuid.uuid4().hex}.tok.zst"
                fs, at = file_system(path)
                fs.create_dir(os.path.dirname(at), recursive=True)
                out = fs.open_output_stream(at, compression=None)
                writer = TokenWriter(out, enc.dtype)
            for doc_id, ids in zip(batch.column(1).to_pylist(), enc.encode(batch.column(2)), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.index[0])], "n_ids": [writer.total]})

    return written(spark, rows.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32[, ids]."""
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per file
    files = manifest.withColumn("first", F.sum("n_ids").over(before) - F.col("n_ids")).select("path", "first")
    files = files.repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = file_system(path)
                with fs.open_input_file(at) as source:
                    reader = TokenReader(source)
                    for lo in range(0, len(reader), 1000):
                        got = {id_col: [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                        for i in range(lo, min(lo + 1000, len(reader))):
                            ids = reader.document(i).astype("<u4")
                            got[id_col].append(None if reader.nulls[i] else int(reader.ids[i]))
                            got["start"].append(start)
                            got["n_tokens"].append(len(ids))
                            got["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                            if with_ids:
                                got["ids"].append(ids.astype(np.int32))
                            start += len(ids)
                        types = {id_col: pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
                        yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in got.items()], list(got))

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.mapInArrow(read, schema)
