"""Token-id files: independent zstandard frames, a seek table at the end and a checksum per frame.

Layout of a file (all integers little-endian): frames of unsigned 32-bit ids; a skippable frame
with the compressed document index; a skippable frame with the seek table of the public seekable
format (compressed size, decompressed size, low 32 bits of XXH64 for each frame, then number of
frames, descriptor, magic). Any zstandard reader decodes the ids; a reader of this module seeks
to the frames that hold the documents asked for and decompresses no others.

Files are written under a temporary name and renamed, so a task that runs again leaves one file.

Defined cases: a null text is an empty one and has its end id; rows are in ascending doc_id order,
null first, repeated rows one after the other; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislegraph.llm.text import slices, text_buffer
from aislegraph.llm.tokens import piece_tokenizer
from aislegraph.session import cut_lineage

FRAME_IDS = 32_768
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
CHECKED = 0x80  # descriptor bit: entries have checksums


def _low_xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        for at in range(0, len(ids), FRAME_IDS):  # a long document has frames of its own
            part = ids[at : at + FRAME_IDS]
            if self.n_held and self.n_held + len(part) > FRAME_IDS:
                self._flush()
            self.held.append(part)
            self.n_held += len(part)

    def _flush(self) -> None:
        data = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), _low_xxh64(data)))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        known = np.array([d is not None for d in self.docs], dtype="u1")
        ids = np.array([d or 0 for d in self.docs], dtype="<i8")
        index = self.zstd.compress(struct.pack("<Q", len(ids)) + known.tobytes() + ids.tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, _low_xxh64(b"")))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKED, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class TokenFileReader:
    """Reads the seek table and the document index; ids only as they are asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKED:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.checks = table[:, 2]
        index = self.zstd.decompress(self._at(self.packed[-2] + 8, self.packed[-1] - self.packed[-2] - 8))
        n = struct.unpack_from("<Q", index)[0]
        known = np.frombuffer(index, dtype="u1", count=n, offset=8)
        ids = np.frombuffer(index, dtype="<i8", count=n, offset=8 + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(index, dtype="<u8", count=n, offset=8 + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(n))

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = self.zstd.decompress(self._at(self.packed[k], self.packed[k + 1] - self.packed[k]))
            if _low_xxh64(data) != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, data)
        return self._last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        start, stop = 4 * self.starts[i], 4 * (self.starts[i] + self.counts[i])
        k = int(np.searchsorted(self.plain, start, side="right")) - 1
        parts = []
        while start < stop:
            data, base = self._frame(k), self.plain[k]
            parts.append(data[start - base : stop - base])
            start, k = min(stop, self.plain[k + 1]), k + 1
        return np.frombuffer(b"".join(parts), dtype="<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    from aislegraph.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns file_no, file, n_docs, n_tokens (stored)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        tokenizer = piece_tokenizer(tokenizer_path, keep_blanks=False)
        target, end = f"{folder}/part-{number:06d}.ids", np.array([end_id], dtype=np.uint32)
        writer, n = None, 0
        for batch in slices(batches):
            if writer is None:
                store, path = _open(target)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                writer = TokenFileWriter(store.open_output_stream(draft, compression=None))
            tokens, before = tokenizer.encode(*text_buffer(batch.column(1)))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                writer.add(doc_id, np.concatenate([tokens[before[i] : before[i + 1]], end]))
            n += int(before[-1]) + batch.num_rows
        if writer is not None:
            writer.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_pydict({"file_no": [number], "file": [target], "n_docs": [len(writer.docs)], "n_tokens": [n]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut_lineage(ordered.mapInArrow(write, "file_no long, file string, n_docs long, n_tokens long"))


def read_documents(files: DataFrame, doc_ids: list[int] | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of all documents
    in ``files`` (from write_token_files), or of ``doc_ids`` only, whose frames alone are read."""
    wanted = None if doc_ids is None else set(doc_ids)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["file"])
                reader = TokenFileReader(store.open_input_file(path))
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
                for i, doc_id in enumerate(reader.doc_ids):
                    if wanted is None or doc_id in wanted:
                        ids = reader.ids(i)
                        out["doc_id"].append(doc_id)
                        out["start"].append(row["base"] + int(reader.starts[i]))
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                        if keep_ids:
                            out["ids"].append(ids.astype(np.int64))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=False)], list(out))

    # One row per file: the running sum over files is a small, ordered one.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file_no", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, files.count()), "file_no").mapInArrow(read, schema)
