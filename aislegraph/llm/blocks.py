"""Blocks of documents and the exchange of hashed keys between them.

Counting or matching n-grams over a corpus moves one key per distinct n-gram of a block and
bucket, sorted and delta-coded, instead of a row per occurrence. Texts move once: a block holds
about ``block_bytes`` of compressed rows, is dealt by its id and stored, and every later step
joins small replies to it. A key that stands in a third of all documents costs one entry per
block. ``block_bytes`` should grow with the square root of the input (2 MB for gigabytes, 32 MB
for terabytes), so that messages stay long.

Defined cases: a null text has no keys; a text longer than a block is a block of its own; blocks without keys
get no replies; repeated rows are documents each; an empty table has no blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.text import slices
from aislegraph.session import cut_lineage

BLOCK_BYTES = 2_000_000
BUCKET_BYTES = 12_000_000
ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def _zstd():
    import zstandard

    return zstandard


def pack_planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes that are mostly zero cost little."""
    width = values.dtype.itemsize
    return _zstd().ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(_zstd().ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(data, np.uint64), dtype=np.uint64)


def open_block(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(_zstd().ZstdDecompressor().decompress(payload)), ROWS)


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Stored blocks (block, payload), dealt by block, and the number of buckets for their keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data = table.to_batches()[0].serialize().to_pybytes()
            payload = _zstd().ZstdCompressor(level=3).compress(data)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([payload], pa.binary()), pa.array([len(data)])], ["block", "payload", "n_bytes"])

        for batch in slices(batches, limit=block_bytes):
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string())], schema=ROWS)
            if held and size + part.nbytes > block_bytes * 5 // 4:
                yield closed()
                number, held, size = number + 1, [], 0
            held.append(part)
            size += part.nbytes
        if held:
            yield closed()

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, "block long, payload binary, n_bytes long")
    blocks = _dealt(packed)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return blocks.select("block", "payload"), max(4, math.ceil(total / BUCKET_BYTES))


def _dealt(packed: DataFrame) -> DataFrame:
    """Dealt by block and stored. The checkpoint keeps the partitioning, so that later joins move the
    replies alone; a plan under adaptive execution would not tell it."""
    conf = packed.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(packed.repartition(int(conf.get("spark.sql.shuffle.partitions")), "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among the sorted keys (n_buckets + 1)."""
    of = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(n_buckets + 1, dtype=np.uint64))


def exchange(
    state: DataFrame,
    keys_of: Callable[[tuple], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], dict[str, int]]],
    n_buckets: int,
    facts: tuple[str, ...] = (),
) -> DataFrame:
    """``state``: block, payload and earlier replies. ``keys_of`` gives a block's sorted distinct keys
    and their counts; ``answer(keys, counts, bounds)`` sees one bucket's keys of all blocks one after
    the other and gives an array for each block, in the same order, and facts about the bucket.
    Returns block, bucket, reply and the facts (stored)."""
    columns = state.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = keys_of(tuple(row[c] for c in columns[1:]))
                bounds = bucket_bounds(keys, n_buckets)
                used = np.flatnonzero(np.diff(bounds))
                parts = [(slice(bounds[b], bounds[b + 1])) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array([row["block"]] * len(used), pa.int64()), pa.array([pack_sorted(keys[p]) for p in parts], pa.binary()), pa.array([pack_planes(counts[p].astype(np.uint32)) for p in parts], pa.binary())],
                    ["bucket", "block", "keys", "counts"],
                )

    def reply(group: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k.as_py()) for k in group["keys"]]
        counts = [unpack_planes(c.as_py(), np.uint32) for c in group["counts"]]
        bounds = np.cumsum([0, *map(len, keys)])
        answers, found = answer(np.concatenate(keys), np.concatenate(counts), bounds)
        n = len(keys)
        first = [pa.array([found[f]] + [0] * (n - 1), pa.int64()) for f in facts]  # once per bucket
        return pa.table([group["block"], group["bucket"], pa.array([pack_planes(a) for a in answers], pa.binary()), *first], ["block", "bucket", "reply", *facts])

    asked = state.mapInArrow(ask, "bucket int, block long, keys binary, counts binary")
    schema = "block long, bucket int, reply binary" + "".join(f", {f} long" for f in facts)
    return cut_lineage(asked.groupBy("bucket").applyInArrow(reply, schema))


def with_replies(state: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Adds a block's replies as an array in bucket order."""
    per_block = replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply")))["reply"].alias(name))
    return state.join(per_block, "block", "left")


def joined_replies(replies: list[bytes] | None, dtype) -> np.ndarray:
    """All replies to a block, aligned with its sorted keys."""
    return np.concatenate([unpack_planes(r, dtype) for r in replies]) if replies else np.zeros(0, dtype)


def shared_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and the sum of counts of each."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, inverse, np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
