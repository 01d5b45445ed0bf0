"""Best-fit packing of documents into fixed-length token sequences, planned on the length histogram.

The plan works on counts: best-fit in decreasing length over (length, count) pairs, where bins
with the same free space stand in blocks of consecutive sequence ids. Its size depends on the
sequence length alone, never on the number of documents. Pieces then take the planned slots by
joining on their rank within their length; ranks come from counts per (length, salt), so a
length that holds a third of all rows is ranked in many tasks.

Defined cases: a null text is an empty one, which still has its end id and so one piece; repeated
rows are documents of their own; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislegraph.llm.text import slices, text_buffer
from aislegraph.llm.tokens import piece_tokenizer
from aislegraph.session import cut_lineage

SEQUENCE_TOKENS = 2048
ROWS_PER_RANK_TASK = 2_000


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids). A document longer than
    ``limit`` is cut into pieces of ``limit`` tokens from its end, so only the first may be shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(tokenizer_path, keep_blanks=True)
        for batch in slices(batches):
            tokens, before = tokenizer.encode(*text_buffer(batch.column(1)))
            tokens = tokens.astype("<u4")
            end = np.array([end_id], dtype="<u4").tobytes()
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                data = tokens[before[i] : before[i + 1]].tobytes() + end
                n = len(data) // 4
                stop = n % limit or limit
                start = piece = 0
                while start < n:
                    stop = min(stop, n)
                    own = data[4 * start : 4 * stop]
                    row = (doc_id, piece, start, stop - start, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, dtype="<i4")) if keep_ids else row)
                    start, stop, piece = stop, stop + limit, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, rank_from, rank_to, sequence, offset, per_sequence):
    the piece of rank r goes to sequence + (r - rank_from) div per_sequence, at
    offset + ((r - rank_from) mod per_sequence) * length."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # by free space: (first sequence, how many)
    plan, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left, room = 0, counts[length], length
        while left:
            while room < limit and not free[room]:
                room += 1
            if not free[room]:  # room == limit: open as many new sequences as are needed
                need = -(-left // (limit // length))
                free[limit].append((fresh, need))
                fresh += need
            first, bins = free[room].pop()
            each = room // length
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, limit - room, each))
                free[room - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < bins and left:
                plan.append((length, rank, rank + left, first + full, limit - room, left))
                free[room - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < bins:
                free[room].append((first + full, bins - full))
    return plan


def rank_within(rows: DataFrame, key: str, order: list[Column], total: int) -> DataFrame:
    """Adds ``rank_in_key``, 0, 1, ... within each key, without bringing a key's rows into one task."""
    parts = max(1, -(-total // ROWS_PER_RANK_TASK))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy(key, "salt").agg(F.count("*").alias("n")).select(key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    return salted.withColumn("local", local).join(bases, [key, "salt"]).withColumn("rank_in_key", F.col("base") + F.col("local")).drop("salt", "local", "base")


def assign_slots(pieces: DataFrame, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...) of at most ``limit`` tokens.
    ``pieces`` is read twice and should be stored."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    slots = spark.createDataFrame(
        plan_slots(counts, limit), "length long, rank_from long, rank_to long, first_sequence long, first_offset long, per_sequence long"
    )
    ranked = rank_within(pieces, "length", [F.col("doc_id"), F.col("piece")], sum(counts.values()))
    nth = F.col("rank_in_key") - F.col("rank_from")
    return (
        ranked.join(slots, "length")
        .where((F.col("rank_in_key") >= F.col("rank_from")) & (F.col("rank_in_key") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(nth / F.col("per_sequence")))
        .withColumn("offset", F.col("first_offset") + (nth % F.col("per_sequence")) * F.col("length"))
        .drop("rank_in_key", "rank_from", "rank_to", "first_sequence", "first_offset", "per_sequence")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    pieces = cut_lineage(tokenize_pieces(docs, tokenizer_path, limit, end_id, keep_ids))
    return assign_slots(pieces, limit)


