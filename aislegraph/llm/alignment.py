"""Alignment of two tokenizers' tokens over the same text, with corpus-wide link counts.

The ends of a text's A tokens and B tokens, as byte offsets, are two sorted lists. Their merge is divided
into pieces of PIECE ends by binary searches on the diagonals (merge path), so every piece has the same
work whatever the tokens, and pieces are merged on their own: each gives its overlaps (the A and the
B token that cover the bytes before each end) and where both end. A group runs from one common end to the
next; pieces are stitched by counting the common ends of those before.

Documents are read in blocks of about ``block_bytes``. A block is stored with its documents' linked id
pairs and how often each is linked; its distinct pairs, with the number of its documents that hold them, are
added up by Spark (one row per pair and block, so a pair that stands in every document costs one row per
block), the highest count of each A id is taken, and a block gets back the counts of its own pairs by an
equi-join. Nothing is broadcast and no text is tokenized twice.

Defined cases: a text that is null or empty, or whose tokens' joined bytes differ from a space and the text,
has no tokens: zeros and an empty digest; special tokens' strings are plain text; rows with a null or a repeated
doc_id are documents of their own; a very long text is cut into parts of LINKS links; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.blocks import pack_planes, pack_sorted, unpack_planes, unpack_sorted
from aislegraph.llm.text import ragged, slices, text_buffer
from aislegraph.llm.tokens import PieceTokenizer, byte_letters
from aislegraph.session import cut_lineage

PIECE = 4_096
LINKS = 4_000_000
BLOCK_BYTES = 6_000_000
SLICE_BYTES = 1_000_000
BLANK_MARK = "▁"
U64 = np.uint64


def split_points(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many A ends and B ends lie before each piece (and after the last): one binary search a diagonal.

    An A end goes before an equal B end, and equal ends stay in one piece."""
    n, m = len(a_ends), len(b_ends)
    if not n or not m:
        return np.array([0, n]), np.array([0, m])
    diagonal = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        more = open_ & (a_ends[np.minimum(middle, n - 1)] <= b_ends[np.clip(diagonal - middle - 1, 0, m - 1)])
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    i, j = low, diagonal - low
    j += (i > 0) & (j < m) & (a_ends[np.maximum(i, 1) - 1] == b_ends[np.minimum(j, m - 1)])
    return i, j


def merge_piece(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece in order: its A token, its B token (counted from the piece's first), and whether both end there."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    both = (a < len(a_ends)) & (b < len(b_ends))
    both[both] = a_ends[a[both]] == b_ends[b[both]]
    return a, b, both


def merge_ends(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The last A token and the last B token of each group. Both lists end at the same place."""
    i, j = split_points(a_ends, b_ends, piece)
    last_a, last_b = [], []
    for p in range(len(i) - 1):
        a, b, both = merge_piece(a_ends[i[p] : i[p + 1]], b_ends[j[p] : j[p + 1]])
        # A group that is open at the piece's end is closed by the first common end of a later piece.
        last_a.append(a[both] + i[p])
        last_b.append(b[both] + j[p])
    return np.concatenate(last_a), np.concatenate(last_b)


class TokenBytes:
    """Bytes of every id of a vocabulary, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.sizes[ids])]


class TokenPair:
    """Both tokenizers of a worker: A over a space and the text, B over the text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = PieceTokenizer(a_path, keep_blanks=True)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(letter): byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            entries[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.a_bytes = TokenBytes(entries)
        pieces = [(number, self.b.id_to_piece(number)) for number in range(self.b.get_piece_size())]
        self.b_bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(number) else p.replace(BLANK_MARK, " ").encode() for number, p in pieces])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Ids and tokens before each text, of A and of B, and which texts have tokens."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        spaced = np.full(len(buf) + n, ord(" "), dtype=np.uint8)
        begin = offsets + np.arange(n + 1)
        spaced[ragged(begin[:-1] + 1, sizes)] = buf
        a, a_before = self.a.encode(spaced, begin)
        data = buf.tobytes()
        found = self.b.encode([data[offsets[i] : offsets[i + 1]].decode() for i in range(n)], num_threads=1)
        b_before = np.cumsum([0, *map(len, found)])
        b = np.fromiter((x for ids in found for x in ids), dtype=np.int64, count=b_before[-1])
        good = (sizes > 0) & self._equal(self.a_bytes, a, a_before, spaced, begin) & self._equal(self.b_bytes, b, b_before, spaced, begin)
        return (a.astype(np.int64), a_before), (b, b_before), good

    @staticmethod
    def _equal(table: TokenBytes, ids: np.ndarray, before: np.ndarray, spaced: np.ndarray, begin: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(table.sizes[ids])])[before]
        same = np.diff(at) == np.diff(begin)
        if same.all():
            differs = np.flatnonzero(table.joined(ids) != spaced)
            same[np.searchsorted(begin, differs, side="right") - 1] = False
            return same
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(table.joined(ids[before[i] : before[i + 1]]), spaced[begin[i] : begin[i + 1]])
        return same


_OPEN: dict[tuple[str, str], TokenPair] = {}


def token_pair(a_path: str, b_path: str) -> TokenPair:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _OPEN[a_path, b_path] = TokenPair(a_path, b_path)
    return _OPEN[a_path, b_path]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(U64) << U64(32)) | b.astype(U64)


def linked_pairs(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc: np.ndarray, limit: int = LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, key and number of links of every distinct id pair of each document. ``doc``: of each group, ascending."""
    a_size, b_size = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    a_first, b_first = last_a + 1 - a_size, last_b + 1 - b_size
    links, parts = a_size * b_size, []
    heavy = links > limit
    for g in np.flatnonzero(heavy).tolist():
        one, many_a = np.unique(a[a_first[g] : last_a[g] + 1], return_counts=True)
        two, many_b = np.unique(b[b_first[g] : last_b[g] + 1], return_counts=True)
        step = max(1, limit // len(two))
        for at in range(0, len(one), step):
            keys = pair_keys(np.repeat(one[at : at + step], len(two)), np.tile(two, len(one[at : at + step])))
            parts.append((np.full(len(keys), doc[g]), keys, np.outer(many_a[at : at + step], many_b).ravel()))
    rest = np.flatnonzero(~heavy)
    cuts = np.searchsorted(np.cumsum(links[rest]), np.arange(limit, int(links[rest].sum()) + limit, limit), side="right") if len(rest) else []
    at = 0
    for stop in cuts:
        g = rest[at : max(int(stop), at + 1)]
        at += len(g)
        if not len(g):
            continue
        # Every A token of a group with every B token of it.
        rows = ragged(a_first[g], a_size[g])
        own = np.repeat(g, a_size[g])
        key = pair_keys(np.repeat(a[rows], b_size[own]), b[ragged(b_first[own], b_size[own])])
        of = np.repeat(doc[g], links[g])
        parts.append(merged(of, key, np.ones(len(key), dtype=np.int64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none
    return merged(*(np.concatenate(x) for x in zip(*parts, strict=True))) if len(parts) > 1 else merged(*parts[0])


def merged(doc: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (doc, key) as one."""
    order = np.lexsort((key, doc))
    doc, key, count = doc[order], key[order], count[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.add.reduceat(count, at) if len(at) else count


def group_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, in order."""
    a_size, b_size = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(last_a)), a_size), np.repeat(np.arange(len(last_b)), b_size)
    ids, mark = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[np.arange(len(a)) + (last_b + 1 - b_size)[group_a]] = a
    ids[np.arange(len(b)) + (last_a + 1)[group_b]] = b
    mark[last_a + last_b + 1 - b_size] = ord("|")
    mark[last_a + last_b + 1] = ord(";")
    width = len(str(int(ids.max())))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + ord("0")
    shown = ids[:, None] >= 10 ** np.arange(width - 1, -1, -1)
    shown[:, -1] = True
    rows = np.concatenate([digits.astype(np.uint8), mark[:, None]], 1)
    return rows[np.concatenate([shown, np.ones((len(ids), 1), dtype=bool)], 1)].tobytes()[:-1]


DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])


def aligned_slice(batch: pa.RecordBatch, pair: TokenPair) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The documents of a slice with what they alone tell, and their pairs (key, number of links) one after the other."""
    buf, offsets = text_buffer(batch.column(1))
    (a, a_before), (b, b_before), good = pair.encode(buf, offsets)
    n = batch.num_rows
    if not good.all():  # tokens of the other texts are dropped
        a, b = a[np.repeat(good, np.diff(a_before))], b[np.repeat(good, np.diff(b_before))]
        a_before, b_before = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (a_before, b_before))
    last_a, last_b = merge_ends(np.cumsum(pair.a_bytes.sizes[a]), np.cumsum(pair.b_bytes.sizes[b])) if len(a) else (np.zeros(0, np.int64),) * 2
    groups_before = np.searchsorted(last_a, a_before)
    doc_of = np.repeat(np.arange(n), np.diff(groups_before))
    links = np.diff(last_a, prepend=-1) * np.diff(last_b, prepend=-1)
    doc, key, count = linked_pairs(a, b, last_a, last_b, doc_of)
    digests = [""] * n
    for i in np.flatnonzero(good).tolist():
        g = slice(groups_before[i], groups_before[i + 1])
        digests[i] = hashlib.sha256(group_text(a[a_before[i] : a_before[i + 1]], b[b_before[i] : b_before[i + 1]], last_a[g] - a_before[i], last_b[g] - b_before[i])).hexdigest()
    n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[groups_before])
    columns = [batch.column(0), *(pa.array(x) for x in (np.diff(a_before), np.diff(b_before), np.diff(groups_before), n_links)), pa.array(digests, pa.string()), pa.array(np.bincount(doc, minlength=n))]
    return pa.Table.from_arrays(columns, schema=DOCS), key, count


def align_blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored blocks: block, rows (documents), keys (sorted distinct pairs), held (documents with each), places (pair number of
    each document's pairs) and counts (their links), all packed but for the keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        number, tables, keys, counts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def closed() -> pa.RecordBatch:
            every = np.concatenate(keys)
            distinct, place, held = np.unique(every, return_inverse=True, return_counts=True)
            rows = pa.concat_tables(tables).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DOCS) as writer:
                writer.write_table(rows)
            packed = pack_planes(np.frombuffer(sink.getvalue(), dtype=np.uint8))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), *(pa.array([x], pa.binary()) for x in (packed, pack_sorted(distinct), pack_planes(held.astype(np.uint32)), pack_planes(place.astype(np.uint32)), pack_planes(np.concatenate(counts).astype(np.int64))))],
                ["block", "rows", "keys", "held", "places", "counts"],
            )

        for batch in slices(batches, limit=SLICE_BYTES):
            table, key, count = aligned_slice(batch, pair)
            tables.append(table)
            keys.append(key)
            counts.append(count)
            size += batch.column(1).nbytes
            if size >= block_bytes:
                yield closed()
                number, tables, keys, counts, size = number + 1, [], [], [], 0
        if tables:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut_lineage(rows.mapInArrow(work, "block long, rows binary, keys binary, held binary, places binary, counts binary"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """A row for each block and distinct pair: block, a, b, docs."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack_sorted(row["keys"])
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    held = unpack_planes(row["held"], np.uint32)[at : at + 100_000]
                    columns = [pa.array(np.full(len(part), row["block"])), pa.array((part >> U64(32)).astype(np.int32)), pa.array((part & U64(0xFFFFFFFF)).astype(np.int32)), pa.array(held.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "a", "b", "docs"])

    return blocks.select("block", "keys", "held").mapInArrow(unpack, "block long, a int, b int, docs long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best (no pair of the same A id has more)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    blocks = align_blocks(docs, a_path, b_path, block_bytes)
    pairs = block_pairs(blocks)
    told = pairs.select("block", "a", "b").join(cut_lineage(link_counts(pairs)), ["a", "b"])
    # A block's pairs are bounded by its bytes.
    replies = told.groupBy("block").agg(F.collect_list(F.struct("a", "b", "n", "best")).alias("told"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, places, counts, told = (batch.column(c)[i] for c in range(4))
                table = pa.ipc.open_stream(unpack_planes(rows.as_py(), np.uint8).tobytes()).read_all()
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if told.is_valid and len(told):
                    answers = told.values
                    key = pair_keys(answers.field("a").to_numpy(), answers.field("b").to_numpy())
                    order = np.argsort(key)
                    n = answers.field("n").to_numpy()[order]
                    best = answers.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                place, links = unpack_planes(places.as_py(), np.uint32), unpack_planes(counts.as_py(), np.int64)
                before = np.concatenate([[0], np.cumsum(table["n_pairs"].to_numpy())])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[before]) for x in (best[place] * links, n[place] * links)]
                columns = [*(table[c].combine_chunks() for c in kept), *(pa.array(x) for x in sums), table["groups_sha256"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.select("block", "rows", "places", "counts").join(replies, "block", "left").select("rows", "places", "counts", "told").mapInArrow(count, schema)
