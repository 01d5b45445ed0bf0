"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into passages of ``passage`` characters that start every 2 ``edits``
characters. Any stretch of an item of that length is at most ``edits`` places from a passage, so a
verbatim one is found wherever it begins. A passage of m
characters that stands in a text with at most k edits shares at least m + 1 - (k + 1) q of its
q-grams with it, on diagonals (place in text minus place in item) no more than k apart. Shared
q-grams are counted in diagonal bands of width 2k that overlap by k, so each such region lies
whole in some band; bands that reach the bound are verified by banded alignment. Items under
``MIN_CHARS`` characters are found whole and exact, between word edges.

Texts are compared without case, and with each run of characters other than letters and digits
as one blank. The benchmark is read in parts of about ``PART_CHARS`` characters, so what executors
hold of it is bounded; each part is one scan of the documents.

Defined cases: null and empty texts and items match nothing, and neither do items without
letters and digits; items with equal text are one, under the smallest item_id; repeated
rows are judged each; other columns are kept by ``flag_documents`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislegraph.llm.text import ragged, slices, text_buffer

Q = 10
PASSAGE_CHARS = 60
EDITS = 3
MIN_CHARS = 30
PART_CHARS = 4_000_000
FILTER_BITS = 20
STOP, BLANK = 1, 32
HASH_BASE = 0x9E3779B1


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower-case letters and digits as they are, anything else a blank (basic plane)."""
    table = np.full(0x10000, BLANK, dtype=np.uint32)
    for c in range(0x10000):
        if chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@dataclass
class Folded:
    codes: np.ndarray  # of all texts, with STOP after each
    origin: np.ndarray  # where each code stands in its text
    bounds: np.ndarray  # where each text begins (len + 1)


def fold_texts(buf: np.ndarray, offsets: np.ndarray) -> Folded:
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(points))
    folded = np.where(codes < 0x10000, fold_table()[np.minimum(codes, 0xFFFF)], codes)
    out = np.full(len(codes) + n, STOP, dtype=np.uint32)
    at = np.arange(len(codes)) + text_of
    out[at] = folded
    origin = np.zeros(len(out), dtype=np.int64)
    origin[at] = np.arange(len(codes)) - points[text_of]
    keep = out != BLANK
    keep[:-1] |= (out[1:] != BLANK) & (out[1:] != STOP)  # the last blank of a run, unless it ends the text
    stops = np.flatnonzero(out[keep] == STOP)
    return Folded(out[keep], origin[keep], np.concatenate([[0], stops + 1]))


def gram_codes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hash of each q codes, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint32)
    base = lambda e: np.uint32(pow(HASH_BASE, e, 1 << 32))
    level, done, out, covered = codes.astype(np.uint32), 1, None, 0
    m = len(codes) - q + 1
    while True:
        if q & done:
            out = level[covered : covered + m].copy() if out is None else out * base(done) + level[covered : covered + m]
            covered += done
        if done * 2 > q:
            break
        level = level[:-done] * base(done) + level[done:]
        done *= 2
    out ^= out >> np.uint32(15)
    return out * np.uint32(0x2C1B3C6D)


@dataclass
class Passages:
    """Passages of some items, and their q-grams sorted by hash."""

    item: list[int]
    codes: list[np.ndarray]
    edits: list[int]
    need: np.ndarray
    begin: np.ndarray  # in the item
    grams: np.ndarray
    gram_passage: np.ndarray
    gram_place: np.ndarray
    present: np.ndarray
    short: dict[int, dict[bytes, list[int]]]  # passages of short items, by length and codes


def cut_passages(items: list[tuple[int, str]], passage: int, edits: int, q: int = Q) -> Passages:
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    grams, owner, place = [], [], []
    short: dict[int, dict[bytes, list[int]]] = {}
    for item_id, text in items:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        codes = fold_texts(raw, np.array([0, len(raw)])).codes[:-1]
        codes = codes[1:] if len(codes) and codes[0] == BLANK else codes
        if not len(codes):
            continue
        if len(codes) < MIN_CHARS:
            short.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(len(out[0]))
            for column, value in zip(out, (item_id, codes, 0, 0, 0), strict=True):
                column.append(value)
            continue
        size = min(passage, len(codes))
        last = len(codes) - size
        for begin in sorted({*range(0, last + 1, max(1, 2 * edits)), last}):
            own = codes[begin : begin + size]
            k = edits * size // passage
            h = gram_codes(own, q)
            for column, value in zip(out, (item_id, own, k, size + 1 - (k + 1) * q, begin), strict=True):
                column.append(value)
            grams.append(h)
            owner.append(np.full(len(h), len(out[0]) - 1))
            place.append(np.arange(len(h)))
    h = np.concatenate([np.zeros(0, np.uint32), *grams])
    order = np.argsort(h, kind="stable")
    present = np.zeros(1 << FILTER_BITS, dtype=bool)
    present[h >> np.uint32(32 - FILTER_BITS)] = True
    empty = np.zeros(0, np.int64)
    return Passages(out[0], out[1], out[2], np.array(out[3], dtype=np.int64), np.array(out[4], dtype=np.int64), h[order], np.concatenate([empty, *owner])[order], np.concatenate([empty, *place])[order], present, short)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn the pattern into some stretch of text whose diagonal stays between low and
    high; (edits, start, end), or None if over ``most``. Rows of the table are the band alone."""
    width = high - low + 1
    steps = np.arange(width)
    cost = np.zeros(width, dtype=np.int64)
    begin = low + steps
    cost[(begin < 0) | (begin > len(text))] = most + 1
    for i, c in enumerate(pattern):
        at = low + i + steps
        inside = (at >= 0) & (at < len(text))
        other = np.ones(width, dtype=np.int64)
        other[inside] = text[at[inside]] != c
        replaced = np.where(inside, cost + other, most + 1)
        dropped = np.append(cost[1:] + 1, most + 1)
        best = np.minimum(replaced, dropped)
        from_ = np.where(replaced <= dropped, begin, np.append(begin[1:], 0))
        # Added characters: a running minimum along the band.
        lead = best - steps
        low_at = np.maximum.accumulate(np.where(lead == np.minimum.accumulate(lead), steps, 0))
        cost, begin = best[low_at] + steps - low_at, from_[low_at]
    k = int(np.argmin(cost))
    end = low + len(pattern) + k
    return (int(cost[k]), int(begin[k]), end) if cost[k] <= most and 0 <= begin[k] <= end <= len(text) else None


def find_short(folded: Folded, p: Passages) -> list[tuple[int, int, int, int, int]]:
    """The same as find_regions, of short items."""
    out = []
    edge = folded.codes <= BLANK  # no letter or digit is that low
    first = np.concatenate([[True], edge[:-1]])
    for size, owners in p.short.items():
        h = gram_codes(folded.codes, size)[:-1]  # a stop ends the last text
        if not len(h):
            continue
        wanted = gram_codes(np.frombuffer(b"".join(owners), dtype=np.uint32), size)[::size]
        for at in np.flatnonzero(first[: len(h)] & edge[size:] & np.isin(h, wanted)).tolist():
            text = int(np.searchsorted(folded.bounds, at, side="right")) - 1
            out += [(text, owner, at, at + size, 0) for owner in owners.get(folded.codes[at : at + size].tobytes(), ())]
    return out


def find_regions(folded: Folded, p: Passages, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) of all verified regions; start and end are places in folded.codes."""
    out, seen = find_short(folded, p), set()
    if not len(p.grams):
        return out
    h = gram_codes(folded.codes, q)
    at = np.flatnonzero(p.present[h >> np.uint32(32 - FILTER_BITS)])
    left = np.searchsorted(p.grams, h[at], side="left")
    many = np.searchsorted(p.grams, h[at], side="right") - left
    hit = ragged(left, many)
    owner, diagonal = p.gram_passage[hit], np.repeat(at, many) - p.gram_place[hit]
    widths = np.maximum(np.array(p.edits), 1)[owner]
    band = diagonal // widths
    pad = max(map(len, p.codes)) + 2  # diagonals begin below 0
    span = len(folded.codes) + 2 * pad
    keys = np.concatenate([owner * span + band + pad, owner * span + band - 1 + pad])
    found, counts = np.unique(keys, return_counts=True)
    enough = counts >= p.need[found // span]
    for key in found[enough].tolist():
        owner_, band_ = key // span, key % span - pad
        k, pattern = p.edits[owner_], p.codes[owner_]
        low = band_ * max(k, 1)
        high = low + 2 * max(k, 1) - 1
        text = int(np.searchsorted(folded.bounds, min(max(low + len(pattern) // 2, 0), len(folded.codes) - 1), side="right")) - 1
        a, b = int(folded.bounds[text]), int(folded.bounds[text + 1]) - 1
        m = len(pattern)
        exact = next((d for d in range(max(low, a), min(high, b - m) + 1) if np.array_equal(folded.codes[d : d + m], pattern)), None)
        match = align(pattern, folded.codes[a:b], low - a, high - a, k) if exact is None else (0, exact - a, exact - a + m)
        if match and (text, owner_, match[1]) not in seen:
            seen.add((text, owner_, match[1]))
            out.append((text, owner_, a + match[1], a + match[2], match[0]))
    return out


def benchmark_parts(benchmark: DataFrame, passage: int, edits: int, part_chars: int = PART_CHARS) -> Iterator[Passages]:
    """The benchmark's passages in parts whose size does not grow with it."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_chars))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).orderBy("item_id")
        yield cut_passages([(r["item_id"], r["text"]) for r in own.toLocalIterator()], passage, edits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE_CHARS, edits: int = EDITS) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, n_passages, fewest edits, and the
    span in code points from the first matching passage to the end of the last."""
    schema = "doc_id long, item_id long, n_passages int, edits int, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for part in benchmark_parts(benchmark, passage, edits):
        shared = docs.sparkSession.sparkContext.broadcast(part)  # bounded by PART_CHARS

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                folded = fold_texts(*text_buffer(batch.column(1)))
                items: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for text, owner, start, end, n in find_regions(folded, shared.value):
                    items.setdefault((text, shared.value.item[owner]), []).append((n, int(folded.origin[start]), int(folded.origin[max(start, end - 1)]) + 1))
                ids = batch.column(0).to_pylist()
                out = [(ids[text], item, len(x), min(r[0] for r in x), min(r[1] for r in x), max(r[2] for r in x)) for (text, item), x in sorted(items.items())]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_passages", "edits", "start", "end"])

        own = rows.mapInArrow(search, schema)
        found = own if found is None else found.unionByName(own)
    return found


def flag_documents(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE_CHARS, edits: int = EDITS) -> DataFrame:
    """All columns of docs, with ``contaminated`` added (a column of that name is replaced)."""
    out = docs.drop("contaminated").withColumn("contaminated", F.lit(False))
    at, flag = out.columns.index("text"), len(out.columns) - 1
    for part in benchmark_parts(benchmark, passage, edits):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hit = np.array(batch.column(flag).to_pylist(), dtype=bool)
                for text, *_ in find_regions(fold_texts(*text_buffer(batch.column(at))), shared.value):
                    hit[text] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:flag], pa.array(hit)], batch.schema.names)

        out = out.mapInArrow(mark, T.StructType(out.schema.fields))
    return out
