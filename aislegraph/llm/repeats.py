"""Substring dedup by level-wise doubling.

A window of ``window`` words can only repeat if its parts do. At each level, of lengths that
double up to the window's own, a window still in question is represented by the smallest hash
among its n-grams of that length; those whose representative stands at one place alone in the
corpus are settled as unique, and only the rest are looked at at twice the length. At the last
level the representative is the whole window, so the result is exact (64-bit hashes). Equal
windows have equal representatives at equal offsets, so no repeat is lost.

Defined cases: null and empty texts have no words (hash of the empty string); repeated rows are
copies of each other; texts shorter than a window keep all words; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aislegraph.llm.blocks import BLOCK_BYTES, exchange, joined_replies, make_blocks, open_block, shared_counts, with_replies
from aislegraph.llm.text import byte_hashes, gram_hashes, sliding, text_buffer, word_spans

WINDOW_WORDS = 35
FIRST_WORDS = 9


def levels(window: int, first: int) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class _Windows:
    """The windows of a block: hashes, valid starts and which are still in question."""

    def __init__(self, payload: bytes, window: int):
        self.batch = open_block(payload)
        self.buf, offsets = text_buffer(self.batch.column(1))
        self.offsets, self.window = offsets, window
        self.starts, self.ends, self.before = word_spans(self.buf, offsets)
        self.words = byte_hashes(self.buf, self.starts, self.ends)
        n = max(0, len(self.words) - window + 1)
        ends = np.repeat(self.before[1:], np.diff(self.before))[:n]
        self.open = np.arange(n) + window <= ends

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Representatives of open windows: distinct ones, how many places each has, and the place of
        each open window's among them."""
        grams = gram_hashes(self.words, length)
        width = self.window - length + 1
        least = sliding(np.minimum, grams, width)
        if not self.open.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        shown = np.where(self.open, least, np.uint64(0))
        padded = np.concatenate([np.zeros(width - 1, np.uint64), shown, np.zeros(width - 1, np.uint64)])
        chosen = grams[sliding(np.maximum, padded, width) == grams]
        keys, counts = np.unique(chosen, return_counts=True)
        return keys, counts, np.searchsorted(keys, least[self.open])

    def settle(self, length: int, repeated: np.ndarray) -> None:
        _, _, at = self.keys(length)
        self.open[self.open] = repeated[at] if len(at) else False

    def covered(self) -> np.ndarray:
        """Words that an open window covers."""
        edge = np.zeros(len(self.words) + 1, dtype=np.int64)
        begins = np.flatnonzero(self.open)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _settled(row: tuple, window: int, lengths: list[int]) -> _Windows:
    """row: payload, then the replies of the levels done so far."""
    block = _Windows(row[0], window)
    for length, replies in zip(lengths, row[1:], strict=False):
        block.settle(length, joined_replies(replies, np.uint8).astype(bool))
    return block


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, first: int = FIRST_WORDS, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and the kept words joined by a blank)."""
    lengths = levels(window, first)
    state, n_buckets = make_blocks(docs, block_bytes)

    def answer(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], dict]:
        _, inverse, totals = shared_counts(keys, counts)
        repeated = (totals > 1).astype(np.uint8)[inverse]
        return [repeated[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], {}

    for k, length in enumerate(lengths):
        replies = exchange(state, lambda row, length=length: _settled(row, window, lengths).keys(length)[:2], answer, n_buckets)
        state = with_replies(state, replies, f"level{k}")

    columns = state.columns[1:]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _settled(tuple(row[c] for c in columns), window, lengths)
                gone = block.covered()
                n_words = np.diff(block.before)
                before = np.concatenate([[0], np.cumsum(gone)])[block.before]
                n_removed, data = np.diff(before), block.buf.tobytes()
                digests, texts = [], []
                for i in range(len(n_words)):
                    words = data[block.offsets[i] : block.offsets[i + 1]].split()
                    if n_removed[i]:
                        words = [words[j] for j in np.flatnonzero(~gone[block.before[i] : block.before[i + 1]])]
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if keep_text else None)
                out = [block.batch.column(0), pa.array(n_words), pa.array(n_removed), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out[: 5 if keep_text else 4], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if keep_text else 4])

    return state.mapInArrow(apply, schema)
