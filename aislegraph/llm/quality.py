"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in time
linear in the features, as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2, summed over the factors.

Features of a text: its lower-cased words and their outlines (letters a, capitals A, digits 9, other
bytes as they are, repeats once) hashed into WORD_CELLS cells each, log-scaled and of unit length
together; fourteen structure statistics (shares of capitals, digits, marks and blanks, word lengths, distinct words
and lines, and so on) and each metadata column (numbers), each as one of BINS bins whose edges are quantiles
of the training rows, with a bin of its own for null. The whole text counts.

Training is by gradient descent on at most FIT_ROWS labelled rows, those with the smallest hash of
doc_id and text; everything they need is read by Spark tasks, and only their features
(at most FIT_CELLS of them) reach the driver. The fitted model is under a megabyte.

Defined cases: a null text is empty; an empty text has its statistics and metadata only and is scored too;
null labels are left out; a doc_id with two labels trains with both; without labelled rows every score
is 0.5, with one class the score is close to it; null and repeated doc_ids are scored row by row; an empty
table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.text import blank_table, byte_hashes, lower_table, slices, text_buffer, word_spans

WORD_CELLS = 2_048
BINS = 8
FACTORS = 8
FIT_ROWS = 6_000
FIT_CELLS = 4_000_000
EPOCHS = 12
BATCH = 64
RATE = 0.02
DECAY = 1e-4
STATS = ("capitals", "digits", "marks", "blanks", "beyond ASCII", "word length", "length spread", "distinct words", "distinct lines", "words a line", "words ending in marks", "words with inner marks", "words like the one before", "words")


def outline_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = table[0x80:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("9")
    return table


def outlines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's outline: kinds of bytes, runs of one kind once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kinds = outline_table()[buf]
    new = np.ones(len(buf), dtype=bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return byte_hashes(kinds[new], before[starts], before[ends])


def shares(flags: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Flagged places a text, as a share of ``whole``."""
    before = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(before[offsets]) / np.maximum(whole, 1)


def distinct_a_text(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, of))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    return np.bincount(of[order][first], minlength=n)


@dataclass
class Features:
    """Word cells of many texts one after the other, and their statistics."""

    before: np.ndarray
    cells: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    starts, ends, first_word = word_spans(buf, offsets)
    words, sizes = np.diff(first_word), np.diff(offsets)
    of = np.repeat(np.arange(n), words)
    lower = lower_table()[buf]
    word_cell = byte_hashes(lower, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    shape_cell = outlines(buf, starts, ends)
    cell = np.concatenate([word_cell % np.uint64(WORD_CELLS), shape_cell % np.uint64(WORD_CELLS) + np.uint64(WORD_CELLS)]).astype(np.int64)
    keyed, count = np.unique(np.concatenate([of, of]) * (2 * WORD_CELLS) + cell, return_counts=True)
    text_of, cells = np.divmod(keyed, 2 * WORD_CELLS)
    values = np.log1p(count)
    norm = np.sqrt(np.bincount(text_of, weights=values**2, minlength=n))
    values = values / norm[text_of] if len(values) else values

    blank = blank_table()[buf]
    capital, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    far = buf >= 0x80
    mark = ~(blank | capital | digit | far | ((buf >= 97) & (buf <= 122)))
    length = (ends - starts).astype(float)
    mean = np.bincount(of, weights=length, minlength=n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, weights=length**2, minlength=n) / np.maximum(words, 1) - mean**2, 0))
    marks_before = np.concatenate([[0], np.cumsum(mark)])
    inner = (marks_before[ends - 1] - marks_before[starts] > 0) if len(starts) else np.zeros(0, bool)
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1][sizes > 0], breaks + 1]))
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    line_starts, line_of = line_starts[line_starts < len(buf)], line_of[line_starts < len(buf)]
    line_starts, at = np.unique(line_starts, return_index=True)
    line_of = line_of[at]
    line_ends = np.minimum(np.append(line_starts[1:], len(buf)), offsets[1:][line_of]) if len(line_starts) else line_starts
    lines = np.bincount(line_of, minlength=n)
    same = (word_cell[1:] == word_cell[:-1]) & (of[1:] == of[:-1])
    ending = np.bincount(of, weights=mark[ends - 1], minlength=n) if len(starts) else np.zeros(n)
    stats = [
        shares(capital, offsets, sizes),
        shares(digit, offsets, sizes),
        shares(mark, offsets, sizes),
        shares(blank, offsets, sizes),
        shares(far, offsets, sizes),
        mean,
        spread,
        distinct_a_text(word_cell, of, n) / np.maximum(words, 1),
        distinct_a_text(byte_hashes(buf, line_starts, line_ends), line_of, n) / np.maximum(lines, 1),
        words / np.maximum(lines, 1),
        ending / np.maximum(words, 1),
        np.bincount(of, weights=inner, minlength=n) / np.maximum(words, 1),
        np.bincount(of[1:], weights=same, minlength=n) / np.maximum(words, 1),
        np.log1p(words),
    ]
    return Features(np.searchsorted(text_of, np.arange(n + 1)), cells, values, np.stack(stats, 1))


@dataclass
class Model:
    """Weights of all cells: words, outlines, then BINS + 1 bins for each statistic and metadata column."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        """Cell of each statistic: one bin of its column."""
        out = np.empty(numbers.shape, dtype=np.int64)
        for c in range(numbers.shape[1]):
            bin_of = np.searchsorted(self.edges[c], numbers[:, c], side="right")
            out[:, c] = 2 * WORD_CELLS + c * (BINS + 1) + np.where(np.isnan(numbers[:, c]), BINS, bin_of)
        return out

    def margins(self, before: np.ndarray, cells: np.ndarray, values: np.ndarray, bins: np.ndarray) -> np.ndarray:
        linear = self.bias + segment_sums(self.weights[cells] * values, before) + self.weights[bins].sum(1)
        own = self.factors[cells] * values[:, None]
        fixed = self.factors[bins]
        total = segment_sums(own, before) + fixed.sum(1)
        squares = segment_sums(own**2, before) + (fixed**2).sum(1)
        return linear + 0.5 * (total**2 - squares).sum(1)


def segment_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[before[1:]] - total[before[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(before: np.ndarray, cells: np.ndarray, values: np.ndarray, numbers: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """Logistic loss, Adam steps over shuffled batches; edges are quantiles of the training rows."""
    rng = np.random.default_rng(seed)
    with np.errstate(all="ignore"):
        edges = np.array([np.quantile(c[~np.isnan(c)], np.arange(1, BINS) / BINS) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in numbers.T])
    n_cells = 2 * WORD_CELLS + numbers.shape[1] * (BINS + 1)
    model = Model(edges, 0.0, np.zeros(n_cells), rng.normal(0, 0.05, (n_cells, FACTORS)))
    rate = min(max(labels.mean(), 0.5 / len(labels)), 1 - 0.5 / len(labels))
    model.bias = float(np.log(rate / (1 - rate)))
    bins = model.bins(numbers)
    table = np.concatenate([model.weights[:, None], model.factors], 1)
    first, second, step = np.zeros_like(table), np.zeros_like(table), 0
    model.weights, model.factors = table[:, 0], table[:, 1:]
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            counts = before[rows + 1] - before[rows]
            index = np.concatenate([np.arange(before[r], before[r + 1]) for r in rows])
            cell = np.concatenate([cells[index], bins[rows].ravel()])
            value = np.concatenate([values[index], np.ones(bins[rows].size)])
            of = np.concatenate([np.repeat(np.arange(len(rows)), counts), np.repeat(np.arange(len(rows)), bins.shape[1])])
            local = np.concatenate([[0], np.cumsum(counts)])
            error = sigmoid(model.margins(local, cells[index], values[index], bins[rows])) - labels[rows]
            own = table[cell, 1:] * value[:, None]
            total = segment_sums(own[: len(index)], local) + table[bins[rows], 1:].sum(1)
            scale = (error / len(rows))[of] * value
            gradient = np.empty((len(cell), FACTORS + 1))
            gradient[:, 0] = scale
            gradient[:, 1:] = scale[:, None] * (total[of] - own)
            used, where = np.unique(cell, return_inverse=True)
            summed = np.zeros((len(used), FACTORS + 1))
            np.add.at(summed, where, gradient)
            summed += DECAY * table[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * summed
            second[used] = 0.999 * second[used] + 0.001 * summed**2
            table[used] -= RATE * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-6)
            model.bias -= RATE * float(error.mean())
    return model


def _numbers(batch: pa.RecordBatch, found: Features, metadata: int) -> np.ndarray:
    extra = [batch.column(batch.num_columns - metadata + k).to_numpy(zero_copy_only=False).astype(float)[:, None] for k in range(metadata)]
    return np.concatenate([found.stats, *extra], 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = ()) -> Model | None:
    """``docs``: doc_id, text and metadata columns; ``labels``: doc_id and a label of 0 or 1. None without labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(f"meta_{k}") for k, c in enumerate(metadata)])
    # The labelled side has FIT_ROWS rows at most.
    rows = rows.join(F.broadcast(known), "doc_id").select("text", "doc_id", "label", *[f"meta_{k}" for k in range(len(metadata))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = features(*text_buffer(batch.column(0)))
            numbers, before = _numbers(batch, found, len(metadata)), found.before
            cells, values = found.cells.astype(np.uint16), found.values.astype(np.float32)
            part = [slice(before[i], before[i + 1]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([cells[p].tobytes() for p in part], pa.binary()), pa.array([values[p].tobytes() for p in part], pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary())],
                ["doc_id", "label", "cells", "values", "numbers"],
            )

    read_rows = rows.mapInArrow(read, "doc_id long, label double, cells binary, values binary, numbers binary")
    # Repeated doc_ids may join more rows than that, so the limit is set once more.
    taken = read_rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("cells", "values"), "numbers").limit(FIT_ROWS).toArrow()
    if not taken.num_rows:
        return None
    sizes = np.array([len(c) // 2 for c in taken["cells"].to_pylist()])
    use = max(1, int(np.searchsorted(np.cumsum(sizes), FIT_CELLS, side="right")))
    taken = taken.slice(0, use)
    cells = np.frombuffer(b"".join(taken["cells"].to_pylist()), dtype=np.uint16).astype(np.int64)
    values = np.frombuffer(b"".join(taken["values"].to_pylist()), dtype=np.float32).astype(float)
    numbers = np.frombuffer(b"".join(taken["numbers"].to_pylist()), dtype=float).reshape(taken.num_rows, -1)
    return fit(np.concatenate([[0], np.cumsum(sizes[:use])]), cells, values, numbers, taken["label"].to_numpy())


def score(docs: DataFrame, model: Model | None, metadata: Sequence[str] = (), threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(f"meta_{k}") for k, c in enumerate(metadata)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None:
                good = np.full(batch.num_rows, 0.5)
            else:
                found = features(*text_buffer(batch.column(0)))
                good = sigmoid(model.margins(found.before, found.cells, found.values, model.bins(_numbers(batch, found, len(metadata)))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(good), pa.array((good >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(judge, "doc_id long, score double, predicted int")
