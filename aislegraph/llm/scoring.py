"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, unigrams and the uniform distribution are mixed with
weights that depend on how often the context was seen (buckets that double). Weights come from
expectation-maximisation on held-out counts: every training document is held out in turn, its own
counts deleted from the corpus counts, and its tokens join a histogram over (bucket, bigram
estimate, unigram estimate) of bounded size, on which the iterations run.

    P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),   b = bucket of c(v)

Defined cases: null and empty texts are one end token; with no training rows N = V = 0, the
base score is that of its formula (log10 1 a token) and the model is uniform; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aislegraph.llm.blocks import BLOCK_BYTES, exchange, joined_replies, make_blocks, open_block, shared_counts, with_replies
from aislegraph.llm.text import byte_hashes, lower_table, mix, text_buffer, word_spans

BUCKETS = 32
STEPS = 4  # histogram bins per doubling of an estimate
EM_ROUNDS = 40
END, START = np.uint64(0x51ED270B7A1F39C5), np.uint64(0x2545F4914F6CDD1D)


class _Tokens:
    """Tokens of a block: unigram keys are odd, bigram keys even."""

    def __init__(self, payload: bytes, held_out_fold):
        self.batch = open_block(payload)
        buf, offsets = text_buffer(self.batch.column(1))
        starts, ends, before = word_spans(buf, offsets)
        words = byte_hashes(lower_table()[buf], starts, ends)
        docs = len(offsets) - 1
        self.before = before + np.arange(docs + 1)
        tokens = np.full(len(words) + docs, END, dtype=np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(before))] = words
        context = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
        context[self.before[:-1]] = START
        self.unigrams = tokens | np.uint64(1)
        self.bigrams = mix(tokens + mix(context)) & ~np.uint64(0xFF)  # 56 bits: most keys are bigrams
        self.doc = np.repeat(np.arange(docs), np.diff(self.before))
        self.opens = context == START
        self.held_out = np.array([held_out_fold(d) for d in self.batch.column(0).to_pylist()], dtype=bool)
        self.training = ~self.held_out[self.doc]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all tokens, and their counts in training documents."""
        keys, inverse = np.unique(np.concatenate([self.unigrams, self.bigrams]), return_inverse=True)
        self.unigram_at, self.bigram_at = inverse[: len(self.doc)], inverse[len(self.doc) :]
        self.end_at = np.searchsorted(keys, END | np.uint64(1))
        return keys, np.bincount(inverse, weights=np.concatenate([self.training, self.training]), minlength=len(keys)).astype(np.int64)

    def counts(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus counts of each token, its bigram and its context (a context's count is its word's;
        the start of a text is as frequent as its end)."""
        one, two = totals[self.unigram_at], totals[self.bigram_at]
        context = np.concatenate([[0], one[:-1]])
        context[self.opens] = totals[self.end_at] if len(totals) else 0
        return one, two, context

    def own_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same counts within the token's own document, and that document's tokens."""

        def within(keys: np.ndarray) -> np.ndarray:
            _, inverse, counts = np.unique(keys ^ mix(self.doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
            return counts[inverse]

        one, two = within(self.unigrams), within(self.bigrams)
        context = np.concatenate([[0], one[:-1]])
        context[self.opens] = 1
        return one, two, context, np.diff(self.before)[self.doc]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for no estimate, else a bin of its logarithm."""
    return np.where(p > 0, 1 + np.clip(np.floor(-STEPS * np.log2(np.where(p > 0, p, 1.0))), 0, 255), 0).astype(np.int64)


def learn_weights(histogram: list[tuple[int, int, int, float]], types: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    cells = np.array(histogram, dtype=np.float64).reshape(-1, 4)
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 0.5) / STEPS), 0.0)
    for k in range(BUCKETS):
        own = cells[cells[:, 0] == k]
        if not len(own):
            weights[k] = weights[k - 1] if k else [0.0, 0.5, 0.5]
            continue
        p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1 / (types + 1))], axis=1)
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * own[:, 3:]).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        weights[k] = w
    return weights


def score_documents(docs: DataFrame, held_out_fold, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``held_out_fold(doc_id)`` is true for rows that train nothing. Per row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score."""
    blocks, n_buckets = make_blocks(docs, block_bytes)

    def answer(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], dict]:
        distinct, inverse, totals = shared_counts(keys, counts)
        words = (distinct & np.uint64(1)) == 1
        each = totals[inverse].astype(np.uint64)
        return [each[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], {"tokens": int(totals[words].sum()), "types": int((totals[words] > 0).sum())}

    replies = exchange(blocks, lambda row: _Tokens(row[0], held_out_fold).keys(), answer, n_buckets, ("tokens", "types"))
    facts = replies.agg({"tokens": "sum", "types": "sum"}).first()
    n, types = int(facts["sum(tokens)"] or 0), int(facts["sum(types)"] or 0)
    state = with_replies(blocks, replies, "totals")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Tokens, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Tokens(row["payload"], held_out_fold)
                block.keys()
                yield block, joined_replies(row["totals"], np.uint64).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, totals in opened(batches):
            one, two, context = (all_ - own for all_, own in zip(block.counts(totals), block.own_counts()[:3], strict=True))
            size = n - block.own_counts()[3]
            use = block.training
            cell = (bucket_of(context) * 512 + _bin(_ratio(two, context))) * 512 + _bin(_ratio(one, size))
            cells, many = np.unique(cell[use], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(many)], ["cell", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, totals in opened(batches):
            one, two, context = block.counts(totals)
            w = weights[bucket_of(context)]
            p = w[:, 0] * _ratio(two, context) + w[:, 1] * (one / n if n else 0.0) + w[:, 2] / (types + 1)
            per_doc = lambda x: np.add.reduceat(x, block.before[:-1]) if len(x) else x  # noqa: E731  every document has a token
            out = [
                block.batch.column(0), pa.array(block.held_out), pa.array(np.diff(block.before)), pa.array(per_doc((one > 0).astype(np.int64))),
                pa.array(np.full(len(block.held_out), n)), pa.array(per_doc(np.log10((one + 0.5) / (n + 0.5 * (types + 1))))), pa.array(per_doc(np.log10(p))),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    histogram = state.mapInArrow(tally, "cell long, n long").groupBy("cell").sum("n").collect()  # at most BUCKETS * 257 * 257 cells
    weights = learn_weights([(c >> 18, (c >> 9) & 511, c & 511, many) for c, many in histogram], types)
    return state.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
