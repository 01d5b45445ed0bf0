"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every cell, in words of up to 64 languages;
the AND of an n-gram's cells returns all languages that contain it. A text's languages are ranked by the popcount of each bit
over its n-grams, corrected for the filter's false positives. An n-gram belongs to a language
when its rate there is at least ``RATE_FLOOR`` and ``RATE_SHARE`` of its highest rate in any
language; rates come from counts over all training rows.

Bounds: every language of the training rows is learned, one slice of cells for each ``WORD`` of them.
At most languages / RATE_FLOOR n-grams reach the driver, and the filter sent to executors has CELLS
cells of 1 to 8 bytes in each slice; both grow with the number of languages, not with the rows.

Defined cases: null text, or one without a letter, is ``und`` with score 0; a text none of whose
n-grams is known has the most common language with score 0; rows with null lang train nothing;
with no training rows all is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislegraph.llm.text import mix, slices, text_buffer
from aislegraph.session import cut_lineage

GRAM_BYTES = 4
CELLS = 1 << 21
PROBES = 3
RATE_FLOOR = 1e-5
RATE_SHARE = 0.25
WORD = 64
UNKNOWN = "und"


def _letters_only(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with blanks for ASCII non-letters and four blanks after each text; new offsets."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:97][~((np.arange(97) >= 65) & (np.arange(97) < 91))] = 32
    table[123:128] = 32
    n = len(offsets) - 1
    out = np.full(len(buf) + GRAM_BYTES * n, 32, dtype=np.uint8)
    shift = np.repeat(np.arange(n) * GRAM_BYTES, np.diff(offsets))
    low = table[buf]
    upper = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[1:][upper] += 0x20
    out[np.arange(len(buf)) + shift] = low
    return out, offsets + np.arange(n + 1) * GRAM_BYTES


def grams_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams as 32-bit numbers, and how many there are before each text (len + 1)."""
    text, bounds = _letters_only(buf, offsets)
    if not len(text):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    grams = text[: len(text) - 3].astype(np.uint32)
    for j in range(1, GRAM_BYTES):
        grams |= text[j : len(text) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    # The blanks after a text keep its n-grams apart from the next one's.
    use = np.flatnonzero((grams & np.uint32(0xFFFF)) != np.uint32(0x2020))
    return grams[use], np.searchsorted(use, bounds)


def cells_of(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(1))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class LanguageFilter:
    languages: list[str]  # sorted; language i has bit i % WORD of slice i // WORD
    common: str | None
    cells: list[np.ndarray]
    chance: list[float]  # false-positive rate of each language

    def masks(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """Of each slice in turn."""
        first, *rest = cells_of(grams)
        for cells in self.cells:
            out = cells[first]
            for c in rest:
                out &= cells[c]
            yield out


def train(rows: DataFrame) -> LanguageFilter:
    """rows: text, lang. Counts cover every row with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, inverse = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            return grams, np.bincount(inverse, weights=np.concatenate([c for _, c in held[lang]])).astype(np.int64)

        for batch in slices(batches):
            grams, before = grams_of(*text_buffer(batch.column(0)))
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            of = np.repeat(np.arange(len(langs)), np.diff(before))
            for lang in sorted(set(langs)):
                own = np.unique(grams[(langs == lang)[of]], return_counts=True)
                held.setdefault(lang, []).append(own)
                if len(held[lang]) >= 8:
                    held[lang] = [merged(lang)]
        for lang in held:
            grams, counts = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    usable = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    common = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not common:
        return LanguageFilter([], None, [], [])
    languages = sorted(common)
    counts = cut_lineage(usable.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("own"))
    belongs = top.select("gram", F.expr(f"filter(own, x -> x.rate >= {RATE_FLOOR}D AND x.rate >= {RATE_SHARE}D * top)").alias("own"))
    kept = belongs.select("gram", F.explode("own.lang").alias("lang")).toArrow()  # at most languages / RATE_FLOOR rows
    grams = kept["gram"].to_numpy().astype(np.uint32)
    number = np.searchsorted(np.array(languages, dtype=object), np.array(kept["lang"].to_pylist(), dtype=object)) if len(grams) else np.zeros(0, np.int64)
    cells, chance = [], []
    for begin in range(0, len(languages), WORD):
        here = min(WORD, len(languages) - begin)
        width = np.dtype(next(f"uint{b}" for b in (8, 16, 32, 64) if b >= here))
        own = np.zeros(CELLS, dtype=width)
        use = (number >= begin) & (number < begin + here)
        bits = np.left_shift(np.uint64(1), (number[use] - begin).astype(np.uint64)).astype(width)
        for c in cells_of(grams[use]):
            np.bitwise_or.at(own, c, bits)
        cells.append(own)
        chance += [float(np.mean((own >> width.type(i)) & width.type(1))) ** PROBES for i in range(here)]
    return LanguageFilter(languages, common[0], cells, chance)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1) added; the text alone decides.
    Columns of docs with these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # CELLS cells a slice, whatever the rows
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            column = batch.column(at)
            buf, offsets = text_buffer(column)
            n = batch.num_rows
            letters = np.concatenate([[0], np.cumsum((buf | 0x20) - 97 < 26)])
            lettered = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (offsets[1:] > offsets[:-1])):
                lettered[i] = any(c.isalpha() for c in bytes(buf[offsets[i] : offsets[i + 1]]).decode())
            labels, scores = [UNKNOWN] * n, np.zeros(n)
            if m.languages:
                grams, before = grams_of(buf, offsets)
                total = np.maximum(np.diff(before), 1)
                share = np.empty((len(m.languages), n))
                for word, masks in enumerate(m.masks(grams)):
                    for k in range(word * WORD, min((word + 1) * WORD, len(m.languages))):
                        hits = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(k % WORD)) & masks.dtype.type(1), dtype=np.int64)])[before]
                        share[k] = np.clip((np.diff(hits) / total - m.chance[k]) / max(1e-9, 1 - m.chance[k]), 0, 1)
                best, added = share.argmax(axis=0), share.sum(axis=0)
                for i in np.flatnonzero(lettered):
                    labels[i] = m.languages[best[i]] if added[i] > 0 else m.common
                    scores[i] = share[best[i], i] / added[i] if added[i] > 0 else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(judge, schema)
