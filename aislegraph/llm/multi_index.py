"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector has its own codebook; a cell is a pair of centroids. A query takes cells in
order of the summed squared distance to both centroids, by a heap over the two sorted lists,
until they hold enough vectors, and all of these are ranked by their true distance.

Codebooks come from ``FIT_ROWS`` rows at most, those with the smallest hash of vec_id; every row
is indexed. K centroids a half, so that a cell has CELL_ROWS rows on average (K <= MAX_K). A
query sees the nearest cells that hold ``share`` of all rows. Unless it is given, the share is measured:
for CHECK_QUERIES rows of the sample, how far down their list of cells the true neighbours within
the sample lie, and the share that finds ``recall`` of them. In a sample neighbours lie farther
apart than among all rows, so the share errs on the side of more. Vectors in clusters need little of
the table, those without any much of it.
Cells lie together in shards of about SHARD_ROWS rows, larger cells over several shards, and
queries in parts of PART_QUERIES, so a cell with a third of all rows is searched by many tasks.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, as queries or candidates; repeated vectors are candidates
each; ties go to the smaller vec_id; with fewer candidates than k, all are returned; an empty
table gives no rows; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislegraph.llm.text import ragged
from aislegraph.session import cut_lineage

FIT_ROWS = 20_000
FIT_ROUNDS = 12
CELL_ROWS = 8
MAX_K = 256
SHARD_ROWS = 4_096
PART_QUERIES = 2_000
CHECK_QUERIES = 200
RECALL = 0.95


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(x[:, :cut], self.first), distances(x[:, cut:], self.second)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        of = distances(x, centres).argmin(1)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[rng.choice(len(x), size=len(empty))]
    return centres


def fit(sample: np.ndarray, k: int) -> Codebooks:
    cut = max(1, sample.shape[1] // 2)
    return Codebooks(k_means(sample[:, :cut], k, 1), k_means(sample[:, cut:], k, 2) if sample.shape[1] > 1 else np.zeros((1, 0)))


def nearest_cells(first: np.ndarray, second: np.ndarray, sizes: dict[int, int], enough: int) -> list[int]:
    """Cells in order of first[i] + second[j], until they hold ``enough`` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if cell in sizes:
            out.append(cell)
            held += sizes[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def measured_share(sample: np.ndarray, books: Codebooks, k: int, recall: float) -> float:
    """Share of the rows that a query has to see for ``recall`` of its k nearest in the sample."""
    one, two = books.halves(sample)
    wide = len(books.second)
    cell = one.argmin(1) * wide + two.argmin(1)
    sizes = np.bincount(cell, minlength=len(books.first) * wide)
    needed = []
    for q in range(min(CHECK_QUERIES, len(sample))):
        order = np.argsort((one[q][:, None] + two[q][None, :]).ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        score = ((sample - sample[q]) ** 2).sum(1)
        score[q] = np.inf
        near = _nearest(score, np.arange(len(sample)), min(k, len(sample) - 1))
        needed.append(before[cell[near]] / len(sample))
    every = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    if not len(every):
        return 1.0
    # A cell is taken as long as those before it hold less than the share.
    return min(1.0, float(every[min(len(every) - 1, math.ceil(recall * len(every)))]) + 1 / len(sample))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """vec_id and the vector as float64 bytes of all usable rows (stored), and the number of dimensions."""
    vectors = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    vectors = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    common = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = common[0]["n"] if common else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["vec_id", "v"])

    return cut_lineage(vectors.where(F.size("v") == dims).mapInArrow(pack, "vec_id long, v binary")), dims


def search(rows: DataFrame, is_query: Column, k: int = 10, share: float | None = None, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest rows of each query (``is_query`` is over vec_id) other than itself: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    vectors, dims = valid_vectors(rows, id_column, vector_column)
    total = vectors.count()
    result = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    drawn = _matrix(sample["v"], dims)
    books = fit(drawn, min(MAX_K, max(4, round(math.sqrt(total / CELL_ROWS)))))
    wide = len(books.second)
    share = measured_share(drawn, books, k, recall) if share is None else share

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = books.halves(_matrix(batch.column(1), dims))
                cell = one.argmin(1) * wide + two.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", "vec_id", "v"])

    index = cut_lineage(vectors.mapInArrow(place, "cell int, vec_id long, v binary"))
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # at most MAX_K squared
    enough, shards = max(k + 1, math.ceil(share * total)), math.ceil(total / SHARD_ROWS)
    queries = vectors.where(is_query)
    query_parts = max(1, math.ceil(queries.count() / PART_QUERIES))
    # A cell of more than SHARD_ROWS rows is spread over as many neighbouring shards as it needs.
    spread = {c: min(shards, math.ceil(n / SHARD_ROWS)) for c, n in sizes.items() if n > SHARD_ROWS}

    def shards_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = (cells.astype(np.int64) * 2654435761 % (1 << 32)) % shards
        return home, np.array([spread.get(c, 1) for c in cells.tolist()], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, many = shards_of(batch.column(0).to_numpy())
                shard = (home + batch.column(1).to_numpy() % many) % shards
                for part in range(query_parts):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(shard), part, np.int32)), *batch.columns], ["shard", "query_part", "cell", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if ids:
                one, two = books.halves(_matrix(batch.column(1), dims))
            for i, query_id in enumerate(ids):
                cells = np.array(nearest_cells(one[i], two[i], sizes, enough), dtype=np.int32)
                home, many = shards_of(cells)
                unit = np.repeat(np.arange(len(cells)), many)
                shard = (home[unit] + ragged(np.zeros(len(many), np.int64), many)) % shards
                order = np.argsort(shard, kind="stable")
                first = np.flatnonzero(np.diff(shard[order], prepend=-1))
                lists = [cells[unit[o]].tobytes() for o in np.split(order, first[1:])]
                own = shard[order][first].astype(np.int32)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([query_id % query_parts] * n, pa.int32()), pa.array([query_id] * n, pa.int64()), pa.array([x[i]] * n, pa.binary()), pa.array(lists, pa.binary())], ["shard", "query_part", "query_id", "q", "cells"])

    left = index.mapInArrow(deal, "shard int, query_part int, cell int, vec_id long, v binary")
    right = queries.mapInArrow(probe, "shard int, query_part int, query_id long, q binary, cells binary")

    def compare(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and asked.num_rows:
            x, all_ids, cell = _matrix(candidates["v"], dims), candidates["vec_id"].to_numpy(), candidates["cell"].to_numpy()
            for query_id, q, cells in zip(asked["query_id"].to_pylist(), _matrix(asked["q"], dims), asked["cells"].to_pylist(), strict=True):
                taken = np.zeros(len(books.first) * wide, dtype=bool)
                taken[np.frombuffer(cells, dtype=np.int32)] = True
                use = np.flatnonzero(taken[cell] & (all_ids != query_id))
                ids, score = all_ids[use], np.sqrt(((x[use] - q) ** 2).sum(1))
                near = _nearest(score, ids, k)
                out["query_id"].append(np.full(len(near), query_id))
                out["vec_id"].append(ids[near])
                out["score"].append(score[near])
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    keys = ["shard", "query_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest scores, ties to smaller ids."""
    near = np.arange(len(score))
    if len(score) > k:
        near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    return near[np.lexsort((ids[near], score[near]))][:k]
