"""Centroid clustering on integer vectors: nearest centroids by the threshold algorithm.

Assignment keeps, for each dimension, the centroids sorted by their component. From a vector's own
component the list is walked outward, nearest first, in all dimensions at once; a centroid met for
the first time gets its exact distance. The components met last, one a dimension, bound from below
the distance of every centroid not met yet, so the walk stops as soon as the sum of their squared
gaps strictly exceeds the best exact distance (strictly, since an equal one may have a smaller number).

Each round is one pass over the stored vectors: a task sends the sums and counts of its clusters
(k x dimensions numbers in 32-bit limbs, whatever its rows), Spark adds them up, and the driver takes
the k exact floors. No row is dealt by cluster, so a cluster with most rows, or one vector repeated
many times, costs nothing extra.

Defined cases: null vectors, those of another length than ``dims`` and those with null or non-finite
components are left out; repeated rows count each; a null vec_id is ordered last among the starts and
equal hashes are ordered by the vector; with fewer kept vectors than ``k`` there are as many centroids
as vectors; clusters may end empty and then show in no row; components are exact integers of any size, and
distances beyond the range of long are given as its largest value; an empty table gives no rows; columns
other than the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.session import cut_lineage

SCALE = 1024
SAFE = 1 << 27  # components up to here have squared distances within long for 64 dimensions
LONG_MAX = (1 << 63) - 1
LIMB = 32
SLICE_CELLS = 4_000_000  # vectors x centroids x dimensions looked at together


def whole_numbers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each, also where the product is beyond the range of double."""
    return [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in values]


class SortedCentroids:
    """Centroids with their sorted list in each dimension."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.dims = len(centroids[0])
        self.small = all(-SAFE <= x <= SAFE for c in centroids for x in c) and self.dims <= 64
        if self.small:
            self.table = np.array(centroids, dtype=np.int64)
            self.order = np.argsort(self.table, axis=0, kind="stable")
            self.sorted = np.take_along_axis(self.table, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and squared distance of each vector (int64, components within SAFE)."""
        n, k, dims = len(x), len(self.table), self.dims
        best, number = np.full(n, LONG_MAX), np.zeros(n, dtype=np.int64)
        high = np.empty((n, dims), dtype=np.int64)
        for d in range(dims):
            high[:, d] = np.searchsorted(self.sorted[:, d], x[:, d])
        low, column = high - 1, np.arange(dims)
        met, live = np.zeros((n, k), dtype=bool), np.arange(n)
        for step in range(k):
            # The next centroid outward in every dimension: the one below or the one above.
            v = x[live]
            under, over = low[live], high[live]
            gap_under = np.where(under >= 0, v - self.sorted[np.maximum(under, 0), column], LONG_MAX)
            gap_over = np.where(over < k, self.sorted[np.minimum(over, k - 1), column] - v, LONG_MAX)
            down = gap_under <= gap_over
            place = np.where(down, under, over)
            low[live] -= down
            high[live] += ~down
            row, dim = np.indices(place.shape)
            fresh = np.zeros((len(live), k), dtype=bool)
            fresh[row, self.order[place, dim]] = True
            fresh &= ~met[live]
            met[live] |= fresh
            row, centroid = np.nonzero(fresh)
            distance = ((v[row] - self.table[centroid]) ** 2).sum(1)
            # Of equal distances the smaller number wins, so pairs go in from the worst to the best.
            order = np.lexsort((-centroid, -distance))
            row, centroid, distance = live[row[order]], centroid[order], distance[order]
            better = (distance < best[row]) | ((distance == best[row]) & (centroid < number[row]))
            best[row[better]], number[row[better]] = distance[better], centroid[better]
            frontier = (np.minimum(gap_under, gap_over) ** 2).sum(1)
            live = live[frontier <= best[live]]
            if not len(live):
                break
        return number, best

    def nearest_exact(self, x: list[int]) -> tuple[int, int]:
        """The same walk for one vector of integers of any size."""
        k = len(self.exact)
        lists = [sorted(range(k), key=lambda c: (abs(self.exact[c][d] - x[d]), c)) for d in range(self.dims)]
        best, met = (None, 0), set()
        for step in range(k):
            frontier = 0
            for d in range(self.dims):
                c = lists[d][step]
                frontier += (self.exact[c][d] - x[d]) ** 2
                if c not in met:
                    met.add(c)
                    found = (sum((a - b) ** 2 for a, b in zip(self.exact[c], x, strict=True)), c)
                    best = found if best[0] is None else min(best, found)
            if frontier > best[0]:
                break
        return best[1], best[0]


def kept_vectors(rows: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v of every usable vector (stored): its integers as int32, or its components as float64 where one is beyond SAFE."""
    v = F.col(vector_column).cast("array<double>")
    vectors = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    usable = vectors.where(F.expr(f"v IS NOT NULL AND size(v) = {dims} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * x)
                small = (np.abs(whole) <= SAFE).all(1)
                narrow = np.where(small[:, None], whole, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(narrow if s else x)[i].tobytes() for i, s in enumerate(small.tolist())], pa.binary())], ["vec_id", "v"])

    return cut_lineage(usable.mapInArrow(pack, "vec_id long, v binary"))


def integers(packed: bytes, dims: int, scale: int) -> list[int]:
    if len(packed) == 4 * dims:
        return np.frombuffer(packed, dtype=np.int32).tolist()
    return whole_numbers(np.frombuffer(packed, dtype=np.float64).tolist(), scale)


def assigned(batch: pa.RecordBatch, lists: SortedCentroids, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Row numbers, centroid numbers, distances and vectors of a batch, in bounded parts."""
    packed, dims = batch.column(1).to_pylist(), lists.dims
    narrow = np.array([len(p) == 4 * dims for p in packed], dtype=bool) & lists.small
    rows = np.flatnonzero(narrow)
    step = max(1, SLICE_CELLS // (len(lists.exact) * dims))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        x = np.frombuffer(b"".join([packed[i] for i in part]), dtype=np.int32).reshape(-1, dims).astype(np.int64)
        yield part, *lists.nearest(x), x
    for i in np.flatnonzero(~narrow).tolist():
        x = integers(packed[i], dims, scale)
        number, distance = lists.nearest_exact(x)
        yield np.array([i]), np.array([number]), np.array([distance], dtype=object), [x]


def cluster_totals(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[tuple[int, int, list[int]]]:
    """Count, sum of distances and componentwise sums of each cluster: k rows, whatever the input."""
    k, dims = len(centroids), len(centroids[0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedCentroids(centroids)
        totals = [[0] * (dims + 2) for _ in range(k)]
        for batch in batches:
            for _, number, distance, x in assigned(batch, lists, scale):
                for c in np.unique(number).tolist():
                    of = np.flatnonzero(number == c)
                    sums = x[of].sum(0).tolist() if isinstance(x, np.ndarray) else x[0]
                    mine = [len(of), sum(distance[of].tolist()), *sums]
                    totals[c] = [a + b for a, b in zip(totals[c], mine, strict=True)]
        out = [(c, slot, limb, part) for c in range(k) if totals[c][0] for slot, total in enumerate(totals[c]) for limb, part in enumerate(limbs(total))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*out, strict=True)], ["cluster", "slot", "limb", "part"])

    parts = vectors.mapInArrow(add_up, "cluster long, slot long, limb long, part long").groupBy("cluster", "slot", "limb").agg(F.sum("part").alias("part"))
    totals = [[0] * (dims + 2) for _ in range(k)]
    for r in parts.collect():  # at most k x (dims + 2) numbers, a few limbs each
        totals[r["cluster"]][r["slot"]] += r["part"] << (LIMB * r["limb"])
    return [(t[0], t[1], t[2:]) for t in totals]


def limbs(total: int) -> list[int]:
    """Parts that sum to ``total`` when shifted by 32 bits each; all but the last are non-negative."""
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def cluster_vectors(rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Centroids start as the k vectors with the smallest sha256 of ``seed:vec_id``."""
    vectors = kept_vectors(rows, dims, scale, id_column, vector_column)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = [integers(bytes(r["v"]), dims, scale) for r in starts]
    for _ in range(rounds):
        totals = cluster_totals(vectors, centroids, scale)
        moved = [[s // n for s in sums] if n else c for c, (n, _, sums) in zip(centroids, totals, strict=True)]
        if moved == centroids:
            break  # the remaining rounds would change nothing
        centroids = moved
    inertias = [d for _, d, _ in cluster_totals(vectors, centroids, scale)]
    total = min(sum(inertias), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedCentroids(centroids)
        for batch in batches:
            for part, number, distance, _ in assigned(batch, lists, scale):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part)),
                        pa.array(number.astype(np.int32)),
                        pa.array([min(d, LONG_MAX) for d in distance.tolist()], pa.int64()),
                        pa.array([min(inertias[c], LONG_MAX) for c in number.tolist()], pa.int64()),
                        pa.array([total] * len(part), pa.int64()),
                        pa.array([digests[c] for c in number.tolist()]),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return vectors.mapInArrow(assign, schema)
