"""Stored tables that change by new files: a price history of deltas, and catalog versions behind a manifest.

Neither ever rewrites a file that a reader may hold. What a table consists of is named by one small
manifest file, and a change is done when the next manifest appears under its final name, which is one
rename. Writers that stop before leave folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislegraph.operators.maintenance import HISTORY_KEY, last_wins

TRIES = 10


@dataclass
class Manifest:
    """``number`` grows with each change; ``parts`` maps a part's key to its folder."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)


class ManifestLog:
    """Numbered manifests in a folder; the highest number counts. Two writers of one number: one rename wins."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/_manifests"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> Manifest:
        _, path, files = self._files()
        if not files.exists(path):
            return Manifest()
        numbers = [int(s.getPath().getName()[:-5]) for s in files.listStatus(path) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return Manifest()
        rows = self.spark.read.text(f"{self.folder}/{max(numbers):012d}.json", wholetext=True).collect()
        return Manifest(max(numbers), json.loads(rows[0][0]))

    def commit(self, seen: Manifest, parts: dict[str, str]) -> Manifest | None:
        """Makes ``parts`` the table's content; None when someone else has changed it since ``seen``."""
        jvm, path, files = self._files()
        files.mkdirs(path)
        new = Manifest(seen.number + 1, parts)
        draft = jvm.org.apache.hadoop.fs.Path(self.folder, f".{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        finally:
            stream.close()
        final = jvm.org.apache.hadoop.fs.Path(self.folder, f"{new.number:012d}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            return None
        return new

    def change(self, parts_after: Callable[[Manifest], dict[str, str] | None]) -> Manifest:
        """Commits what ``parts_after`` makes of the latest manifest (None: nothing to do), again when another writer was first."""
        for _ in range(TRIES):
            seen = self.latest()
            parts = parts_after(seen)
            if parts is None or parts == seen.parts:
                return seen
            done = self.commit(seen, parts)
            if done is not None:
                return done
        raise RuntimeError(f"{self.folder} is changed by too many writers at once")


def _folder(root: str, kind: str) -> str:
    return f"{root}/{kind}-{uuid.uuid4().hex}"


class CatalogStore:
    """Catalog snapshots by retailer: a crawl writes a new version of its retailers' rows, and one manifest
    swaps all of them in at once. Readers of the version before keep reading its files.

    An empty snapshot changes nothing, retailers that it does not hold keep their rows, a null retailer is a
    part of its own, and a write that fails leaves the table as it was."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root, ManifestLog(spark, root)

    def replace(self, snapshot: DataFrame) -> Manifest:
        folder = _folder(self.root, "version")
        key = F.coalesce(F.concat(F.lit("of "), "retailer"), F.lit("none"))  # never read back as a number
        snapshot.withColumn("part", key).hint("rebalance", "part").write.partitionBy("part").parquet(folder)
        # One row a chain, read from the folder names that were written.
        written = self.spark.read.schema("part string").option("basePath", folder).parquet(folder)
        held = [r[0] for r in written.distinct().collect()]
        return self.log.change(lambda seen: {**seen.parts, **{p: folder for p in held}})

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """Rows of the latest (or a given) manifest; None before the first write."""
        manifest = manifest or self.log.latest()
        frames = None
        for folder in sorted(set(manifest.parts.values())):
            mine = [p for p, f in manifest.parts.items() if f == folder]
            rows = self.spark.read.option("basePath", folder).parquet(folder).where(F.col("part").isin(mine)).drop("part")
            frames = rows if frames is None else frames.unionByName(rows, allowMissingColumns=True)
        return frames


class PriceStore:
    """One price per listing and day. A batch only appends its own rows as a delta; readers merge, the highest
    ``seq`` of a (listing, day) winning; ``compact`` folds deltas into the base as a job of its own.

    Batches are numbered upwards. A replayed batch takes its own delta's place; one that was folded already
    changes nothing. A compaction that stops at any point loses nothing: the manifest names the old base
    and all deltas until the new base is complete. An empty batch is a delta without rows."""

    BASE, FOLDED = "base", "folded"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root, ManifestLog(spark, root)

    def append(self, batch: DataFrame, batch_id: int) -> Manifest:
        def is_folded(seen: Manifest) -> bool:
            return batch_id <= int(seen.parts.get(self.FOLDED, -1))

        now = self.log.latest()
        if is_folded(now):
            return now
        folder = _folder(self.root, "delta")
        last_wins(batch, HISTORY_KEY, ["seq"]).write.parquet(folder)
        return self.log.change(lambda seen: None if is_folded(seen) else {**seen.parts, f"delta:{batch_id}": folder})

    @staticmethod
    def _deltas(manifest: Manifest) -> dict[str, str]:
        return {k: f for k, f in manifest.parts.items() if k.startswith("delta:")}

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The merged history of the latest (or a given) manifest; None before the first batch."""
        manifest = manifest or self.log.latest()
        rows = None
        for folder in self._deltas(manifest).values():
            delta = self.spark.read.parquet(folder)
            rows = delta if rows is None else rows.unionByName(delta, allowMissingColumns=True)
        if self.BASE in manifest.parts:
            base = self.spark.read.parquet(manifest.parts[self.BASE]).drop("scraped_month")
            if rows is None:
                return base
            rows = base.unionByName(rows, allowMissingColumns=True)
        return rows if rows is None else last_wins(rows, HISTORY_KEY, ["seq"])

    def folded(self, manifest: Manifest) -> str:
        """Writes the merged history of ``manifest`` by month and gives its folder. The rebalance hint lets
        adaptive execution split a month that holds a large share of the rows."""
        folder = _folder(self.root, "base")
        month = F.date_format("scraped_date", "yyyy-MM")
        self.read(manifest).withColumn("scraped_month", month).hint("rebalance", "scraped_month").write.partitionBy("scraped_month").parquet(folder)
        return folder

    def compact(self) -> Manifest:
        """Folds all deltas of now into a new base. Deltas that come meanwhile stay deltas."""
        then = self.log.latest()
        deltas = self._deltas(then)
        if not deltas:
            return then
        base, top = self.folded(then), max(int(k.split(":")[1]) for k in deltas)

        def swapped(seen: Manifest) -> dict[str, str] | None:
            if seen.parts.get(self.BASE) != then.parts.get(self.BASE):
                return None  # another compaction was first
            newer = {k: f for k, f in self._deltas(seen).items() if deltas.get(k) != f}
            return {self.BASE: base, self.FOLDED: str(max(top, int(seen.parts.get(self.FOLDED, -1)))), **newer}

        return self.log.change(swapped)
