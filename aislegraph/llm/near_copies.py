"""Near-duplicate documents by a chosen-path set similarity join.

Each document is the set of its distinct five-word shingles. A tree starts with all sets at its
root, which branches on one position of the sets' minwise signatures, another for each tree. A
node below picks positions at random, 1 / similarity of them on average and one at least, and each
set goes to one child for each of them, named by the token it has there. Children with few sets are
compared with all pairs in them; larger ones branch again, on ``DRAWS`` positions each. ``trees``
independent trees are grown.

A pair shares a large node's child unless it differs in all DRAWS positions. Two sets as similar as
the threshold share 1.5 children a level, more than one, so the chance that they stay together in
some child goes to 0.89 with depth and no lower. The pair shares no leaf of any of 20 trees with
probability 4e-9 where leaves are at the second level and below 1e-7 at any depth (by
arithmetic, for signatures that agree as often as expected); apart from that ``LIKELY`` decides.

Groups of near copies do not split under branching. In a large node every set is therefore
compared with one of them, the leader; sets that are linked to it leave the node unless the
distances (Jaccard distance is a metric) leave room for a link to a set that is not. What is still
large after ``LEVELS`` more levels is compared in pairs of blocks of bounded size.

Signatures only pick pairs; every link is confirmed on the full sets. Pairs whose ends are
already connected need no check: first a spanning forest of each leaf is confirmed, then leaves
that still hold likely pairs of different components are settled on the full sets of those pairs'
members, one copy of a set for each leaf and no row for each pair. Copies of one set are one set throughout.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; a text
of fewer than five words is one shingle; rows that share a doc_id are one document; a row with
null doc_id is alone (component_id null, kept); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.components import connected_components
from aislegraph.llm.text import byte_hashes, give_back, gram_hashes, lower_table, mix, ragged, slices, span_hashes, text_buffer, word_spans
from aislegraph.session import cut_lineage, release

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
POSITIONS = 128
TREES = 20
DRAWS = 2
LEAF_SETS = 2_500
LEVELS = 3
LIKELY = 79  # of POSITIONS; a pair at the threshold agrees less often once in 4,000 cases
ESTIMATE_SLACK = 0.15
MASK_BITS = 23


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, offsets = text_buffer(texts)
    starts, ends, before = word_spans(buf, offsets)
    words = byte_hashes(lower_table()[buf], starts, ends)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(span_hashes(words[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SEEDS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the set's values under each of POSITIONS hash functions, cut to 16 bits."""
    out = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 1024):
        h = shingles[at : at + 1024, None] * _SEEDS[None, :]
        out = np.minimum(out, (h >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (null for the empty set), signature of each row (stored)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1))
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signatures = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "fingerprint", "signature"],
            )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut_lineage(rows.mapInArrow(work, "doc_id long, n_shingles long, fingerprint binary, signature binary"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS)


def draws(nodes: np.ndarray) -> np.ndarray:
    """A random number for each node and position."""
    return mix(nodes[:, None] + _SEEDS[None, :])


def chosen(nodes: np.ndarray) -> np.ndarray:
    """For each node, which positions it branches on: a random 1 / (similarity * POSITIONS) of them, one at least."""
    draw = draws(nodes)
    return (draw < np.uint64(int((1 << 64) * 100 / (SIMILARITY_PERCENT * POSITIONS)))) | (draw == draw.min(axis=1, keepdims=True))


def chosen_large(nodes: np.ndarray) -> np.ndarray:
    """The same for large nodes: DRAWS positions each, so that no node loses its rows and pairs stay together."""
    draw = draws(nodes)
    return draw <= np.partition(draw, DRAWS - 1, axis=1)[:, DRAWS - 1 : DRAWS]


def children(nodes: np.ndarray, signatures: np.ndarray, choose=chosen) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes of sets in nodes."""
    row, position = np.nonzero(choose(nodes))
    child = mix(mix(nodes[row] + _SEEDS[position]) + signatures[row, position])
    return row, child


def root_positions(trees: int) -> np.ndarray:
    """The position that each tree's root branches on; they differ as long as there are enough."""
    return np.argsort(mix(_SEEDS))[np.arange(trees) % POSITIONS]


def grow_roots(sets: DataFrame, trees: int) -> DataFrame:
    """node, id of the second level of all trees: sets that share one line part here already."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signatures = _matrix(batch.column(1))
                for root, position in zip(roots, root_positions(trees), strict=True):
                    child = mix(mix(root + _SEEDS[position : position + 1]) + signatures[:, position])
                    row, child = children(child, signatures)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(0).take(pa.array(row))], ["node", "id"])

    return sets.select("id", "signature").mapInArrow(work, "node long, id long")


def grow(rows: DataFrame) -> DataFrame:
    """The next level below rows (node, id, signature) of large nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, child = children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2)), chosen_large)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(row))], ["node", "id"])

    return rows.select("node", "id", "signature").mapInArrow(work, "node long, id long")


def populated(rows: DataFrame) -> DataFrame:
    """node, id, size of nodes with two sets or more; of nodes with equal sets one is enough."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum(F.xxhash64("id") % 1_000_000_007).alias("one"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("two"))
    nodes = nodes.where("size > 1").groupBy("size", "one", "two", "low").agg(F.min("node").alias("node"))
    return rows.join(nodes.select("node", "size"), "node")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each leaf, from rows sorted by leaf."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        leaf = rest["leaf"].to_numpy()
        if leaf[0] == leaf[-1]:
            continue
        cut = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1
        yield from _split(rest.slice(0, cut))
        rest = rest.slice(cut)
    if rest is not None:
        yield from _split(rest)


def _split(rows: pa.Table) -> Iterator[pa.Table]:
    edges = [0, *(np.flatnonzero(np.diff(rows["leaf"].to_numpy())) + 1).tolist(), rows.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield rows.slice(a, b - a)


def _likely(component: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely similar pairs of sets of different components in a leaf, and in how many positions they agree."""
    first, second = np.triu_indices(len(component), 1)
    other = component[first] != component[second]
    first, second = first[other], second[other]
    parts = [(signatures[first[i : i + 4096]] == signatures[second[i : i + 4096]]).sum(axis=1) for i in range(0, len(first), 4096)]
    agree = np.concatenate([np.zeros(0, np.int64), *parts])
    use = np.flatnonzero(agree >= LIKELY)
    return first[use], second[use], agree[use]


def _forest(a: np.ndarray, b: np.ndarray, agree: np.ndarray, component: np.ndarray) -> list[int]:
    """Pairs of a spanning forest over components, those that agree most first."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = top(int(component[a[k]])), top(int(component[b[k]]))
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def likely_forest(leaves: DataFrame) -> DataFrame:
    """Distinct pairs (a < b): a spanning forest of the likely similar sets of different components of
    each leaf (leaf, id, component, signature)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _leaves(batches):
            ids, component = leaf["id"].to_numpy(), leaf["component"].to_numpy()
            if component.min() != component.max():
                first, second, agree = _likely(component, _matrix(leaf["signature"]))
                keep = _forest(first, second, agree, component)
                x, y = ids[first[keep]], ids[second[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        give_back()

    return _by_leaf(leaves).mapInArrow(work, "a long, b long").where("a <> b").distinct()


def _by_leaf(leaves: DataFrame, *more: str) -> DataFrame:
    return leaves.select("leaf", "id", "component", *(more or ("signature",))).repartition("leaf").sortWithinPartitions("leaf")


def settle_leaves(leaves: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, common, either: links between different components of each leaf, a spanning forest of all
    there are (stored). Leaves that hold a likely pair of different components get the full sets of
    those pairs' members, and are compared by an inverted index within the leaf."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _leaves(batches):
            component = leaf["component"].to_numpy()
            if component.min() != component.max():
                first, second, _ = _likely(component, _matrix(leaf["signature"]))
                use = pa.array(np.unique(np.concatenate([first, second])))
                yield from leaf.select(["leaf", "id", "component"]).take(use).combine_chunks().to_batches()

    open_rows = cut_lineage(_by_leaf(leaves).mapInArrow(work, "leaf long, id long, component long"))
    sets = full_sets(open_rows.select("id").distinct(), docs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _leaves(batches):
            out = list(zip(*_linked(leaf["id"].to_numpy(), leaf["component"].to_numpy(), [np.frombuffer(x, np.uint64) for x in leaf["set"].to_pylist()]), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "common", "either"])
        give_back()

    found = _by_leaf(open_rows.join(sets, "id"), "set").mapInArrow(compare, "a long, b long, common long, either long")
    return cut_lineage(found.distinct())


def _linked(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(token, minlength=len(tokens))
    begin = np.cumsum(held) - held
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    names, counts = np.unique(component, return_counts=True)
    parent = {int(c): int(c) for c in names}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in np.flatnonzero(component != names[np.argmax(counts)]).tolist():  # of two components one is not the largest
        own = token[ends[x] - sizes[x] : ends[x]]
        common = np.bincount(holder[ragged(begin[own], held[own])], minlength=len(sets))
        either = sizes[x] + sizes - common
        for y in np.flatnonzero((100 * common >= SIMILARITY_PERCENT * either) & (component != component[x])).tolist():
            p, q = top(int(component[x])), top(int(component[y]))
            if p != q:
                parent[p] = q
                a, b = sorted((int(ids[x]), int(ids[y])))
                out.append((a, b, int(common[y]), int(either[y])))
    return out


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, set: the full shingle sets of the documents named (stored)."""
    mask = ids.sparkSession.sparkContext.broadcast(id_mask(ids))  # 2 ** MASK_BITS bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(mask.value, dtype=np.uint8), bitorder="little")
        for batch in batches:
            own = batch.filter(pa.array(bits[batch.column(2).to_numpy()].astype(bool)))
            for part in slices(iter([own])):
                sets = shingle_sets(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL").withColumn("bit", mask_bit("id"))
    return cut_lineage(rows.mapInArrow(work, "id long, set binary").join(ids, "id", "left_semi"))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, common, either (sizes of intersection and union) on the full sets of the pairs (stored)."""
    pairs = cut_lineage(pairs.select("a", "b"))
    sets = full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            common, either = [], []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                common.append(both)
                either.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "common", "either"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return cut_lineage(both.mapInArrow(judge, "a long, b long, common long, either long").groupBy("a", "b").agg(F.max("common").alias("common"), F.min("either").alias("either")))


def mask_bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << MASK_BITS))


def id_mask(ids: DataFrame) -> bytes:
    """A bit mask of fixed size that holds all ids; when it fills up it lets more rows through, no fewer."""
    size = 1 << (MASK_BITS - 8)

    def bits(group: pa.Table) -> pa.Table:
        own = np.zeros(size, dtype=np.uint8)
        own[group["bit"].to_numpy() % size] = 1
        return pa.table({"slice": group["slice"].slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    rows = ids.select(mask_bit("id").alias("bit")).distinct().withColumn("slice", (F.col("bit") / size).cast("int"))
    held = {r["slice"]: bytes(r["bits"]) for r in rows.groupBy("slice").applyInArrow(bits, "slice int, bits binary").collect()}
    return b"".join(held.get(k, bytes(size // 8)) for k in range(256))


LINKED = f"100 * common >= {SIMILARITY_PERCENT} * either"


def leader_pass(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compares each set of a large node (node, id, signature) with the node's leader. Returns the
    confirmed pairs, and the rows that may still have other links."""
    leaders = rows.groupBy("node").agg(F.min("id").alias("leader"))
    leaders = leaders.join(rows.select("node", F.col("id").alias("leader"), F.col("signature").alias("own")), ["node", "leader"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_matrix(batch.column("signature")) == _matrix(batch.column("own"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), batch.column("leader"), pa.array(agree.astype(np.int32))], ["node", "id", "leader", "agree"])

    seen = cut_lineage(rows.join(leaders, "node").mapInArrow(work, "node long, id long, leader long, agree int"))
    pairs = confirm(seen.where((F.col("agree") >= LIKELY) & (F.col("id") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), docs)
    far = seen.join(pairs.withColumnRenamed("a", "leader").withColumnRenamed("b", "id"), ["leader", "id"], "left")
    exact = 1 - F.col("common") / F.col("either")
    far = far.withColumn("linked", F.coalesce(F.expr(LINKED), F.lit(False)) | (F.col("id") == F.col("leader")))
    far = far.withColumn("distance", F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.coalesce(exact, 1 - F.col("agree") / POSITIONS - ESTIMATE_SLACK)))
    nearest = far.where(~F.col("linked")).groupBy("node").agg(F.min("distance").alias("nearest"))
    room = F.col("distance") + (1 - SIMILARITY_PERCENT / 100) >= F.col("nearest")
    left = far.join(nearest, "node").where(~F.col("linked") | room)
    return pairs, left.select("node", "id").join(rows, ["node", "id"])


def block_pairs(rows: DataFrame) -> DataFrame:
    """leaf, id: sets of large nodes (node, id, size) in pairs of blocks of about LEAF_SETS / 2."""
    blocks = F.ceil(F.col("size") / (LEAF_SETS // 2)).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "id")


def near_copies(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    described = describe(docs)
    usable = described.where("fingerprint IS NOT NULL AND doc_id IS NOT NULL")
    sets = cut_lineage(usable.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    signatures = sets.groupBy("id").agg(F.first("signature").alias("signature"))
    copies = usable.join(sets.select("fingerprint", "id"), "fingerprint").select("doc_id", "id")

    leaves, links = [], []
    release(docs.sparkSession)
    rows = cut_lineage(populated(grow_roots(sets, trees)))
    release(docs.sparkSession)
    for level in range(LEVELS):
        leaves.append(rows.where(F.col("size") <= LEAF_SETS).select(F.col("node").alias("leaf"), "id"))
        large = rows.where(F.col("size") > LEAF_SETS).select("node", "id")
        if large.isEmpty():
            rows = None
            break
        large = cut_lineage(large.join(signatures, "id").select("node", "id", "signature"))
        pairs, left = leader_pass(large, docs)
        links.append(pairs)
        rows = cut_lineage(populated(grow(left)))
        large = left = None
        release(docs.sparkSession)
    if rows is not None:
        leaves.append(rows.where(F.col("size") <= LEAF_SETS).select(F.col("node").alias("leaf"), "id"))
        leaves.append(block_pairs(rows.where(F.col("size") > LEAF_SETS)))

    leaf_rows = leaves[0]
    for more in leaves[1:]:
        leaf_rows = leaf_rows.union(more)
    leaf_rows = cut_lineage(leaf_rows.join(signatures, "id"))
    leaves = rows = large = more = None
    release(docs.sparkSession)
    # A set linked to a leader is in the leader's component.
    labels = _union(links).where(LINKED).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")) if links else None
    pairs = likely_forest(_labelled(leaf_rows, labels))
    if links:
        pairs = pairs.join(_union(links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links.append(confirm(pairs, docs))
    pairs = None
    release(docs.sparkSession)
    labels = connected_components(_union(links).where(LINKED))
    links.append(settle_leaves(_labelled(leaf_rows, labels), docs))
    leaf_rows = None
    release(docs.sparkSession)
    if not links[-1].isEmpty():
        labels = connected_components(_union(links).where(LINKED))
    grouped = copies.distinct().join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    # A doc_id with several texts joins their groups.
    grouped = grouped.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    return described.join(grouped, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
