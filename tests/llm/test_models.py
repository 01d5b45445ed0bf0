import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislegraph.llm.clustering import LONG_MAX, SortedCentroids, cluster_vectors, limbs
from aislegraph.llm.quality import Model, fit, score, sigmoid, train

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("v", T.StringType())])


def lloyd(rows, k, rounds, dims):
    """Every vector against every centroid, in whole numbers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assign()
    inertia = [sum(d for d, c in of if c == n) for n in range(len(centroids))]
    return sorted((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, of))


@pytest.mark.parametrize("k, dims, size", [(8, 64, 300), (5, 3, 4), (20, 2, 10), (1, 4, 5)])
def test_threshold_walk_finds_the_nearest_with_smaller_number(k, dims, size):
    rng = np.random.default_rng(k)
    centroids, x = rng.integers(-size, size, (k, dims)), rng.integers(-size, size, (600, dims))
    lists = SortedCentroids(centroids.tolist())
    number, best = lists.nearest(x)
    distance = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == distance.argmin(1)).all() and (best == distance.min(1)).all()
    assert all(lists.nearest_exact(v) == (n, d) for v, n, d in zip(x[:40].tolist(), number.tolist(), best.tolist()))


def test_limbs_sum_to_the_number():
    for n in (0, -1, 1 << 40, -(1 << 100) + 7, (1 << 64) - 1):
        assert sum(x << (32 * i) for i, x in enumerate(limbs(n))) == n


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(i % 4, 0.4, 6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one vector very often
    odd = [(2000, None), (2001, [1.0] * 5), (2002, [0.0] * 5 + [float("nan")]), (2003, [1.0] * 5 + [None]), (2004, [0.0] * 6), (2005, [float("inf")] * 6), (2006, [])]
    frame = spark.createDataFrame([(i, v, "?", "?") for i, v in rows + odd], VECTORS).repartition(5)
    got = cluster_vectors(frame, k=5, rounds=4, dims=6)
    assert sorted(tuple(r) for r in got.collect()) == lloyd(rows + odd, 5, 4, 6)


def test_few_huge_and_no_vectors(spark):
    few = [(1, [0.5] * 3), (2, [-0.5] * 3)]
    frame = spark.createDataFrame([(i, v, "?", "?") for i, v in few], VECTORS)
    assert sorted(tuple(r) for r in cluster_vectors(frame, dims=3).collect()) == lloyd(few, 8, 10, 3)
    huge = [*few, (3, [1e300, 0.0, 0.0]), (4, [1e306, 1.0, 1.0]), (5, [3e5, 0.0, 1.0]), (None, [0.25] * 3)]
    got = cluster_vectors(spark.createDataFrame([(i, v, "?", "?") for i, v in huge], VECTORS), k=2, dims=3).collect()
    assert len(got) == 6 and all(0 <= r["distance"] <= LONG_MAX for r in got)
    assert cluster_vectors(frame.limit(0), dims=3).count() == 0


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(4)
    cells, values, before = rng.integers(0, 4096, 30), rng.random(30), np.array([0, 12, 12, 30])
    model = Model(np.zeros((2, 7)), 0.3, rng.normal(size=4096 + 18), rng.normal(size=(4096 + 18, 8)))
    bins = model.bins(np.array([[0.1, np.nan], [-1.0, 2.0], [np.nan, np.nan]]))
    for t, margin in enumerate(model.margins(before, cells, values, bins)):
        x = [*zip(cells[before[t] : before[t + 1]], values[before[t] : before[t + 1]]), *((b, 1.0) for b in bins[t])]
        pairs = sum(model.factors[a] @ model.factors[b] * p * q for n, (a, p) in enumerate(x) for b, q in x[n + 1 :])
        assert margin == pytest.approx(0.3 + sum(model.weights[c] * v for c, v in x) + pairs)


def test_training_learns_a_pair_that_no_cell_tells():
    rng = np.random.default_rng(6)
    one, two = rng.integers(0, 2, (2, 800))
    cells = np.stack([one, 2 + two], 1).ravel()
    before, numbers, labels = np.arange(801) * 2, np.zeros((800, 1)), (one ^ two).astype(float)
    model = fit(before, cells, np.ones(1600), numbers, labels)
    good = sigmoid(model.margins(before, cells, np.ones(1600), model.bins(numbers)))
    assert ((good > 0.5) == labels).mean() > 0.95


def label_frames(spark, make_docs, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(5, 80))]
        bad = i % 6 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_rows(spark, make_docs, docs, texts):
    rows, labels = label_frames(spark, make_docs)
    model = train(rows, labels.where("doc_id % 5 <> 0"))
    judged = score(rows, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert len(judged) == 120 and sum(r["predicted"] == r["quality"] for r in judged) >= 117
    every = score(docs, model).collect()
    assert sorted(r["doc_id"] for r in every) == sorted(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in every)


def test_quality_without_labels_metadata_nulls_and_copies(spark, make_docs, empty):
    rows, labels = label_frames(spark, make_docs)
    assert train(rows, labels.where("false")) is None and train(empty, labels) is None
    assert {r["score"] for r in score(rows, None).collect()} == {0.5}
    one_class = train(rows, labels.where("quality = 1"))
    assert min(r["score"] for r in score(rows, one_class).collect()) > 0.5
    both = labels.unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int")))
    told = rows.withColumn("size", F.when(F.col("doc_id") % 2 == 0, F.length("text")))
    model = train(told.unionByName(told.where("doc_id < 9")), both, metadata=["size"])
    assert score(told, model, ["size"]).count() == 600
    assert score(empty, one_class).count() == 0


def test_same_model_however_rows_are_dealt(spark, make_docs):
    rows, labels = label_frames(spark, make_docs)
    one, two = train(rows.repartition(7), labels), train(rows.coalesce(1), labels.repartition(3))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.factors, two.factors)


alignment = pytest.importorskip("aislegraph.llm.alignment") if pytest.importorskip("public_tokenizers") else None


def test_pieces_of_the_merge_are_equal_and_stitch():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        top = int(rng.integers(n, 3 * n + 1))
        a, b = (np.unique(np.append(rng.integers(1, top + 1, n), top)) for _ in range(2))
        common = np.intersect1d(a, b)
        for piece in (1, 2, 3, 7, 1000):
            i, j = alignment.split_points(a, b, piece)
            work = np.diff(i + j)
            assert i[-1] == len(a) and j[-1] == len(b) and (work >= 0).all() and (work <= piece + 1).all()
            last_a, last_b = alignment.merge_ends(a, b, piece)
            assert (a[last_a] == common).all() and (b[last_b] == common).all()


def test_overlaps_are_all_pairs_that_share_bytes():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 5, 8, 9])
    one, two, both = alignment.merge_piece(a, b)
    spans = lambda ends: list(zip([0, *ends[:-1]], ends))
    share = {(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if max(s, t) < min(e, f)}
    assert set(zip(one.tolist(), two.tolist())) == share and both.sum() == 2


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {chr(letter): byte for byte, letter in alignment.byte_letters().items()}
    results, counts = [], Counter()
    for doc_id, text in rows:
        numbers, digest, links = (0, 0, 0, 0), "", []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_bytes = [bytes(byte_of[c] for c in first.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (list(np.cumsum([len(x) for x in y])) for y in (a_bytes, b_bytes))
                groups, i, j = [], 0, 0
                at_a, at_b = {e: n for n, e in enumerate(a_ends)}, {e: n for n, e in enumerate(b_ends)}
                for end in sorted(set(a_ends) & set(b_ends)):
                    stop_a, stop_b = at_a[end] + 1, at_b[end] + 1
                    groups.append((a[i:stop_a], b[j:stop_b]))
                    i, j = stop_a, stop_b
                links = [(x, y) for one, two in groups for x in one for y in two]
                numbers = (len(a), len(b), len(groups), len(links))
                digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
        counts.update(set(links))
        results.append((doc_id, numbers, links, digest))
    highest: dict = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    return Counter((d, *n, sum(counts[k] == highest[k[0]] for k in links), sum(counts[k] for k in links), s) for d, n, links, s in results)


@pytest.mark.parametrize("block_bytes", [20_000, 6_000_000])
def test_alignment_equals_plain_groups(make_docs, texts, block_bytes):
    import public_tokenizers

    rows = [*texts.items(), (900, "▁a"), (901, "  x  "), (902, "a\x00b"), (903, "<s> </s>"), (904, "日本語 ÿ ﬁ"), (900, "again"), (None, "no id"), (None, None)]
    got = alignment.align_documents(make_docs(rows).repartition(5), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), block_bytes)
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment(rows)


def test_wide_groups_in_parts():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 300)
    last_a, last_b = np.array([3, 150, 199]), np.array([0, 250, 299])
    got = {}
    for limit in (1, 10, 700, 10**6):
        doc, key, count = alignment.linked_pairs(a, b, last_a, last_b, np.array([0, 0, 1]), limit)
        got[limit] = list(zip(doc.tolist(), key.tolist(), count.tolist()))
    assert got[1] == got[10] == got[700] == got[10**6] and sum(n for _, _, n in got[1]) == 4 * 1 + 147 * 250 + 49 * 49


def test_no_documents(empty):
    import public_tokenizers

    assert alignment.align_documents(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
