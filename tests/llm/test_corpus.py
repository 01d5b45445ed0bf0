import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislegraph.llm import language, leaks, near_copies, repeats, scoring
from aislegraph.llm.components import connected_components


def split(text):
    return (text or "").encode().split()


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def components_of(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_copies_equal_all_pairs(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(docs).collect()}
    assert got == components_of(texts)
    assert near_copies.near_copies(empty).count() == 0


def test_large_groups_take_the_leader_and_block_paths(make_docs, monkeypatch):
    monkeypatch.setattr(near_copies, "LEAF_SETS", 6)
    rng = random.Random(5)
    texts = {}
    for g in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):  # copies that drift, so that some are linked through others only
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    for _ in range(30):
        texts[len(texts)] = " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(make_docs(texts.items())).collect()}
    assert got == components_of(texts)


def test_large_nodes_keep_recall(make_docs, monkeypatch):
    """Thousands of unlinked documents of one template, 600 pairs at 0.758 among them."""
    monkeypatch.setattr(near_copies, "LEAF_SETS", 100)
    rng = random.Random(11)
    own = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = own(85), {}
    for i in range(2400):
        w = own(35)
        texts[i] = " ".join(template + w)
        if i < 600:
            texts[10_000 + i] = " ".join(template + w[:-16] + own(16))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(texts.items())).collect()}
    assert got == {i: i % 10_000 for i in texts}


def test_pairs_stay_together_five_levels_down(spark):
    """Signatures of 1,500 pairs at the threshold, in nodes that all branch again."""
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 1 << 16, (1500, 2, 128)).astype(np.uint16)
    for pair in signatures:
        same = rng.permutation(128)[:96]
        pair[1, same] = pair[0, same]
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(signatures.reshape(-1, 128))], "id long, signature binary").cache()
    rows = near_copies.grow_roots(sets, near_copies.TREES)
    for _ in range(near_copies.LEVELS):
        rows = near_copies.grow(rows.join(sets, "id"))
    together = rows.distinct().withColumn("pair", F.expr("id div 2")).groupBy("node", "pair").count().where("count = 2")
    assert together.select("pair").distinct().count() == 1500


def test_repeated_and_null_ids(make_docs):
    rows = near_copies.near_copies(make_docs([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 299), (299, 298)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and got[300] == 298


def repeats_of(texts, window):
    all_words = {i: split(t) for i, t in texts.items()}
    seen = Counter(tuple(w[j : j + window]) for w in all_words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in all_words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("window, block", [(35, 2_000_000), (35, 20_000), (10, 5_000), (3, 5_000)])
def test_repeats_equal_brute_force(docs, texts, window, block):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs, window, block_bytes=block, keep_text=True).collect()}
    assert got == repeats_of(texts, window)


def test_repeats_of_nothing_and_of_repeated_rows(empty, make_docs):
    assert repeats.remove_repeats(empty).count() == 0
    w = " ".join(str(i) for i in range(40))
    assert [r["n_removed"] for r in repeats.remove_repeats(make_docs([(1, w), (1, w), (None, None)])).orderBy("n_words").collect()] == [0, 40, 40]
    assert repeats.levels(35, 9) == [9, 18, 35]


def test_scores_equal_brute_force(docs, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [w.lower() for w in split(t)] + [None] for i, t in texts.items()}
    train = {i: t for i, t in tokens.items() if not held(i)}
    one, two = Counter(), Counter()
    for t in train.values():
        one.update(t)
        two.update(zip(["<s>", *t], t))
    one["<s>"] = len(train)
    n, v = sum(one.values()) - len(train), len(one) - 1
    cells = Counter()
    for t in train.values():
        own, pairs = Counter(t), Counter(zip(["<s>", *t], t))
        own["<s>"] = 1
        for a, b in zip(["<s>", *t], t):
            c = one[a] - own[a]
            p2 = (two[a, b] - pairs[a, b]) / c if c else 0.0
            p1 = (one[b] - own[b]) / (n - len(t))
            cells[tuple(int(x[0]) for x in (scoring.bucket_of(np.array([c])), scoring._bin(np.array([p2])), scoring._bin(np.array([p1]))))] += 1
    weights = scoring.learn_weights(sorted((*k, m) for k, m in cells.items()), v)
    assert np.allclose(weights.sum(axis=1), 1)
    got = {r["doc_id"]: r for r in scoring.score_documents(docs, held, block_bytes=20_000).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(one[x] > 0 for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        want = 0.0
        for a, b in zip(["<s>", *t], t):
            w = weights[scoring.bucket_of(np.array([one[a]]))[0]]
            want += math.log10(w[0] * (two[a, b] / one[a] if one[a] else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-6), i


def test_scores_without_training_rows(make_docs, empty):
    assert scoring.score_documents(empty, lambda i: False).count() == 0
    row = scoring.score_documents(make_docs([(1, "a b"), (None, None)]), lambda i: True).orderBy("n_tokens").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in row] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_language_held_out_accuracy_and_cases(spark, make_docs, empty):
    rng = random.Random(2)
    parts = {"en": "the ing ation er of th and".split(), "de": "sch ung ein keit der und ü".split(), "fr": "eau oi aux é que le ment".split()}
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(1 + rng.randrange(3))) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !!", "de"), (1003, "ünd", None), (1004, "日本", None), (1005, "a", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(make_docs((i, t) for i, t, _ in rows), model).collect()}
    held = [i for i, _, lang in rows[:300] if i % 4 == 2]
    assert sum(got[i][0] == ["en", "de", "fr"][i % 3] for i in held) >= 0.98 * len(held)
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1004][0] in parts and got[1005][0] in parts and all(0 <= s <= 1 for _, s in got.values())
    nothing = language.train(table.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in language.predict(table, nothing).collect()} == {"und"}
    assert language.predict(empty.drop("score"), model).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(4)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(30)]
        rows += [(100 * k + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(40)), f"l{k:02d}") for i in range(3 if k < 64 else 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language.predict(table, language.train(table)).collect()}
    assert got == {i: (lang, True) for i, _, lang in rows}


def test_leaks_with_edits_and_nothing_else(spark, make_docs, empty):
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(i, sentence(35)) for i in range(20)] + [(90, None), (91, ""), (92, "too short")]
    bench = spark.createDataFrame([(*r, "?") for r in items], "item_id long, text string, doc_id string")
    docs, want = [], set()
    for i, text in items[:20]:
        filler, tail = sentence(200), sentence(20)
        changed = text.upper().replace(" ", ",\n ")
        w = text.split()
        w[10], w[22] = w[10] + "x", w[22][1:]
        for k, inner in enumerate((text, changed, " ".join(w), text[len(text) // 4 :])):
            docs.append((100 * i + k, f"{filler} {inner} {tail}"))
            want.add((100 * i + k, i))
        docs.append((100 * i + 9, f"{filler} {text[:40]} {tail}"))
    docs += [(5000, None), (5001, ""), (5002, "x" * 30_000), (None, items[3][1])]
    want.add((None, 3))
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(make_docs(docs), bench).collect()}
    assert set(got) == want
    exact = got[0, 0]
    text = dict(docs)[0]
    assert exact["edits"] == 0 and text[exact["start"] : exact["end"]].strip() == items[0][1]
    flagged = leaks.flag_documents(make_docs(docs), bench).where("contaminated")
    assert {r["doc_id"] for r in flagged.collect()} == {d for d, _ in want}
    assert leaks.find_leaks(empty, bench).count() == leaks.find_leaks(make_docs(docs), bench.limit(0)).count() == 0


def test_leaks_of_stretches_at_every_offset_and_of_short_items():
    rng = random.Random(21)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    item = sentence(60)[:117].strip()
    passages = leaks.cut_passages([(7, item), (8, "Who wrote it?"), (9, "qux"), (10, " ?! ")], leaks.PASSAGE_CHARS, leaks.EDITS)

    def found(texts):
        raw = [t.encode() for t in texts]
        folded = leaks.fold_texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        return {(text, passages.item[owner]) for text, owner, *_ in leaks.find_regions(folded, passages)}

    for size in (60, 70, 78, 90):
        own = [item[at : at + size] for at in range(len(item) - size + 1) if " " not in (item[at], item[at + size - 1])]
        assert found([f"{sentence(9)} zz{x}zz {sentence(9)}" for x in own]) == {(k, 7) for k in range(len(own))}, size
        assert found(own[1:9]) == {(k, 7) for k in range(8)}, size
    assert found(["a who, WROTE it b", "awho wrote it", "who wrote itb", "qux", "x quxx xqux", "", "who wrote"]) == {(0, 8), (3, 9)}


def test_alignment_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(60):
        pattern = [rng.randrange(4) for _ in range(30)]
        inner = list(pattern)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(inner))
            rng.choice([lambda: inner.pop(at), lambda: inner.insert(at, 9), lambda: inner.__setitem__(at, 8)])()
        text = [5] * 7 + inner + [6] * 7
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        match = leaks.align(np.array(pattern), np.array(text), 0, 14, 6)
        assert match is not None and match[0] == min(row)


def test_search_meets_brute_force(spark):
    from aislegraph.llm.multi_index import search

    rng = np.random.default_rng(1)
    x = rng.normal(size=(9_500, 16))
    x[3000:6000] = x[3000]  # one vector that holds a third of all rows
    rows = [(i, v.tolist(), "?") for i, v in enumerate(x)]
    rows += [(100_000, None, "?"), (100_100, [0.0] * 16, "?"), (100_200, [1.0, None] + [0.0] * 14, "?"), (100_300, [float("nan")] * 16, "?"), (100_400, [1.0], "?"), (None, [1.0] * 16, "?")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in search(table, F.pmod("vec_id", F.lit(100)) == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == set(range(0, 9_500, 100))
    for q, found in got.items():
        found.sort()
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        order = np.lexsort((np.arange(len(x)), distance))[:10]
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(abs(s - distance[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(order.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert search(table.limit(0), F.pmod("vec_id", F.lit(100)) == 0).count() == 0
    few = search(table.where("vec_id < 4"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert len(few) == 3


def test_cells_decide_in_small_tables_too(spark):
    """Under half of the rows are looked at and nine in ten neighbours are found."""
    from aislegraph.llm.multi_index import RECALL, fit, measured_share, nearest_cells, search

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 1_200)] * 4 + rng.normal(size=(1_200, 12)) * 0.3
    books = fit(x, 12)
    share = measured_share(x, books, 10, RECALL)
    one, two = books.halves(x)
    cells = one.argmin(1) * len(books.second) + two.argmin(1)
    sizes = {int(c): int(n) for c, n in zip(*np.unique(cells, return_counts=True))}
    seen = [np.isin(cells, nearest_cells(one[q], two[q], sizes, max(11, int(np.ceil(share * len(x)))))).sum() for q in range(0, 1_200, 50)]
    assert max(seen) < len(x) / 2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in search(table, F.pmod("vec_id", F.lit(50)) == 0).collect():
        distance = ((x - x[r["query_id"]]) ** 2).sum(1)
        distance[r["query_id"]] = np.inf
        hits += r["vec_id"] in np.argsort(distance, kind="stable")[:10]
    assert hits >= 0.9 * 240
