import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from aislegraph.llm.packing import pack_documents, plan_slots
from aislegraph.llm.token_files import TokenFileReader, TokenFileWriter, read_documents, shared_folder, write_token_files
from aislegraph.llm.tokens import piece_tokenizer
from aislegraph.llm.text import text_buffer


def path(name):
    return public_tokenizers.path(name)


def plain_ids(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_tokenizers_ids(name, blanks, texts):
    odd = ["a  b\n\n c\t\td ", "   x b", "l'État × ÷ À\n-- ，。", "DON'T we'll '90s", "x\r\ny  \n", " a", "ΣΑΣ İI", "q\x1cw"]
    every = [t for t in texts.values() if t is None or len(t) < 5000] + odd
    tokens, before = piece_tokenizer(path(name), blanks).encode(*text_buffer(pa.array(every, pa.string())))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path(name))
    for i, t in enumerate(every):
        assert tokens[before[i] : before[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_packing_places_every_token_once(docs, texts, empty):
    limit = 64
    rows = pack_documents(docs, path("byte_bpe_50k.json"), limit, keep_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [x for p in pieces for x in p["ids"]]
        if t is None or len(t) < 5000:
            assert ids == [*plain_ids("byte_bpe_50k.json", t), 0]
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(p["length"] == limit for p in pieces[1:]) and pieces[0]["start"] == 0
        assert all(p["ids_crc32"] == crc(p["ids"]) for p in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // limit) * 1.1 + 1
    assert pack_documents(empty, path("byte_bpe_50k.json")).count() == 0


def test_repeated_rows_are_packed_each(make_docs):
    rows = pack_documents(make_docs([(1, "same text")] * 7 + [(None, None)]), path("byte_bpe_50k.json"), 8).collect()
    assert len(rows) == 8 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 8


def test_plan_equals_best_fit_document_by_document():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1].tolist()
    counts = {int(n): lengths.count(n) for n in set(lengths)}
    plan = plan_slots(counts, 100)
    used = set()
    for length, low, high, first, offset, each in plan:
        for r in range(low, high):
            used.add((first + (r - low) // each, offset + (r - low) % each * length, length))
    assert len(used) == 500
    bins = []
    for n in lengths:
        fit = [k for k, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(100 - n)
    assert len({s for s, *_ in used}) == len(bins)


def test_files_round_trip_in_order(spark, docs, texts, empty):
    files = write_token_files(docs, shared_folder(spark, "t"), path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in read_documents(files).collect()}
    start = 0
    for i in sorted(texts):
        if texts[i] is None or len(texts[i]) < 5000:
            ids = [*plain_ids("word_bpe_49k.json", texts[i]), 1]
            assert (rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (len(ids), crc(ids))
        assert rows[i]["start"] == start
        start += rows[i]["n_tokens"]
    some = read_documents(files, [3, 7], keep_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in some} == {i: [*plain_ids("word_bpe_49k.json", texts[i]), 1] for i in (3, 7)}
    assert read_documents(write_token_files(empty, shared_folder(spark, "t"), path("word_bpe_49k.json"))).count() == 0


def test_frames_are_independent_and_checked():
    zstandard = pytest.importorskip("zstandard")

    class Sink(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    sink = Sink()
    writer = TokenFileWriter(sink)
    docs = {5: np.arange(10), None: np.arange(100_000) % 977, 9: np.arange(3), 5000: np.zeros(0, int)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = TokenFileReader(Source(sink.data))
    assert reader.doc_ids == list(docs)
    for k, ids in enumerate(docs.values()):
        assert reader.ids(k).tolist() == ids.tolist()
    first = zstandard.ZstdDecompressor().decompress(sink.data[: reader.packed[1]])
    assert first[:40] == np.arange(10, dtype="<u4").tobytes()
    broken = bytearray(sink.data)
    reader = TokenFileReader(Source(bytes(broken)))
    reader.checks[0] ^= 1
    with pytest.raises(ValueError):
        reader.ids(0)
