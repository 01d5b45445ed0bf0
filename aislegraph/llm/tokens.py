"""Token ids of whole texts from a public tokenizer file, one piece of text at a time.

Both vocabularies cut a text into pieces by its characters' classes before any merge, so a
piece has the same ids wherever it stands. Pieces of ASCII and accented Latin letters are cut
here for a whole slice at once; a chunk (a word and, at byte level, the blanks before it)
with anything else in it goes to the tokenizer as one piece, which is right because no token
crosses the point where blanks begin. Each distinct piece of a slice is tokenized once and
kept in a bounded cache of the worker. Texts with blanks beyond ASCII or with the
vocabulary's special strings go whole to the tokenizer.

Defined cases: null and empty texts have no ids; a piece of any length is merged as one.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from aislegraph.llm.text import byte_hashes, ragged

CACHE_PIECES = 400_000
# UTF-8 of the white space beyond ASCII (U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000).
OTHER_BLANKS = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
BLANK, LETTER, DIGIT, OTHER, HARD = range(5)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = LETTER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[0x80:] = HARD
    return table


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(spare) for b in range(256)}


class PieceTokenizer:
    """``keep_blanks``: byte-level pieces, which may begin with a blank; else lower-cased ones without blanks."""

    def __init__(self, path: str, keep_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_blanks = keep_blanks
        self.cache: dict[bytes, bytes] = {}
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join([OTHER_BLANKS, *special]))

    def _whole_ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _ids_of(self, pieces: list[bytes], hard: list[bool]) -> list[bytes]:
        found = [self.cache.get(p) for p in pieces]
        letters, merge = byte_letters(), self.tokenizer.model.tokenize
        for i, known in enumerate(found):
            if known is None:
                p = pieces[i]
                ids = self._whole_ids(p) if hard[i] else [t.id for t in merge(p.decode("latin-1").translate(letters))]
                found[i] = np.array(ids, dtype=np.uint32).tobytes()
                if len(p) <= 64:
                    if len(self.cache) >= CACHE_PIECES:
                        self.cache.clear()
                    self.cache[p] = found[i]
        return found

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, and whether each is a chunk that only the tokenizer can cut."""
        kind = class_table()[buf]
        accented = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
        kind[accented] = kind[accented + 1] = LETTER
        head = np.zeros(len(buf), dtype=bool)
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        blank = kind == BLANK
        chunk = head.copy()
        hard = kind == HARD
        mark = np.flatnonzero(buf[:-1] == ord("'"))
        hard[mark[np.isin(buf[mark + 1] | 0x20, np.frombuffer(b"strvmld", dtype=np.uint8))]] = True
        first = head.copy()
        first[1:] |= kind[1:] != kind[:-1]
        if self.keep_blanks:
            chunk[1:] |= blank[1:] & ~blank[:-1]
            hard[1:] |= blank[1:] & blank[:-1] & ~head[1:]
            first[1:] &= head[1:] | chunk[1:] | (buf[:-1] != 0x20)
        else:
            chunk[1:] |= ~blank[1:] & blank[:-1]
            chunk &= ~blank
            first |= kind == DIGIT
            first &= ~blank
        chunks, starts = np.flatnonzero(chunk), np.flatnonzero(first)
        if not len(starts):
            return starts, starts, np.zeros(0, dtype=bool)
        if self.keep_blanks:
            chunk_ends = np.append(chunks[1:], len(buf))
        else:
            last = np.ones(len(buf), dtype=bool)
            last[:-1] = blank[1:] | head[1:]
            chunk_ends = np.flatnonzero(last & ~blank) + 1
        chunk_hard = np.zeros(len(chunks), dtype=bool)
        chunk_hard[np.searchsorted(chunks, np.flatnonzero(hard), side="right") - 1] = True
        of = np.searchsorted(chunks, starts, side="right") - 1
        keep = ~chunk_hard[of] | (starts == chunks[of])
        starts, of = starts[keep], of[keep]
        ends = np.minimum(np.append(starts[1:], len(buf)), chunk_ends[of])
        return starts, ends, chunk_hard[of]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and the number of ids before each text (len + 1)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        plain = buf.tobytes()
        odd = {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in self.whole.finditer(plain)}
        if not self.keep_blanks:
            upper = (buf >= ord("A")) & (buf <= ord("Z"))
            accented = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
            upper[1:] |= accented
            buf = buf + (upper.astype(np.uint8) << 5)
        data = buf.tobytes()
        starts, ends, hard = self._pieces(buf, offsets)
        _, index, inverse = np.unique(byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        ids = self._ids_of([data[s:e] for s, e in zip(starts[index].tolist(), ends[index].tolist(), strict=True)], hard[index].tolist())
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        lengths = np.fromiter((len(x) >> 2 for x in ids), dtype=np.int64, count=len(ids))
        each = lengths[inverse]
        tokens = flat[ragged((np.cumsum(lengths) - lengths)[inverse], each)]
        before = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, offsets)]
        if odd:
            texts = [np.array(self._whole_ids(plain[offsets[i] : offsets[i + 1]]), dtype=np.uint32) if i in odd else tokens[before[i] : before[i + 1]] for i in range(len(offsets) - 1)]
            before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            tokens = np.concatenate(texts)
        return tokens, before


_OPEN: dict[tuple[str, bool], PieceTokenizer] = {}


def piece_tokenizer(path: str, keep_blanks: bool) -> PieceTokenizer:
    """One per worker process and file."""
    if (path, keep_blanks) not in _OPEN:
        _OPEN[path, keep_blanks] = PieceTokenizer(path, keep_blanks)
    return _OPEN[path, keep_blanks]
