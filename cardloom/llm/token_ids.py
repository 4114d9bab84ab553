"""Byte-level BPE ids of whole texts with the ``tokenizers`` library.

The library is asked once per distinct piece of text, not once per occurrence.
A text is cut before each ASCII white-space byte that follows a byte which
certainly ends a character other than white space, and between an ASCII letter and
ASCII punctuation.  No pretoken of the byte-level pattern reaches across such a point,
and the pattern looks only ahead, so the ids of a text are the ids of its pieces in a row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from cardloom.llm.workers import held
from cardloom.llm.words import IS_SPACE, coded, flat

#: A worker forgets its pieces when it holds so many distinct ones, or so many bytes of them.
CACHE_PIECES, CACHE_BYTES = 600_000, 32 << 20

#: So many new pieces go to the library as one text.
RUN = 256

# Bytes after which a cut is safe: printable ASCII.
_SAFE = np.zeros(256, bool)
_SAFE[33:127] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_SPACES, _PRINTABLE = frozenset(np.flatnonzero(IS_SPACE).tolist()), frozenset(range(33, 127))


class Encoder:
    """Ids of many texts; ``path`` is a ``tokenizers`` file with a byte-level pattern."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token of the byte-level alphabet has a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held_bytes = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _look_up(self, pieces: list[bytes]) -> np.ndarray:
        known = self.known
        if known and (len(known) + len(pieces) > CACHE_PIECES or self.held_bytes + sum(map(len, pieces)) > CACHE_BYTES):
            self._forget()
            known = self.known
        row = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            # Pieces that begin and end at safe cuts can stand in a row as one text: fewer, longer calls.
            joined = [p for p in new if p[0] in _SPACES and p[-1] in _PRINTABLE]
            alone = [p for p in new if not (p[0] in _SPACES and p[-1] in _PRINTABLE)]
            sought, new = new, joined + alone
            texts = [b"".join(joined[i : i + RUN]).decode() for i in range(0, len(joined), RUN)] + [p.decode() for p in alone]
            got = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate(got)
            # a token ends where the bytes so far end; a piece's last token ends where the piece does
            token_ends = np.cumsum(self.bytes_of[ids])
            piece_ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            last = np.searchsorted(token_ends, piece_ends)
            if len(token_ends) <= last[-1] or not np.array_equal(token_ends[last], piece_ends):
                raise ValueError("a token crosses a cut: the vocabulary is not byte-level BPE with the usual pattern")
            used = int(self.ends[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.zeros(used + 2 * len(ids), np.int32)))
            self.ids[used : used + len(ids)] = ids
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.held_bytes += sum(map(len, new))
            self.ends = np.concatenate((self.ends, used + last + 1))
            row[missing] = np.fromiter(map(known.__getitem__, sought), np.int64, len(sought))
        return row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (null: empty)."""
        data, offsets = flat(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        before = data[:-1]
        safe = _SAFE[before]
        # ... and the end of a two-byte character from U+00C0 on, none of which is white space
        safe[1:] |= ((before[1:] & 0xC0) == 0x80) & (before[:-1] >= 0xC3) & (before[:-1] < 0xE0)
        cut[1:] = (IS_SPACE[data[1:]] & safe) | (_MARK[data[1:]] & _LETTER[before])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        code, distinct = coded(data, starts)
        row = self._look_up(distinct.to_pylist())
        lengths = np.diff(self.ends)[row]
        first = self.ends[:-1][row]
        length = lengths[code]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(first[code] - (ends - length), length) + np.arange(ends[-1])]
        at = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        return ids, at


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it keeps what it has learnt."""
    return held("byte_bpe", path, Encoder)
