"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie in one flat array of symbols.  In each round every
word finds its least pair rank (a segmented minimum), the leftmost pairs of that
rank are merged in all words at once, and the array is compacted; this
ends when no word has a pair left.

Words are what no piece of the vocabulary reaches across: a text is cut between two
characters that stand side by side in no piece.  That holds between a word's last letter
and the next word's leading white-space mark, so words repeat, and each distinct
one is merged once.  Equal to the library's own result, which merges the best-ranked
pair of the whole text, leftmost first, one at a time:

* Pairs across a cut never merge, so words do not affect each other.
* Merging several pairs of one rank in a round is safe when no pair that a merge makes
  ranks before it.  Ranks for which the vocabulary has such a pair are merged
  one at a time in a word.

A round costs time in proportion to what is left of a word, and a long word (an unbroken run of letters,
spaces, base64) has thousands of ranks, so rounds would take quadratic time there.  Words of more than
``ROUND_SYMBOLS`` symbols are merged one pair at a time instead, best rank first, leftmost first, from
a heap over a linked list: n log n, with about 100 bytes a symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.workers import held, in_batches
from cardloom.llm.words import IS_FIRST, coded, flat, slices

#: A worker forgets its words when it holds so many distinct ones, or so many bytes of them.
CACHE_WORDS, CACHE_BYTES = 600_000, 32 << 20
#: Longer words are merged from a heap.
ROUND_SYMBOLS = 256
#: The library's mark for a space.
SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
_NONE = np.int64(1) << 40


class Merger:
    """A SentencePiece BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(model.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(size) if not special[i]]
        self.id_of = {self.pieces[i]: i for i in normal}
        # ranks: best score first, equal scores share a rank
        scores = np.array([model.get_score(i) for i in range(size)])
        order = np.unique(-scores[normal], return_inverse=True)[1]
        rank = np.zeros(size, np.int64)
        rank[normal] = order
        self._pairs(rank)
        self._cuts(normal)
        self._decoding(special)
        self._forget()

    def _pairs(self, rank: np.ndarray) -> None:
        """Sorted table of (left id, right id) -> merged id and rank, and which ranks merge one at a time."""
        keys, merged = [], []
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.ranks = rank[self.merged]
        # a merge into x can be followed at once by a pair with x that ranks before or beside it
        single = np.zeros(int(rank.max()) + 1, bool)
        for part in (self.keys >> 20, self.keys & 0xFFFFF):
            made = np.isin(part, self.merged)
            early = made & (self.ranks <= rank[part])
            single[rank[part[early]]] = True
        self.single = single
        self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        # a two-level table: where each left id's pairs are
        self.first = np.searchsorted(self.keys, np.arange(len(self.pieces) + 2, dtype=np.int64) << 20)

    def _cuts(self, normal: list[int]) -> None:
        """Which pairs of characters stand side by side in a piece."""
        points = sorted({ord(c) for i in normal for c in self.pieces[i]})
        n = len(points)
        self.char_ids = np.array([self.id_of.get(chr(c), -1) for c in points] + [-1], np.int64)
        self.number = np.full(0x110000, n, np.int32)  # of a character among those of the vocabulary; n: none of them
        self.number[points] = np.arange(n)
        self.side = np.zeros((n + 1, n + 1), bool)
        for i in normal:
            k = self.number[[ord(c) for c in self.pieces[i]]]
            self.side[k[:-1], k[1:]] = True

    def _decoding(self, special: list[bool]) -> None:
        """The bytes of each piece in decoded text; byte pieces are kept as raw bytes."""
        raw = []
        for i, piece in enumerate(self.pieces):
            raw.append(b"" if special[i] else piece.replace(SPACE, " ").encode())
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_ends = np.cumsum([len(x) for x in raw])
        self.raw_sizes = np.array([len(x) for x in raw], np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[self.byte_ids] = True
        self.is_high = np.zeros(len(self.pieces), bool)  # a byte that is no character by itself
        self.is_high[self.byte_ids[128:]] = True

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held_bytes = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    # -- encoding ---------------------------------------------------------

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the pair table for each pair of ids, -1 if they don't merge."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, at, -1)

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge until no pair remains.

        ``symbol``: ids (-1 - k: the k-th unknown character), ``word``: the ascending number of the
        word each stands in.  Returns ids, words and the index of each one's first symbol.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        origin = np.arange(len(symbol))
        row = np.full(len(symbol), -1, np.int64)  # the pair of each symbol with the next
        if len(symbol) > 1:
            row[:-1] = np.where(word[:-1] == word[1:], self._found(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(row >= 0, self.ranks[row], _NONE)
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, head)
            live = least < _NONE
            sizes = np.diff(head, append=len(symbol))
            if not live.all():  # words without a pair are done and leave the array
                stay = np.repeat(live, sizes)
                done.append((symbol[~stay], word[~stay], origin[~stay]))
                symbol, word, origin, row, rank = symbol[stay], word[stay], origin[stay], row[stay], rank[stay]
                if not len(symbol):
                    break
                least, sizes = least[live], sizes[live]
                head = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # the leftmost of each word, and with a safe rank every second one of those that overlap
            same = word[at[1:]] == word[at[:-1]]
            new_run = np.concatenate(([True], ~(same & (at[1:] == at[:-1] + 1))))
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run) % 2 == 0
            leftmost = np.concatenate(([True], ~same))
            take &= leftmost | ~self.single[rank[at]]
            at = at[take]
            symbol[at] = self.merged[row[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, origin, row = symbol[keep], word[keep], origin[keep], row[keep]
            touched = place[at]
            again = np.unique(np.concatenate((touched, touched[touched > 0] - 1)))
            inside = again[again + 1 < len(symbol)]
            row[again] = -1
            row[inside] = np.where(word[inside] == word[inside + 1], self._found(symbol[inside], symbol[inside + 1]), -1)
        symbol, word, origin = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*done, strict=True) if done else ((), (), ())))
        order = np.argsort(origin, kind="stable")
        return symbol[order], word[order], origin[order]

    def merge_long(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge one word from a heap of (rank, place); returns ids and the index of each one's first symbol.

        Gives what :meth:`merge` gives.  ``rank`` holds the rank of each place's pair as it is now, so
        an entry of the heap whose pair has changed since is known by its rank and passed over.
        """
        n = len(symbol)
        row = self._found(symbol[:-1], symbol[1:])
        rank = array("q", np.append(np.where(row >= 0, self.ranks[row], -1), -1).tobytes())
        place = np.flatnonzero(row >= 0)
        heap = np.sort(self.ranks[row[place]] << 40 | place).tolist()  # a sorted list is a heap
        ids = array("q", symbol.astype(np.int64).tobytes())
        after, before = array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
        pairs, low = self.pairs, (1 << 40) - 1
        while heap:
            entry = heapq.heappop(heap)
            at = entry & low
            if rank[at] != entry >> 40:
                continue
            gone = after[at]
            ids[at] = made = pairs[ids[at] << 20 | ids[gone]][1]
            rank[gone] = -1
            after[at] = then = after[gone]
            rank[at] = -1
            if then < n:
                before[then] = at
                found = pairs.get(made << 20 | ids[then]) if ids[then] >= 0 else None
                if found:
                    rank[at] = found[0]
                    heapq.heappush(heap, found[0] << 40 | at)
            left = before[at]
            if left >= 0:
                found = pairs.get(ids[left] << 20 | made) if ids[left] >= 0 else None
                rank[left] = -1
                if found:
                    rank[left] = found[0]
                    heapq.heappush(heap, found[0] << 40 | left)
        after = np.frombuffer(after, np.int64)
        alive = np.zeros(n + 1, bool)
        alive[0] = True
        at, links = 0, after.tolist()
        while at < n:
            alive[at] = True
            at = links[at]
        origin = np.flatnonzero(alive[:n])
        return np.frombuffer(ids, np.int64)[origin], origin

    def _merge_all(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`merge` with long words taken out and merged by themselves."""
        sizes = np.bincount(word) if len(word) else np.zeros(0, np.int64)
        long = np.flatnonzero(sizes > ROUND_SYMBOLS)
        if not len(long):
            return self.merge(symbol, word)
        first = np.cumsum(sizes) - sizes
        rest = np.flatnonzero(~np.isin(word, long))
        ids, words, origin = self.merge(symbol[rest], word[rest])
        done = [(ids, words, rest[origin])]
        for w in long.tolist():
            ids, origin = self.merge_long(symbol[first[w] : first[w] + sizes[w]])
            done.append((ids, np.full(len(ids), w), origin + first[w]))
        ids, words, origin = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(origin, kind="stable")
        return ids[order], words[order], origin[order]

    def _merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        first = np.flatnonzero(IS_FIRST[data])
        point = _points(data, first)
        word = np.searchsorted(ends, first, "right")
        symbol = self.char_ids[self.number[point]]
        symbol, word, origin = self._merge_all(symbol, word)
        # an unknown character gives the pieces of its bytes
        sizes = np.diff(np.append(first, len(data)))
        lengths = np.where(symbol < 0, sizes[origin], 1)
        ids = np.repeat(symbol, lengths)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            start = np.cumsum(lengths) - lengths
            within = np.arange(len(ids)) - np.repeat(start, lengths)
            ids[unknown] = self.byte_ids[data[np.repeat(first[origin], lengths)[unknown] + within[unknown]]]
        return ids, np.bincount(word, weights=lengths, minlength=len(words)).astype(np.int64)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        if self.known and (len(self.known) + len(words) > CACHE_WORDS or self.held_bytes + sum(map(len, words)) > CACHE_BYTES):
            self._forget()
        known = self.known
        row = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            ids, counts = self._merge_words(new)
            used = int(self.ends[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.zeros(used + 2 * len(ids), np.int32)))
            self.ids[used : used + len(ids)] = ids
            row[missing] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.held_bytes += sum(map(len, new))
            self.ends = np.concatenate((self.ends, used + np.cumsum(counts)))
        return row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end ids of all texts in a row, and where each text's begin."""
        data, offsets = _marked(*flat(texts))
        first = np.flatnonzero(IS_FIRST[data])
        point = _points(data, first)
        number = self.number[point]
        cut = np.ones(len(first), bool)
        cut[1:] = ~self.side[number[:-1], number[1:]]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[np.searchsorted(first, heads)] = True
        starts = first[cut]
        code, distinct = coded(data, starts)
        row = self._look_up(distinct.to_pylist())
        length = np.diff(self.ends)[row][code]
        ends = np.cumsum(length)
        source = np.repeat(self.ends[:-1][row][code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        at = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)].astype(np.int64)
        # a begin id before and an end id after each text
        out = np.empty(len(source) + 2 * len(texts), np.int32)
        texts_of = np.repeat(np.arange(len(texts)), np.diff(at))
        out[np.arange(len(source)) + 2 * texts_of + 1] = self.ids[source]
        at = at + 2 * np.arange(len(at))
        out[at[:-1]] = self.begin
        out[at[1:] - 1] = self.end
        return out, at

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids, in UTF-8, as the library's decode() gives it.

        The first piece loses the white space that encoding puts before a text; bytes that
        form no character become U+FFFD one by one.
        """
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.raw_ends[ids] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.raw[source]
        limits = np.concatenate(([0], ends))[at]
        raw_byte = np.concatenate(([0], np.cumsum(self.is_high[ids])))
        with_bytes = raw_byte[at[1:]] > raw_byte[at[:-1]]
        out = []
        for i, (a, b) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)):
            text = data[a:b].tobytes()
            if with_bytes[i] and not _valid(text):
                text = self._decode_bytes(ids[at[i] : at[i + 1]])
            out.append(text[1:] if text[:1] == b" " and self._first_is_space(ids[at[i] : at[i + 1]]) else text)
        return out

    def _first_is_space(self, ids: np.ndarray) -> bool:
        """Does the first piece that is not a control one begin with the mark for a space?"""
        for i in ids[:2].tolist():
            if self.raw_sizes[i] or self.is_byte[i]:
                return not self.is_byte[i] and self.pieces[i].startswith(SPACE)
        return False

    def _decode_bytes(self, ids: np.ndarray) -> bytes:
        """As above for ids with byte pieces: each run of them is decoded by itself."""
        out, run = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.raw[self.raw_ends[i] - 1 : self.raw_ends[i]].tobytes()
                continue
            if run and self.raw_sizes[i]:
                out.append(_repaired(bytes(run)))
                run.clear()
            out.append(self.raw[self.raw_ends[i] - self.raw_sizes[i] : self.raw_ends[i]].tobytes())
        out.append(_repaired(bytes(run)))
        return b"".join(out)


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _repaired(run: bytes) -> bytes:
    """UTF-8 with each byte that is part of no character replaced by U+FFFD."""
    if _valid(run):
        return run
    out, i = [], 0
    while i < len(run):
        for n in (4, 3, 2, 1):
            part = run[i : i + n]
            try:
                ok = len(part) == n and len(part.decode()) == 1
            except UnicodeDecodeError:
                ok = False
            if ok:
                out.append(part)
                i += n
                break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def _points(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 bytes begin at ``first``."""
    point = data[first].astype(np.int64)
    long = np.flatnonzero(point >= 0xC0)
    lead, at = point[long], first[long]
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    b1, b2, b3 = ((padded[at + k] & 0x3F).astype(np.int64) for k in (1, 2, 3))
    point[long] = np.select(
        [lead < 0xE0, lead < 0xF0],
        [(lead & 0x1F) << 6 | b1, (lead & 0x0F) << 12 | b1 << 6 | b2],
        (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3,
    )
    return point


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each non-empty one, spaces replaced by their mark."""
    full = offsets[1:] > offsets[:-1]
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(full)))
    space = data == 32
    grow = np.where(space, 3, 1)
    ends = np.cumsum(grow)
    out = np.repeat(data, grow)
    at = ends[space]
    for k in range(3):
        out[at - 3 + k] = _SPACE[k]
    return out, np.concatenate(([0], ends))[offsets]


def merger(path: str) -> Merger:
    """This worker's merger for a model file; it keeps what it has learnt."""
    return held("piece_bpe", path, Merger)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text with begin and end ids and decode the ids again.

    Returns key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded text in UTF-8), and with ``with_ids`` also
    ids and decoded.

    Edge cases: a null or empty text gives the begin and the end id alone and decodes to the
    empty text; null and repeated keys are kept as they are; an empty table gives an
    empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch in (part for b in batches for part in slices(b, "_text")):
            ids, at = m.encode(batch.column("_text"))
            decoded = m.decode(ids, at)
            words = ids.astype("<u4")
            columns = {
                key: batch.column(key),
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array([hashlib.sha256(words[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                columns["decoded"] = pa.array([x.decode() for x in decoded], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return in_batches(docs.select(key, F.col(text).alias("_text")), run, schema, keep=True)
