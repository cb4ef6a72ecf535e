"""BPE encoding by a prefix-sharing trie, and decoding.

Distinct words enter a trie of bytes, held as sorted words and the lengths of the prefixes that neighbours share. Going
through it depth first, each node gets the last token of its prefix's encoding:
of all tokens that end there, the one that may follow the last token of the prefix before it. Two tokens may stand
side by side if merging their joined bytes gives just these two. A word's encoding is read off its node's chain of
last tokens, so words with a shared prefix share the work on it.

Results for odd input: null and empty texts have no ids and decode to the empty text; special strings in a text become
their ids; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PATTERN, Memo, Vocabulary, cut, joined, vocabulary
from .common import arrow_map, keeps

#: Pieces whose words enter a trie together, and rows encoded together, at most.
PIECES_AT_ONCE, ROWS = 400_000, 1_000


class TrieEncoder:
    #: Characters and pieces that the memo holds, at most.
    ROOM = (6_000_000, 400_000)

    def __init__(self, v: Vocabulary):
        self.v, self.longest = v, max(map(len, v.id_of))
        self._fits: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.memo = Memo(*self.ROOM)

    def _merge(self, word: bytes) -> list[int]:
        """Plain merging, for two tokens' bytes only."""
        merges, ids = self.v.merges, [self.v.byte_ids[b] for b in word]
        while len(ids) > 1:
            rank, i = min((merges[p][0], i) if (p := (ids[i], ids[i + 1])) in merges else (1 << 60, i) for i in range(len(ids) - 1))
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's edge (side 0: its first symbol, 1: its last one) while it is merged, the byte first: (symbol, rank
        of the merge that takes it in)."""
        kept = self._edges[side]
        if (found := kept.get(token)) is None:
            found, x, until = [], token, 1 << 60
            while True:
                found.append((x, until))
                if x not in self.v.made_at:
                    break
                until, pair = self.v.made_at[x]
                x = pair[side]
            found.reverse()
            kept[token] = found
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Do tokens a and b stay apart where they meet? While both are merged, symbols x and y stand at the seam; they would merge if
        their rank comes before what takes in x from the left, and not after what takes in y from the right."""
        left, right, i, j, merges = self._edge(a, 1), self._edge(b, 0), 0, 0, self.v.merges
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            if (m := merges.get((x, y))) is not None and m[0] < x_until and m[0] <= y_until:
                return False
            if x_until == y_until == 1 << 60:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _alone(self, b: int) -> bool:
        """Is the token what merging makes of its own bytes?"""
        return self._merge(self.v.bytes_of[b]) == [b]

    def fits(self, key: int) -> bool:
        """May token b follow token a? key: (a + 1) << 20 | b; a = -1: may b come first?"""
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            a, b = (key >> 20) - 1, key & 0xFFFFF
            if a < 0:
                known = self._alone(b)
            elif self.v.in_turn:
                known = self.fits(b) and self._apart(a, b)
            else:
                known = self._merge(self.v.bytes_of[a] + self.v.bytes_of[b]) == [a, b]
            self._fits[key] = known
        return known

    def last_token(self, word: bytes, depth: int, last: list[int]) -> tuple[int, int]:
        """The last token of word[:depth] and where it begins, given those of all shorter prefixes. Just one of the tokens that end there fits."""
        get, fits = self.v.id_of.get, self.fits
        for at in range(max(0, depth - self.longest), depth):
            if (t := get(word[at:depth])) is not None and fits((last[at] + 1) << 20 | t):
                return t, at
        raise ValueError("no token ends here")

    def encode_words(self, words: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The encodings of distinct words. Sorted, the words are a trie met depth first: each leaves the branch of the one
        before it where the two first differ, and the states down to there are kept."""
        out: dict[bytes, tuple[int, ...]] = {}
        before, last, begin, get, fits, known = b"", [-1], [0], self.v.id_of.get, self.fits, self._fits.get
        for w in sorted(words):
            shared, most = 0, min(len(before), len(w))
            while shared < most and before[shared] == w[shared]:
                shared += 1
            if len(last) <= len(w):
                last += [-1] * (len(w) + 1 - len(last))
                begin += [0] * (len(w) + 1 - len(begin))
            for depth in range(shared + 1, len(w) + 1):
                # the likely ones first: the last token of the prefix before it, made longer, or a new one
                at = begin[depth - 1]
                if (t := get(w[at:depth])) is None or not ((fit := known(key := (last[at] + 1) << 20 | t)) or fit is None and fits(key)):
                    at = depth - 1
                    t = get(w[at:depth])
                    if not ((fit := known(key := (last[at] + 1) << 20 | t)) or fit is None and fits(key)):
                        t, at = self.last_token(w, depth, last)
                last[depth], begin[depth] = t, at
            ids, depth = [], len(w)
            while depth:
                ids.append(last[depth])
                depth = begin[depth]
            out[w] = tuple(ids[::-1])
            before = w
        return out

    def distinct(self, texts: pa.Array) -> tuple[list, pa.Array, np.ndarray]:
        """What is made of each distinct piece of the texts; for each piece of them in order, which of these it is; and for each text the
        number of pieces before it, with the number of all at the end. Words that are new in these texts go through the trie together."""
        pieces, ends = cut(texts, whole=self.v.whole)
        some = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, some))
        new = [p for p, x in zip(some, found, strict=True) if x is None]
        if new:
            learned = {}
            for part in batched(new, PIECES_AT_ONCE):
                learned |= self.learn(part)
            found = [learned[p] if x is None else x for p, x in zip(some, found, strict=True)]
        return found, pieces.indices, ends

    def encode(self, texts: list[str]) -> list[list]:
        """For each text, what is made of its pieces, in order."""
        found, which, ends = self.distinct(pa.array(texts, pa.string()))
        which = which.to_pylist()
        return [[found[i] for i in which[a:b]] for a, b in pairwise(ends.tolist())]

    def learn(self, new: Sequence[str]) -> dict[str, object]:
        """What is made of pieces that are not in the memo; they are then."""
        plain = {p: p.encode() for p in new if p.isalpha() or p[0] == " " and p[1:].isalpha()}  # one word each
        special = self.v.special
        words = {p: [w.encode() for w in PATTERN.findall(p)] for p in new if p not in plain and p not in special}
        ids = self.encode_words({*plain.values(), *(w for ws in words.values() for w in ws)})
        made = {p: self.made(ids[w]) for p, w in plain.items() if p not in special}
        made |= {p: self.made(tuple(t for w in ws for t in ids[w])) for p, ws in words.items()}
        made |= {p: self.made((special[p],)) for p in new if p in special}
        self.memo.room(new)
        self.memo.update(made)
        return made

    def made(self, ids: tuple[int, ...]):
        """What the memo holds of a piece."""
        return ids


class Packer(TrieEncoder):
    """Holds the ids of each piece as bytes of 4 each."""

    def made(self, ids):
        return array("i", ids).tobytes()


class Digester(TrieEncoder):
    """Holds for each piece the number of its ids, their decimal text with a comma after each, and the bytes that they decode to: some 350
    bytes a piece."""

    ROOM = (18_000_000, 1_000_000)

    def made(self, ids):
        return len(ids), "%d," * len(ids) % ids, b"".join(map(self.v.bytes_of.__getitem__, ids))


def decode(ids, v: Vocabulary) -> str:
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[tuple[type, str], TrieEncoder] = {}
keeps(__name__, _encoders.clear)


def _encoder(kind: type, path: str):
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(vocabulary(path))
    return _encoders[kind, path]


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row. vocabulary_path must be readable on every executor."""

    def run(batches):
        enc = _encoder(Packer, vocabulary_path)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found, which, ends = enc.distinct(b.column(1))
            at, ids = joined(pa.array(found, pa.large_binary()), which, ends)
            flat = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at // 4, pa.int32()), flat)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        v = vocabulary(vocabulary_path)
        for b in batches:
            texts = [decode(x.as_py(), v) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text, handing back digests instead of both."""

    def run(batches):
        enc = _encoder(Digester, vocabulary_path)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found, which, ends = enc.distinct(b.column(1))
            n, decimal, decoded = zip(*found, strict=True) if found else ((), (), ())
            before = np.append(0, np.cumsum(np.array(n, np.int64)[which]))[ends]
            at, data = joined(pa.array(decimal, pa.large_string()), which, ends)
            ids_hash = [hashlib.sha256(data[i : max(i, j - 1)]).hexdigest() for i, j in pairwise(at.tolist())]
            at, data = joined(pa.array(decoded, pa.large_binary()), which, ends)
            text_hash = [hashlib.sha256(str(data[i:j], "utf-8", "replace").encode()).hexdigest() for i, j in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(before), pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
