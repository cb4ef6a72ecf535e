"""Byte-pair vocabularies and the cutting of texts into cacheable pieces, for the token operators.

A byte-level vocabulary file (tokenizers JSON) names each byte by a printable character; the merges are listed by rank.
"""

from __future__ import annotations

import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex

#: The pattern by which byte-level vocabularies of this family cut texts before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces end where a non-space is followed by a space, or letters and digits by a dot or comma, so no token spans two
#: pieces. Separators U+001C-U+001F count as
#: space for re but not for the pattern above: texts with them are cut by the pattern alone.
PIECE = re.compile(r"\s*[^\W_]+(?=[.,\s]|$)|\s*\S+|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_names() -> dict[int, str]:
    """byte -> its character in the vocabulary file: printable ones stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in own}
    for b in range(256):
        if b not in names:
            names[b] = chr(0x100 + len(names) - len(own))
    return names


class Vocabulary:
    """ids by bytes, bytes by id, merge ranks by pair of ids, special strings by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_name = {c: b for b, c in byte_names().items()}
        raw = lambda name: bytes(of_name[c] for c in name)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(name): i for name, i in vocab.items() if all(c in of_name for c in name)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        # of each token the rank of the merge that makes it, and its parts; bytes come before all merges
        self.made_at = {i: (rank, pair) for pair, (rank, i) in self.merges.items()}
        #: Is each merge listed after those that make its parts? Then a merge's rank says when it happens.
        self.in_turn = all(rank > max(self.made_at[x][0] if x in self.made_at else -1 for x in pair) for pair, (rank, _) in self.merges.items())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        either = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._cut = re.compile(f"({either})") if self.special else None
        #: The special strings in UTF-8.
        self.whole = re.compile(either.encode()) if self.special else None

    def parts(self, text: str) -> list[str]:
        """text cut at special strings; these stand at the odd places."""
        return self._cut.split(text) if self._cut and any(s in text for s in self.special) else [text]


def pieces(text: str):
    """Pieces of a text that can be tokenised one by one; a very long text gives them one at a time."""
    cut = PATTERN if ODD_SPACE.search(text) else PIECE
    return cut.findall(text) if len(text) < 4_000_000 else (m[0] for m in cut.finditer(text))


SPACE, LETTER, STOP, HIGH = 1, 2, 3, 4
#: What a byte of UTF-8 is: ASCII space, ASCII letter or digit, dot or comma, part of another character; 0 for the rest.
CLASS = bytes(SPACE if b in b"\t\n\v\f\r " else STOP if b in b".," else HIGH if b >= 0x80 else LETTER if chr(b).isalnum() else 0 for b in range(256))
#: The last three bytes of each space beyond ASCII; the first is 0 where two make it.
HIGH_SPACE = np.array(sorted(int.from_bytes(c.encode()) for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))))
#: Bytes looked at together, about.
SLAB = 1 << 20


def _starts(data: np.ndarray, space_apart: bool) -> np.ndarray:
    """Where in data (UTF-8) pieces begin: at a space after what is none, and at a dot or comma after a letter or digit (of ASCII or Latin-1).
    space_apart: also at what is no space after a space."""
    kind = np.frombuffer(data.tobytes().translate(CLASS), np.uint8)
    before, now = kind[:-1], kind[1:]
    space = now == SPACE
    turn = space != (before == SPACE)
    if not space_apart:
        turn &= space
    at = np.flatnonzero(turn | (now == STOP) & ((before == LETTER) | (before == HIGH))) + 1
    check = np.flatnonzero(kind[at - 1] == HIGH)
    where = at[check]
    one, two, three = (np.where(where >= k, data[where - k].astype(np.int64), 0) for k in (1, 2, 3))
    pair = two << 8 | one
    space_before = np.isin(np.where(two == 0xC2, pair, three << 16 | pair), HIGH_SPACE)
    letter_before = (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    return np.delete(at, check[np.where(kind[where] == SPACE, space_before, ~letter_before)])


def cut(texts: pa.Array, space_apart: bool = False, whole: re.Pattern | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts (null: none) one after another, each distinct one held once, and for each text the number of pieces before it, with
    the number of all at the end. Cuts are made where no token goes across: see _starts. whole: bytes that are a piece of their own wherever found."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    ends = ends - first
    buffer = (texts.buffers()[2] or pa.py_buffer(b"")).slice(first, last - first) if last > first else pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)
    begins = np.zeros(len(data) + 1, bool)
    for a in range(0, len(data), SLAB):
        back = min(a, 3)  # a character that begins before the slab
        found = _starts(data[a - back : a + SLAB], space_apart) + (a - back)
        begins[found[np.searchsorted(found, a) :]] = True
    if whole is not None:
        for a, b in pairwise(ends.tolist()):
            for m in whole.finditer(buffer, a, b):
                begins[m.start() + 1 : m.end()] = False
                begins[[m.start(), m.end()]] = True
    begins[ends] = True
    at = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), buffer])
    return pieces.dictionary_encode(), np.searchsorted(at, ends)


def joined(values: pa.Array, which: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """values (large strings or bytes) one after another, as which names them, as one run of bytes; and where in it each text begins, given
    how many of them come before the text."""
    taken = values.take(which)
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends] if len(taken) else np.zeros(len(ends), np.int64)
    return at, memoryview(taken.buffers()[2] or b"")[: at[-1]]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Memo(dict):
    """A dict that starts anew after so many characters of keys: bounded memory, the same answers."""

    def __init__(self, max_chars: int = 6_000_000, max_keys: int = 400_000):
        super().__init__()
        self.max_chars, self.max_keys, self.chars = max_chars, max_keys, 0

    def room(self, keys: list[str]) -> None:
        """Called before keys are added."""
        self.chars += sum(map(len, keys))
        if self.chars > self.max_chars or len(self) + len(keys) > self.max_keys:
            self.clear()
            self.chars = sum(map(len, keys))
