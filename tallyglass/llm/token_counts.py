"""Token counts without identifiers: byte-pair merging with a heap over a linked list.

A count is the number of initial symbols less the number of merges made. Results for odd input: null and empty texts
have 0 tokens; special strings inside a text count as one token each; repeated rows give repeated results; other
columns are not read.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PATTERN, Memo, Vocabulary, pieces, vocabulary
from .common import arrow_map, keeps


def merged_length(word: bytes, v: Vocabulary) -> int:
    """Symbols left of word once no adjacent pair has a merge; at each step the lowest rank goes first, the leftmost of equals."""
    merges, ids = v.merges, [v.byte_ids[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapify(heap)
    left = n
    while heap:
        _, i, new, a, b = heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if m := merges.get((new, ids[k])):
                heappush(heap, (m[0], i, m[1], new, ids[k]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
            heappush(heap, (m[0], h, m[1], ids[h], new))
    return left


_memos: dict[str, Memo] = {}
keeps(__name__, _memos.clear)


def _memo(path: str) -> Memo:
    """One per worker process."""
    return _memos.setdefault(path, Memo())


def count_text(text: str, v: Vocabulary, memo: Memo) -> int:
    total = 0
    for k, part in enumerate(v.parts(text)):
        if k % 2:
            total += 1
            continue
        for some in batched(pieces(part), 100_000):
            new = [p for p in set(some) if p not in memo]
            memo.room(new)
            for p in new if len(memo) else set(some):
                memo[p] = sum(merged_length(w.encode(), v) for w in PATTERN.findall(p))
            total += sum(map(memo.__getitem__, some))
    return total


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row. vocabulary_path must be readable on every executor."""

    def count(batches):
        v, memo = vocabulary(vocabulary_path), _memo(vocabulary_path)
        for b in batches:
            texts = b.column(1)
            n_bytes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            n = [count_text(t.as_py(), v, memo) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
