"""Line deduplication: passages of min_words words or more in a row that an earlier document has are cut.

Lines: words are what stands between space, and a text's lines are found in its words, not at line breaks or sentence ends,
so that a passage has the same lines wherever it stands. Of each run of min_words words the gram (of two fifths as many
words) with the smallest hash is its print; neighbouring runs with the same print make a line, on average one for each 16
words if min_words is 50. A line has its print and a hash of its words.
1. Pairs: lines that stand in two documents or more show which ones overlap. Of the documents with a line the first one, the
   one with the smallest id, owns it, and the others are paired with it alone: so the pairs grow with the lines however many
   documents share one, and no line need be left out for being common. How often a line stands is counted, too.
   Where lines of the same print differ (edges of passages, edited copies), the first document with each shows its
   single runs of words as lines of their own, so an overlap of min_words words has a common line wherever it begins.
2. Alignment: a later document is aligned with each of its owners, those of its rarest lines first, by patience diff: of
   the lines that stand once on either side the longest sequence in the same order on both; then what was moved, or stands
   there again, in further sequences that are in order by themselves. Neighbouring lines become blocks.
3. The words of aligned blocks are deleted from the later document. Blocks hold whole lines and so have min_words words at least.

Edges: if a passage begins or ends inside a line of text or a sentence (a piece, PIECE) and has half of it or less, these words
stay as long as min_words words go without them; so of each run a word goes at least, and whole sentences are left where
that is possible.

Results for odd input: null texts stay null and empty ones empty; rows that repeat an id with the same text stay as they
are (a document is no copy of itself), and if their texts differ each is compared with earlier documents by itself; rows
without an id are left alone and own nothing; an empty table gives no rows. Runs that come together only by a cut are not compared again.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free, keep, small

#: A piece ends after a line break, or after space that follows the end of a sentence.
PIECE = re.compile(r"[^\n]*?(?:[.!?][ \t]+|\n)|[^\n]+$")
WORD = re.compile(r"\S+\s*")


def pieces(text: str) -> list[str]:
    """Pieces of a text; joined they are the text."""
    return PIECE.findall(text)


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Another odd multiplier, by which the length of what is hashed counts.
LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of texts that are hashed together, about.
CHUNK_BYTES = 500_000
#: Is a byte space, as str.split() sees it? And what else it takes for space, in UTF-8.
SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def chunks(texts: pa.Array):
    """(place of the first, texts as bytes) of stretches of a column, of CHUNK_BYTES or one text each, about."""
    at, out, size = 0, [], 0
    for t in texts:
        out.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(out[-1])
        if size >= CHUNK_BYTES:
            yield at, out
            at, out, size = at + len(out), [], 0
    if out:
        yield at, out


class Powers:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * CHUNK_BYTES), self.base, np.uint64)]), dtype=np.uint64)
        return self.known[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def places_of_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts, end to end; start and end of each word in them; words of each text). Words are those of str.split()."""
    plain = [t if t.isascii() or not WIDE_SPACE.search(t) else " ".join(t.decode("utf-8", "surrogatepass").split()).encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([*plain, b""]), np.uint8)
    space = SPACE[raw]
    before = np.concatenate([np.ones(1, bool), space[:-1]])
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    cuts = np.cumsum([0, *(len(t) + 1 for t in plain)])
    return raw, start, end, np.diff(np.searchsorted(start, cuts))


def mixed(x: np.ndarray) -> np.ndarray:
    """x (uint64) with each bit spread over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of words of several texts, laid end to end: text k has the words from starts[k] up to starts[k + 1]."""

    def __init__(self, texts: list[bytes]):
        raw, start, end, counts = places_of_words(texts)
        words = self.hashed(raw.astype(np.uint64), start, end)
        self.starts = np.cumsum([0, *counts])
        self.back = DOWN.first(len(words) + 1)
        self.sums = self.summed(words)

    @staticmethod
    def summed(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * UP.first(len(values)), dtype=np.uint64)])

    @classmethod
    def hashed(cls, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the values from each start up to its end, the same wherever they stand."""
        sums = cls.summed(values)
        return mixed((sums[end] - sums[start]) * DOWN.first(len(values) + 1)[start] + LENGTH * (end - start).astype(np.uint64))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start up to end, the same wherever they stand."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + LENGTH * (end - start).astype(np.uint64))

    def stretches(self, gram: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, print) of each stretch: neighbouring runs of min_words words in which the same gram has the smallest hash, its print."""
        n, width = int(self.starts[-1]), min_words - gram + 1
        if n < min_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - gram + 1)
        low, size = self.span(at, at + gram), 1
        while size < width:  # low, at: smallest hash of each size grams in a row and its place, the first of equals
            step = min(size, width - size)
            right = low[step:] < low[:-step]
            low, at, size = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step]), size + step
        inside = np.ones(len(at), bool)
        for s in self.starts[1:-1].tolist():
            inside[max(0, s - min_words + 1) : s] = False
        run = np.flatnonzero(inside)
        new = np.ones(len(run), bool)
        new[1:] = (at[run[1:]] != at[run[:-1]]) | (run[1:] != run[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(run))[: len(first)] - 1
        return run[first], run[last] + min_words, low[run[first]]


def _rising(pairs: list[tuple[int, int]]) -> list[int]:
    """Places in pairs (rising in i) of the longest sequence that rises in j too, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        back[n] = heads[k - 1] if k else -1
        tops[k : k + 1], heads[k : k + 1] = [j], [n]
    out, n = [], heads[-1] if heads else -1
    while n >= 0:
        out.append(n)
        n = back[n]
    return out[::-1]


def patience(lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Common lines (i, j), by their places on both sides, in sequences that rise on both: first the longest one of the lines that
    stand once on either side, then the others, each at the end of the sequence that comes closest before it."""
    lines = sorted(set(lines))
    if all(a[0] < b[0] and a[1] < b[1] for a, b in pairwise(lines)):
        return [lines] if lines else []  # as a rule: all in one order
    often_i, often_j = Counter(i for i, _ in lines), Counter(j for _, j in lines)
    once = [x for x in lines if often_i[x[0]] == 1 == often_j[x[1]]]
    first = [once[n] for n in _rising(once)]
    taken = set(first)
    ends: list[tuple[int, int]] = []  # (j of the last line, number of the sequence), sorted; all last places i lie before the next line's
    rest: list[list[tuple[int, int]]] = []
    for i, j in lines:
        if (i, j) in taken:
            continue
        k = bisect.bisect_left(ends, (j, -1)) - 1
        if k >= 0 and rest[ends[k][1]][-1][0] < i:
            n = ends.pop(k)[1]
        else:
            n = len(rest)
            rest.append([])
        rest[n].append((i, j))
        bisect.insort(ends, (j, n))
    return [first, *rest] if first else rest


def aligned(lines: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Blocks (start, end) of words of the later document, aligned with its owner. lines: (start, end, start in the owner)."""
    ends = {(i, j): e for i, e, j in sorted(lines)}
    blocks = []
    for sequence in patience(list(ends)):
        start = end = shift = None
        for i, j in sequence:
            if start is not None and i <= end and i - j == shift:
                end = max(end, ends[i, j])
                continue
            if start is not None:
                blocks.append((start, end))
            start, end, shift = i, ends[i, j], i - j
        blocks.append((start, end))
    return blocks


def common_blocks(places: list[int], owners: list[int], owner_starts: list[int], often: list[int]) -> list[tuple[int, int]]:
    """Blocks of a document that are aligned with one of its owners; owners of rare lines come first, and what they have is not
    aligned again. The lists have a value for each line: its place, its owner, its start there, how often it stands in all texts."""
    by_owner: dict[int, list[tuple[int, int, int]]] = {}
    rarest: dict[int, int] = {}
    for place, owner, start, n in zip(places, owners, owner_starts, often, strict=True):
        by_owner.setdefault(owner, []).append((place >> 32, place & 0xFFFFFFFF, start))
        rarest[owner] = min(n, rarest.get(owner, n))
    blocks: list[tuple[int, int]] = []
    for owner in sorted(by_owner, key=lambda o: (rarest[o], o)):
        covered = sorted(blocks)
        inside = lambda i, e: (k := bisect.bisect_right(covered, (i, 1 << 40)) - 1) >= 0 and e <= covered[k][1]  # noqa: B023, E731
        left = [x for x in by_owner[owner] if not inside(x[0], x[1])] if covered else by_owner[owner]
        if left:
            blocks += aligned(left)
    return blocks


def without(text: str, gone: set[int]) -> str:
    """text without the words at these places. The space at the end of a piece stays while words of it do."""
    out, k = [], 0
    for p in pieces(text):
        found = WORD.findall(p)
        left = [x for i, x in enumerate(found, k) if i not in gone]
        if not found or len(left) == len(found):
            out.append(p)
        elif left:
            last = found[-1]
            if k + len(found) - 1 in gone:
                left[-1] = left[-1].rstrip() + last[len(last.rstrip()) :]
            out += [p[: len(p) - len(p.lstrip())], *left]
        k += len(found)
    return "".join(out)


def going(text: str, blocks: list[tuple[int, int]], min_words: int) -> set[int]:
    """Places of the words of text that go, for blocks of words (start, end) that earlier documents have."""
    ends = np.cumsum([0, *(len(w) for p in pieces(text) if (w := p.split()))])
    gone = np.zeros(ends[-1], bool)
    for start, end in blocks:
        gone[start:end] = True
    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        k = int(np.searchsorted(ends, a, "right"))  # a lies in the piece that ends at ends[k], b - 1 in the one from ends[m]
        m = int(np.searchsorted(ends, b, "left")) - 1
        head = int(ends[k]) - a if ends[k - 1] < a and ends[k] < b else 0
        tail = b - int(ends[m]) if b < ends[m + 1] and a < ends[m] else 0
        head = head if head < min_words and 2 * head <= ends[k] - ends[k - 1] else 0
        tail = tail if tail < min_words and 2 * tail <= ends[m + 1] - ends[m] else 0
        if b - a - head - tail >= min_words:
            gone[a : a + head] = gone[b - tail : b] = False
    return set(np.flatnonzero(gone).tolist())


def common_lines(docs: DataFrame, min_words: int, max_broadcast_bytes: int) -> DataFrame:
    """(doc, hash, lines): for each text, named by its hash, the lines that earlier documents have: place (start << 32 | end, in
    words), owner, owner_start and often (how often the line stands in all texts); rows only where there are any. docs: doc, text."""
    gram = max(1, 2 * min_words // 5)

    def stretches(batches):
        for b in batches:
            for at, texts in chunks(b.column(1)):
                found = Runs(texts)
                begin, end, prints = found.stretches(gram, min_words)
                cuts = pa.array(np.searchsorted(begin, found.starts), pa.int32())
                first = np.repeat(found.starts[:-1], np.diff(cuts.to_numpy()))
                lists = [prints.view(np.int64), found.span(begin, end).view(np.int64), (begin - first) << 32 | (end - first)]
                of = [b.column(k).slice(at, len(texts)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*of, *(pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in lists)], names=["doc", "hash", "print", "stretch", "place"])

    def opened(batches):
        for b in batches:
            for at, texts in chunks(b.column("text")):
                found = Runs(texts)
                begin = [[np.arange(p >> 32, (p & 0xFFFFFFFF) - min_words + 1) for p in x] for x in b.column("places").slice(at, len(texts)).to_pylist()]
                begin = [np.unique(np.concatenate(x)) for x in begin]
                cuts = pa.array(np.cumsum([0, *(len(x) for x in begin)]), pa.int32())
                begin = np.concatenate(begin)
                first = begin + np.repeat(found.starts[:-1], np.diff(cuts.to_numpy()))
                lists = [found.span(first, first + min_words).view(np.int64), begin << 32 | (begin + min_words)]
                of = [b.column(k).slice(at, len(texts)) for k in ("doc", "hash")]
                yield pa.RecordBatch.from_arrays([*of, *(pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in lists)], names=["doc", "hash", "key", "place"])

    each = lambda df, *lists: df.select("doc", "hash", F.inline(F.arrays_zip(*lists)))
    texts = docs.filter("doc is not null").select("doc", "text", F.xxhash64("text").alias("hash"))
    told = each(keep(arrow_map(texts, stretches, "doc long, hash long, print array<long>, stretch array<long>, place array<long>")), "print", "stretch", "place")
    # the first document and a place in it as one number, of which hash aggregation can keep the least
    first = F.min(F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.shiftrightunsigned("place", 32)).alias("first")
    start = F.pmod("first", F.lit(1 << 32).cast("decimal(11,0)")).cast("long")
    named = lambda df: df.withColumn("owner_start", start).withColumn("owner", ((F.col("first") - F.col("owner_start")) / (1 << 32)).cast("long")).drop("first")
    # a print with one line: all documents have the same around it, and the first one owns it
    # (what is grouped is stored before it is joined: only then can a join on a print that very many lines have be split)
    common = keep(named(told.groupBy("print").agg(first, F.max("doc").alias("last"), F.count("*").alias("often"), (F.min("stretch") < F.max("stretch")).alias("open"))).filter("owner < last"))
    shared = keep(told.join(common.drop("last"), "print").drop("print"))
    owners = keep(named(shared.filter("open").groupBy("stretch").agg(first)))
    unlike = keep(shared.filter("open").drop("owner", "owner_start").join(owners, "stretch").drop("stretch"))
    # lines that differ around the same print: the first document of each shows its runs
    shown = keep(unlike.filter("owner = doc").groupBy("doc", "hash").agg(F.collect_set("place").alias("places")))
    runs = keep(arrow_map(texts.join(small(shown, max_broadcast_bytes), ["doc", "hash"]).select("doc", "hash", "text", "places"), opened, "doc long, hash long, key array<long>, place array<long>"))
    runs = each(runs, "key", "place")
    firsts = keep(named(runs.groupBy("key").agg(first, F.max("doc").alias("last"), F.count("*").alias("often"))).filter("owner < last").drop("last"))
    later = [x.filter("owner < doc").select("doc", "hash", F.struct("place", "owner", "owner_start", "often").alias("line")) for x in (shared.filter("not open"), unlike, runs.join(firsts, "key"))]
    return later[0].union(later[1]).union(later[2]).groupBy("doc", "hash").agg(F.collect_set("line").alias("lines"))


def copied_blocks(docs: DataFrame, min_words: int, max_broadcast_bytes: int) -> DataFrame:
    """(doc, hash, blocks): for each text with common lines the blocks of words (start << 32 | end) that are aligned with earlier documents."""

    def align(batches):
        for b in batches:
            lines = b.column("lines")
            columns = [x.to_pylist() for x in lines.flatten().flatten()]
            cuts = [0, *accumulate(len(x) for x in lines)]
            blocks = [[start << 32 | end for start, end in common_blocks(*(c[i:j] for c in columns))] for i, j in pairwise(cuts)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("hash"), pa.array(blocks, pa.list_(pa.int64()))], names=["doc", "hash", "blocks"])

    return arrow_map(common_lines(docs, min_words, max_broadcast_bytes), align, "doc long, hash long, blocks array<long>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs with the text of each row less its copied passages, and n_words_removed, n_words_left."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    names = [c for c in docs.columns if c not in ("n_words_removed", "n_words_left")]
    of, named, places = (free(c, docs.columns) for c in ("copy_doc", "copy_hash", "copy_blocks"))
    gone = keep(copied_blocks(rows, min_words, max_broadcast_bytes).select(F.col("doc").alias(of), F.col("hash").alias(named), F.col("blocks").alias(places)))

    def edit(batches):
        for b in batches:
            texts, blocks = b.column(text_col), b.column(places)
            before = np.concatenate([np.zeros(0, np.int64), *(places_of_words(x)[3] for _, x in chunks(texts))])
            left = before.copy()
            cut = np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False))
            shorter = [without(t.as_py(), going(t.as_py(), [(x >> 32, x & 0xFFFFFFFF) for x in g], min_words)) for t, g in zip(texts.take(pa.array(cut)), blocks.take(pa.array(cut)).to_pylist(), strict=True)]
            left[cut] = [len(t.split()) for t in shorter]
            texts = pc.replace_with_mask(texts, blocks.is_valid(), pa.array(shorter, texts.type))
            kept = [texts if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before - left), pa.array(left)], names=[*names, "n_words_removed", "n_words_left"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    joined = docs.select(names).join(small(gone, max_broadcast_bytes), (F.col(id_col) == F.col(of)) & (F.xxhash64(text_col) == F.col(named)), "left").select(*names, places)
    return arrow_map(joined, edit, f"{fields}, n_words_removed long, n_words_left long")
