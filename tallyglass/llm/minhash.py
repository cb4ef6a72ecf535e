"""MinHash near-duplicate groups: many universal hash minima, banding, verification and connected components.

1. Each text becomes the set of hashes of its runs of `shingle` words, and its signature is `bands * rows` minima over it,
   one for each of as many universal hash functions; each band of minima is one key. With 5 rows and 30 bands a pair of
   similarity 0.8 shares no key in 7 of a million cases, a closer pair in fewer.
2. Texts with equal sets are one class, stood for by its smallest id; copies go no further.
3. A bucket is the classes with one key. First each bucket is compared with its pivot alone, the member with the most
   neighbours in its buckets: what was copied from one text hangs together after that.
4. Members of buckets that are still in several parts (the crowd) are paired by the exact prefix filter: their shingles are
   put in one order, rare ones first, and two sets can only be similar enough if they share one of their first few, at
   places that leave room for the rest of what they must share. Texts that only have a common passage, and copies that
   are each far from the others, differ in their rare shingles and so meet nowhere. Pairs inside one part need no
   comparison and are never made: of each group of places one side is always outside of the group's largest part. No pair
   of a bucket is lost.
5. Candidates are verified on their signatures (fewer equal minima than a pair at the limit has but in `risk` of cases: out)
   and then on their full sets; components of the verified links are found by alternating large-star and small-star.

Results for odd input: texts without words, null texts and rows without an id are linked with nothing; a text of fewer
words than a shingle has its whole sequence as its only one; rows that repeat an id are one document with the links of
all of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, small
from .components import components

SEED = 20_250
#: Set members hashed by all functions at once, at most: bounds the memory of one text.
CHUNK = 512
#: The crowd's most frequent shingles, so many at most, stand last and by frequency; all others by their hash. Any order is
#: exact, this one makes small groups.
RANKED = 1 << 16
#: Sizes of sets are put in classes, each so many times the one before.
CLASS = 1.1


class Words(dict):
    """word -> 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, words: Words) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words; of the whole sequence if it is shorter; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII space
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of `count` hash functions x -> (a x + b) mod 2^64, of which the high half counts."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def minima(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(members), CHUNK):
            x = np.multiply.outer(a, members[i : i + CHUNK])
            x += b[:, None]
            np.minimum(least, x.min(axis=1), out=least)
    return least >> np.uint64(32)


def signatures(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """(doc, n, k1, k2, sig): size of the set, two hashes that name it, and its minima."""

    def run(batches):
        a, b = functions(count)
        words = Words()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle, words)
                n.append(len(s))
                name = xxhash.xxh3_128_intdigest(s.tobytes())
                k1.append((name >> 64) - (1 << 63))
                k2.append((name & (1 << 64) - 1) - (1 << 63))
                sig.append(minima(s, a, b).astype(np.uint32).view(np.int32) if len(s) else np.zeros(0, np.int32))
            ends = np.cumsum([0, *map(len, sig)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sig) if sig else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], names=["doc", "n", "k1", "k2", "sig"])

    return arrow_map(docs, run, "doc long, n long, k1 long, k2 long, sig array<int>")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc, members) of the rows."""

    def run(batches):
        words = Words()
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle, words) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc", "members"])

    return arrow_map(docs, run, "doc long, members array<long>")


def least_equal(count: int, percent: int, risk: float) -> int:
    """The most equal minima of `count` that can be asked for if a pair of similarity percent / 100 may have fewer in `risk` of cases."""
    p, below, k = percent / 100, 0.0, 0
    while k < count and below + (term := math.comb(count, k) * p**k * (1 - p) ** (count - k)) <= risk:
        below, k = below + term, k + 1
    return k


def verified(pairs: DataFrame, signed: DataFrame, members: DataFrame, percent: int, least: int, max_broadcast_bytes: int) -> DataFrame:
    """The pairs (doc, pivot) that have `least` equal minima and whose full sets are similar enough. Pivots are few as a rule: up to
    max_broadcast_bytes their sets are broadcast, so that no set is shuffled along with each of its pairs."""
    wanted = small(keep(pairs.select("pivot").distinct()), max_broadcast_bytes)
    theirs = lambda df, c: small(keep(df.join(wanted, F.col("doc") == F.col("pivot"), "left_semi").select(F.col("doc").alias("pivot"), F.col(c).alias("theirs"))), max_broadcast_bytes)
    equal = F.aggregate(F.zip_with("sig", "theirs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    close = keep(pairs.join(signed.select("doc", "sig"), "doc").join(theirs(signed, "sig"), "pivot").filter(equal >= least).select("doc", "pivot").distinct())
    both = F.size(F.array_intersect("members", "theirs")).cast("long")
    return close.join(members, "doc").join(theirs(members, "members"), "pivot").filter(100 * both >= percent * (F.size("members") + F.size("theirs") - both)).select("doc", "pivot").distinct()


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(CLASS)).astype(np.int64)


def places(crowd: DataFrame, percent: int) -> DataFrame:
    """(shingle, class, probe, doc, part, n, place) of the first shingles of each set of the crowd (doc, part, members) in the common
    order. Of two sets the larger one probes, for each class of sizes that its partners at this place may have; the other one
    is found in the class of its own size."""
    often = crowd.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.desc("c"), "m").limit(RANKED).collect()
    names = np.array([r["m"] for r in often], np.int64)
    by_name = np.argsort(names)
    shared = crowd.sparkSession.sparkContext.broadcast((names[by_name], (len(names) - by_name).astype(np.int64)))

    def ordered(x: np.ndarray) -> np.ndarray:
        name, rank = shared.value
        if not len(name):
            return np.sort(x)
        at = np.minimum(np.searchsorted(name, x), len(name) - 1)
        return x[np.lexsort((x, np.where(name[at] == x, rank[at], 0)))]

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, part, members in zip(b.column(0), b.column(1), b.column(2), strict=True):
                x = ordered(members.values.to_numpy(zero_copy_only=False))
                n, i = len(x), np.arange(len(x))
                most = (n - i) * (100 + percent) // percent - n  # size of a partner that shares all from place i on
                low = -(-percent * n // 100)
                found = i[most >= n]
                probes = i[most >= low]
                first, last = size_class(np.array([low]))[0], size_class(np.minimum(most[probes], n))
                times = last - first + 1
                at = np.concatenate([found, np.repeat(probes, times)])
                start = np.repeat(np.cumsum(times) - times, times)
                classes = np.concatenate([np.full(len(found), size_class(np.array([n]))[0]), first + np.arange(times.sum()) - start])
                for column, values in zip(out, (x[at], classes, np.arange(len(at)) >= len(found), np.full(len(at), doc.as_py()), np.full(len(at), part.as_py()), np.full(len(at), n), at), strict=True):
                    column.append(values)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)], names=["shingle", "class", "probe", "doc", "part", "n", "place"])

    return arrow_map(crowd.select("doc", "part", "members"), run, "shingle long, class long, probe boolean, doc long, part long, n long, place long")


def prefix_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """(doc, pivot): all pairs of different parts of the crowd that the prefix filter leaves."""
    at = keep(places(crowd, percent))
    by_part = at.groupBy("shingle", "class", "part").agg(F.count("*").alias("c"))
    groups = by_part.groupBy("shingle", "class").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.max_by("part", F.struct("c", "part")).alias("main")).filter("a < b").select("shingle", "class", "main")
    met = keep(at.join(groups, ["shingle", "class"]).withColumn("other", F.col("part") != F.col("main")))
    found = met.filter("not probe")
    probes = met.filter("probe").select("shingle", "class", *(F.col(c).alias(f"p_{c}") for c in ("doc", "part", "n", "place", "other")))
    room = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place"))  # what both can share from here on
    may = (F.col("part") != F.col("p_part")) & ((F.col("n") < F.col("p_n")) | (F.col("n") == F.col("p_n")) & (F.col("doc") < F.col("p_doc"))) & (room * (100 + percent) >= percent * (F.col("n") + F.col("p_n")))
    ways = [found.filter("other").join(probes, ["shingle", "class"]).filter(may), found.filter("not other").join(probes.filter("p_other"), ["shingle", "class"]).filter(may)]
    return ways[0].unionByName(ways[1]).select("doc", F.col("p_doc").alias("pivot")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, risk: float = 1e-9, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row. component_id: the smallest id reachable over links of percent / 100
    similarity or more; kept: whether this is it. risk: see the module."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = keep(signatures(texts, shingle, bands * rows))
    classes = keep(signed.filter("n > 0 and doc is not null").groupBy("k1", "k2").agg(F.min("doc").alias("rep")))

    # a class's keys come from the row that stands for it; what is grouped by key is stored before it is joined, so that it can be
    # broadcast, or a join on a crowded key can be split
    stored = lambda df: small(keep(df), max_broadcast_bytes)
    stands = keep(signed.join(classes.select("k1", "k2", F.col("rep").alias("doc")), ["k1", "k2", "doc"], "left_semi").select("doc", "n", "sig").distinct())
    keys = F.array(*(F.xxhash64(F.lit(k), F.slice("sig", k * rows + 1, rows)) for k in range(bands)))
    keyed = stands.select("doc", "n", F.explode(keys).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("key"))
    members = keep(keyed.join(shared, "key").select("key", "doc", "n"))
    candidates = stored(members.select("doc").distinct())
    signs = keep(stands.join(candidates, "doc", "left_semi"))
    full = keep(sets(texts.join(candidates, "doc", "left_semi"), shingle).distinct())

    # rows that repeat an id with other texts: their classes are one document's
    of_id = signed.filter("n > 0").join(classes, ["k1", "k2"]).select("doc", "rep").distinct()
    first = of_id.groupBy("doc").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last")
    links = of_id.join(first, "doc").select(F.col("rep").alias("u"), F.col("first").alias("v"))

    # members with many neighbours in their buckets are likely to be what the others were copied from
    crowds = stored(members.groupBy("key").agg(F.count("*").alias("crowd")))
    score = members.join(crowds, "key").groupBy("doc").agg(F.sum("crowd").alias("score"))
    members = keep(members.join(score, "doc"))
    best = F.max(F.struct("score", (-F.col("doc")).alias("minus"), "n"))
    pivots = stored(members.groupBy("key").agg(best.alias("p")).select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("p_n")))
    may = (F.col("doc") != F.col("pivot")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))
    pairs = keep(members.join(pivots, "key").filter(may).groupBy(F.greatest("doc", "pivot").alias("u"), F.least("doc", "pivot").alias("v")).agg(F.min("pivot").alias("pivot")))
    least = least_equal(bands * rows, percent, risk)
    linked = verified(pairs.select((F.col("u") + F.col("v") - F.col("pivot")).alias("doc"), "pivot"), signs, full, percent, least, max_broadcast_bytes)
    links = keep(links.unionByName(linked.select(F.col("doc").alias("u"), F.col("pivot").alias("v"))))
    labels = keep(components(links))

    # a pivot has been held against all others of its bucket; what is left of it in several parts goes on
    part = F.coalesce("component", "doc").alias("part")
    rest = members.join(pivots, "key").filter("doc <> pivot").select("key", "doc").join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", part)
    still = stored(rest.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("key"))
    crowd = stored(rest.join(still, "key").select("doc", "part").distinct())
    met = keep(prefix_pairs(keep(full.join(crowd, "doc")), percent).join(pairs.select("u", "v"), (F.greatest("doc", "pivot") == F.col("u")) & (F.least("doc", "pivot") == F.col("v")), "left_anti"))
    linked = verified(met, signs, full, percent, least, max_broadcast_bytes)
    parts = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked.select(F.col("doc").alias("u"), F.col("pivot").alias("v")))).withColumnRenamed("node", "rep")
    of_class = classes.join(parts, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    found = signed.join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return found.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
