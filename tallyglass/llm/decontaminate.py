"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each text the hashes of its runs of `gram` words are taken, and of each stretch of `window` such hashes the smallest
is kept as a fingerprint, with its place. Two texts that share gram + window - 1 words in a row share a fingerprint, so
with 7 and 7 no shared span of 13 words is missed. Fingerprints of documents and benchmark items are joined; each hit
gives a diagonal (document place less item place). All diagonals of a text come together in one row, its words are split
once, and along each diagonal the hit is extended: every window of `span` item words that stands in the text there is
found by comparing the words themselves. The work on a text that repeats grows with its places times the item's
windows, not with the square of its words. Items of fewer than `span` words are one window; their only fingerprint is
the hash of all their words, looked for at each place.

A row is known by its id and a hash of its text, nulls included, so each row is judged by its own text alone.

Results for odd input: null and empty texts have no words, hit nothing and are not contaminated; items without words
are never hit; rows that repeat an id are judged one by one, repeated rows alike; a null id is an id like others, and so
is a null item id (a hit by it contaminates, but it is not listed, as it has no name); items that repeat an id are one
item with the windows of all of them; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, keep, let, small, windows

#: What stands between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Low bits of a gram's hash that give way to its place, so that the least of a window is the leftmost of equals and says where it is.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def paired(x: Column, by: int, f) -> Column:
    """[f(x[0], x[by]), f(x[1], x[by + 1]), ...]"""

    def both(a: Column) -> Column:
        n = F.greatest(F.size(a) - by, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), f)

    return let(x, both)


def over(x: Column, n: int, f) -> Column:
    """f over each n neighbours, in about log2(n) passes: f of f over the first and f over the last of them, which may overlap."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x, size = paired(x, step, f), size + step
    return x


def grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    return over(hashes, n, lambda a, b: F.xxhash64(a, b))


def winnow(gram_hashes: Column, window: int, longest: int = PLACE) -> Column:
    """[(place, print)] of the smallest hash of each window (the leftmost of equals), each place once."""
    # texts of more grams than `longest` (PLACE can't tell more apart) go the long way: the same fingerprints, looked for window by window
    short = lambda g: F.array_distinct(over(F.transform(g, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))), window, lambda a, b: F.least(a, b)))
    cut = lambda g: F.transform(g, lambda h: h.bitwiseAND(F.lit(~PLACE)))
    least = lambda g: F.array_distinct(windows(F.size(g) - window + 1, lambda i: let(F.slice(g, i + 1, window), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1)))
    found = lambda q: F.struct(q.bitwiseAND(F.lit(PLACE)).cast("int").alias("place"), q.bitwiseAND(F.lit(~PLACE)).alias("print"))
    long = lambda g: let(cut(g), lambda c: F.transform(least(c), lambda p: F.struct(p.alias("place"), F.element_at(c, p + 1).alias("print"))))
    return let(gram_hashes, lambda g: F.when(F.size(g) <= longest, F.transform(short(g), found)).otherwise(long(g)))


def runs(hashes: Column, n: int) -> Column:
    """[(place, print)] of all runs of n words."""
    return F.transform(grams(hashes, n), lambda h, i: F.struct(i.alias("place"), h.alias("print")))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hits(rows: DataFrame, benchmark: DataFrame, span: int, gram: int, window: int, max_broadcast_bytes: int) -> DataFrame:
    """(doc, named, hits): for each row that shares a fingerprint with items, these items' words and the diagonals.
    rows: doc, named, text; benchmark: item, text."""
    items = keep(benchmark.select("item", alnum_words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct().withColumn("item_key", F.xxhash64("item", "words")))
    h = hashed(F.col("words"))
    long_prints = items.filter(F.size("words") >= span).select("item_key", F.explode(let(h, lambda x: winnow(grams(x, gram), window))).alias("f")).select("item_key", "f.place", "f.print")
    lengths = sorted(r[0] for r in items.filter(F.size("words") < span).select(F.size("words")).distinct().collect())  # span - 1 at most
    short_prints = [items.filter(F.size("words") == n).select("item_key", F.explode(runs(h, n)).alias("f")).select("item_key", "f.place", "f.print") for n in lengths]
    prints = keep(reduce(DataFrame.unionByName, short_prints, long_prints).withColumnRenamed("place", "item_place"))
    own = let(hashed(alnum_words(F.col("text"))), lambda x: F.concat(winnow(grams(x, gram), window), *(runs(x, n) for n in lengths)))
    found = rows.select("doc", "named", F.explode(own).alias("f")).select("doc", "named", "f.place", "f.print").join(small(prints, max_broadcast_bytes), "print")
    pairs = keep(found.groupBy("doc", "named", "item_key").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals")))
    hit = F.struct("item", "words", "diagonals")
    return pairs.join(small(items, max_broadcast_bytes), "item_key").groupBy("doc", "named").agg(F.collect_list(hit).alias("hits"))


def extended(words: Column, hit: Column, span: int) -> Column:
    """[(start, end)]: where windows of the hit's item stand in the text, along its diagonals."""
    theirs = hit["words"]
    length = F.least(F.size(theirs), F.lit(span))

    def along(d: Column) -> Column:
        first = F.greatest(F.lit(0), -d)
        count = F.least(F.size(theirs), F.size(words) - d) - first - length + 1
        at = lambda i: F.when(F.slice(words, first + i + d + 1, length) == F.slice(theirs, first + i + 1, length), first + i + d)
        return F.array_compact(windows(count, at))

    return F.transform(F.flatten(F.transform(hit["diagonals"], along)), lambda s: F.struct(s.cast("long").alias("start"), (s + length).cast("long").alias("end")))


def covered(spans: Column) -> Column:
    """Words covered by sorted spans (start, end), end excluded."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], s["end"]).cast("long").alias("upto"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13, gram: int = 7, window: int = 7, share: int = 20, max_broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """(id, text_hash, n_words, n_hit, items, contaminated) for each row: words inside benchmark windows, the items that hit (as
    sorted strings), and whether there are any and share * n_hit >= n_words. Fingerprints of the benchmark, and the hits, are
    broadcast up to max_broadcast_bytes, joined by shuffle beyond."""
    if gram + window - 1 > span:
        raise ValueError("spans of so few words may share no fingerprint")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("named"), F.col(text_col).alias("text"))
    found = keep(hits(rows.filter("text is not null"), benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), span, gram, window, max_broadcast_bytes))
    # few rows are hit as a rule: then their texts are found without shuffling all texts
    same_row = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["named"] == b["named"])
    f = small(found, max_broadcast_bytes)
    texts = rows.join(f, same_row(rows, f)).select(rows["doc"], rows["named"], "text", "hits").dropDuplicates(["doc", "named"])
    spans = let(alnum_words(F.col("text")), lambda w: F.transform("hits", lambda h: F.struct(h["item"].cast("string").alias("item"), extended(w, h, span).alias("spans"))))
    hit = texts.select("doc", "named", F.filter(spans, lambda x: F.size(x["spans"]) > 0).alias("x")).filter(F.size("x") > 0)
    hit = hit.select("doc", "named", covered(F.array_sort(F.array_distinct(F.flatten(F.col("x.spans"))))).alias("n_hit"), F.array_sort(F.array_distinct(F.array_compact(F.col("x.item")))).alias("items"))
    hit = small(keep(hit), max_broadcast_bytes)
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")).cast("long")
    out = rows.select("doc", "named", n_words.alias("n_words"))
    out = out.join(hit, same_row(out, hit), "left").select(out["doc"], out["named"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("doc").alias(id_col), F.col("named").alias("text_hash"), "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
