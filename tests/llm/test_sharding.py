"""Sharding (4): against the smallest capacity found by brute force."""

import random
import zlib
from collections import defaultdict
from hashlib import md5

from tallyglass.llm.sharding import bucket_offsets, shard_documents


def brute_capacity(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid, used, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            used, at = (used, at + s) if at + s <= mid else (used + 1, s)
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


def check(df, rows, shards, **options):
    got = shard_documents(df, shards=shards, **options).collect()
    assert len(got) == len(rows)
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t or "")
    groups, slots, sizes = {}, defaultdict(list), defaultdict(int)
    for r in got:
        t = text[r["doc_id"]][0]
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        assert groups.setdefault(t, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_group = defaultdict(int)
    for _, t in rows:
        by_group[md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    assert max(sizes.values()) <= brute_capacity([by_group[g] for g in sorted(by_group)], shards)
    return sizes


def test_shards(spark, docs, rows, empty):
    for shards in (1, 3, 24):
        check(docs, rows, shards)
    check(docs, rows, 24, candidates=2, max_fetch=1)  # the search by look-ups alone
    assert shard_documents(empty).count() == 0


def test_hot_group(spark):
    rng = random.Random(2)
    rows = [(k, "copy " * 40) for k in range(300)] + [(1000 + k, "w" * rng.randrange(400)) for k in range(600)]
    sizes = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 8)
    rest = sorted(s for s in sizes.values() if s < 300 * 208)
    assert len(sizes) == 8 and max(rest) < 1.3 * rest[1]


def test_offsets_in_steps(spark):
    rng = random.Random(4)
    names = sorted({f"{rng.randrange(16**5):05x}" for _ in range(500)})
    rows = [(n, rng.randrange(1, 50), rng.randrange(1, 5)) for n in names]
    got = {r["bucket"]: (r["bytes_before"], r["rows_before"]) for r in bucket_offsets(spark.createDataFrame(rows, "bucket string, bytes long, n long"), 5).collect()}
    b = n = 0
    for name, size, count in rows:
        assert got[name] == (b, n)
        b, n = b + size, n + count
