"""The pipeline: planted cases go, clean documents stay with the ids that the library gives, stage by stage."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .test_filters import made_corpus


def words(rng, n):
    return ["".join(rng.choices("klmnopqrstu", k=rng.randint(3, 8))) for _ in range(n)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    made = made_corpus(1_500)
    line = lambda n: " ".join(words(rng, n)) + "."
    clean = {10_000 + k: "\n".join(line(12) for _ in range(4)) for k in range(20)}
    passage = " ".join(words(rng, 60)) + "."
    base = words(rng, 200)
    near = " ".join("changed" if k in (40, 80, 120, 160) else w for k, w in enumerate(base))  # too near for the one, too scattered for runs of 50 words
    items = [(k, " ".join(words(rng, 30))) for k in range(5)]
    planted = {
        20_000: "\n".join([line(20), passage, line(20)]), 20_001: "\n".join([line(20), passage, line(20)]),  # a passage that repeats
        20_010: clean[10_000],  # an exact copy
        20_020: " ".join(base), 20_021: near,  # near copies
        20_030: line(20) + " " + items[2][1], 20_031: line(20) + " " + " ".join(items[3][1].split()[:12]),  # contaminated; 12 words only
        20_040: None, 20_041: "",
    }
    rows = [(d, t, "h1", "p") for d, t, *_ in made] + [(d, t, "h1", "p") for d, t in (clean | planted).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(m[0], m[4], m[5]) for m in made], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None
    seen, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns == before.columns or k == len(cp.STAGES) - 1
        seen.append({r["doc_id"]: r for r in docs.collect()})
    kept, cut, deduped, decontaminated, encoded = seen
    bad = {m[0] for m in made if m[5] or not m[4]}
    assert len(bad - kept.keys()) >= 0.95 * len(bad) and len({m[0] for m in made} - bad - kept.keys()) <= 0.02 * len(made)
    assert (clean.keys() | planted.keys()) <= kept.keys() | {20_040, 20_041}
    assert passage in cut[20_000]["text"] and passage not in cut[20_001]["text"] and cut[20_001]["n_chars"] == len(cut[20_001]["text"])
    assert 20_020 in deduped and 20_021 not in deduped and 20_010 not in deduped
    assert 20_030 not in decontaminated and 20_031 in decontaminated
    assert clean.keys() <= encoded.keys() == decontaminated.keys()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in [*clean, 20_001]:
        assert encoded[d]["ids"] == lib.encode(decontaminated[d]["text"], add_special_tokens=False).ids and encoded[d]["n_tokens"] == len(encoded[d]["ids"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, docs, tmp_path):
    """Null, empty, very long and repeated texts, ties, rows without an id, extra columns whose names clash: nothing breaks, each row is
    judged by its own text, and all columns are carried along."""
    items = [(k, " ".join(words(random.Random(k), 30))) for k in range(3)]
    extra = {c: "x" for c in docs.columns[5:]}
    odd = [(None, items[0][1], "en", "s", 0, *extra.values()), (7001, items[1][1], "en", "s", 0, *extra.values()), (7001, "one clean text under the same id", "en", "s", 0, *extra.values()), (None, "words without an id that nobody has", "en", "s", 0, *extra.values())]
    both = docs.withColumn("gone_id", F.lit(1)).withColumn("copy_doc", F.lit(2)).unionByName(spark.createDataFrame(odd, docs.schema).withColumn("gone_id", F.lit(1)).withColumn("copy_doc", F.lit(2)))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns == before.columns or k == len(cp.STAGES) - 1
        if k == 3:
            left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = {t for d, t in left if d is None}
    assert (7001, "one clean text under the same id") in left and (7001, items[1][1]) not in left
    assert "words without an id that nobody has" in texts and items[0][1] not in texts
    assert {9001, 9002, 9003, 9004} <= {d for d, _ in left} and docs.count() == len(left) <= n
