"""Classifier (2), decontamination (3), rules (5), licences (6): against brute force, held-out accuracy, exact tails."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyglass.llm.decontaminate import decontaminate, grams, winnow
from tallyglass.llm.licenses import RULES, SENTENCES, normalise, normalised, scan_licenses
from tallyglass.llm.quality import classify, site_rates
from tallyglass.llm.quality_rules import GRID, lower_tail, quality_rules

from .conftest import SF


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def brute_hits(text, items, span):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        for k in range(len(w) - min(span, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + min(span, len(w))])].add(i)
    w, hit, found = pattern.findall(lower(text)), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if x := windows.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                found |= x
    return len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontaminate(spark, docs, rows, empty):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(501, "tie tie"), (502, "One"), (503, None), (504, ""), (505, "many words in one very long text many words in one very long"), (505, "many words in one very long text many words in one very long"), (506, "x " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1)).withColumn("print", F.lit(2))
    twice = spark.createDataFrame([(1, items[0][1]), (1, "nothing of it here"), (None, items[1][1]), (None, None)], "doc_id long, text string")
    both, all_rows = docs.select("doc_id", "text").unionByName(twice), rows + [(1, items[0][1]), (1, "nothing of it here"), (None, items[1][1]), (None, None)]
    want = [(d, n, h, tuple(i), c) for d, t in all_rows for n, h, i, c in [brute_hits(t, items, 13)]]
    for most in (32 << 20, 0):  # both ways of joining
        got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate(both, bench, max_broadcast_bytes=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 3
    assert decontaminate(docs, bench).columns == ["doc_id", "text_hash", "n_words", "n_hit", "items", "contaminated"]
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_winnow(spark):
    rng = random.Random(8)
    made = [[rng.randrange(-4, 4) << 40 for _ in range(n)] for n in (0, 1, 6, 7, 8, 30, 200)] + [[5 << 40] * 40]
    df = spark.createDataFrame([(x,) for x in made], "g array<long>")
    for longest in (1 << 24, 0):
        got = [[(f["place"], f["print"]) for f in r[0]] for r in df.select(winnow(F.col("g"), 7, longest)).collect()]
        for g, found in zip(made, got, strict=True):
            want = dict.fromkeys(min(range(i, i + 7), key=lambda k: (g[k], k)) for i in range(len(g) - 6))
            assert found == [(k, g[k]) for k in want]
    hashes = spark.createDataFrame([(list(range(20)) + list(range(20)),)], "h array<long>").select(grams(F.col("h"), 7)).first()[0]
    assert len(hashes) == 34 and hashes[:14] == hashes[20:] and len(set(hashes)) == 20


def test_items_without_an_id(spark):
    words = " ".join(f"w{k}" for k in range(13))
    df = spark.createDataFrame([(1, f"so {words} it goes")], "doc_id long, text string")
    got = decontaminate(df, spark.createDataFrame([(None, words), (None, "it goes"), (3, "GOES")], "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], got["items"], got["contaminated"]) == (16, 15, ["3"], True)


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if runs[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_measure_whole_texts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, 1) for d, _ in rows if d is not None] + [(None, 1), (5, None), (77777, 1)], "doc_id long, quality int")
    got = quality_rules(docs, labels).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got), key=str) == sorted(((d, *brute_measures(t)) for d, t in rows), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules(empty, labels).count() == 0


def test_rules_bound_false_rejection(spark):
    rng = random.Random(5)
    texts = []
    for k in range(6_000):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(60)]
        bad = k % 3 == 0
        marks = 30 if bad else rng.random() < 0.3
        texts.append((k, " ".join(words) + " " + "#" * int(marks), "x" if k % 2 else None, int(not bad)))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(df.drop("quality"), df.select("doc_id", "quality"), alpha=0.04).collect()}
    for stratum in ("x", None):
        good, bad = [got[k] for k, _, s, q in texts if s == stratum and q], [got[k] for k, _, s, q in texts if s == stratum and not q]
        assert sum(good) >= 0.96 * len(good) and sum(bad) < 0.1 * len(bad)


def test_lower_tail(spark):
    cases = [(0, 10, 0.1), (3, 10, 0.3), (10, 10, 0.5), (40, 9000, 0.005), (2, 3, 0.9)]
    for k, n, p in cases:
        got = spark.range(1).select(lower_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert math.isclose(got, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    assert all(g == sorted(g) for g in GRID.values())


def test_licenses(spark, docs, empty):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    rest = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    wrapped = lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70)).replace("\n ", "\n").replace(" \n", "\n")
    fold = lambda t: re.sub(r"(.{1,70}) ", r"\1\n", t)
    cases = [
        (1, f"Code.\n\n{mit}\n\n{rest}\n\n{as_is}\n", "MIT"), (2, f"{fold(mit)}\n\n{fold(rest)}\n\n{fold(as_is)}", "MIT"), (3, f"{as_is}\n{rest}\n{mit}", ""), (4, "Licensed under CC BY-NC 4.0.\nsome words", "CC-BY-NC-4.0"),
        (5, "licensed under the apache license, version 2.0. Released under the MIT License.", "Apache-2.0,MIT"), (6, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), (7, "It was licensed once.", ""), (8, None, ""), (9, "", ""),
        (10, "/* SPDX-License-Identifier: LGPL-2.1-or-later */\nint x;", "LGPL-2.1"), (11, "Licensed under CC BY-NC-SA 4.0. Released under the Mozilla Public License, version 2.0.", "CC-BY-NC-SA-4.0,MPL-2.0"),
        (12, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        (13, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
        (14, "version 2 of the License. This program is free software; said once.", ""), (15, "All rights reserved. " * 20_000, "all-rights-reserved"),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {d: r["licenses"] for d, r in got.items()} == {c[0]: c[2] for c in cases}
    assert [got[k]["license_class"] for k in (1, 4, 6, 7, 8)] == ["permissive", "restricted", "copyleft", "none", "none"]
    assert got[5]["sentence_ids"] == "apache-notice,mit-notice"
    assert len(RULES) > 50 and {i for _, r in RULES for i in r} <= SENTENCES.keys() and len({normalise(s) for x in SENTENCES.values() for s in x}) == sum(len({normalise(s) for s in x}) for x in SENTENCES.values())
    assert scan_licenses(docs).count() == docs.count() and scan_licenses(empty).count() == 0
    assert wrapped(mit)
    text = "(The) Version 2.0, A.B 3. x!"
    assert spark.range(1).select(normalised(F.lower(F.lit(text)))).first()[0] == normalise(text) == "the version 2.0 a b 3 x"


def made_corpus(n):
    rng = random.Random(9)
    out = []
    for k in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 80))]
        low, toxic = k % 10 == 0, k % 10 == 1
        if low:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilenoun", "vilely", "nastyish", "nastyer"])
        out.append((k, " ".join(words), f"h{k % 5}" if k % 2 else None, "p", int(not low), int(toxic)))
    return out


def test_classifier_held_out(spark, docs, empty):
    made = made_corpus(3_000)
    df = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, quality int, toxic int")
    labels = df.filter("doc_id % 2 = 0 or doc_id % 10 = 1 and doc_id % 20 = 1").select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(None, 1, 0), (7, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int"))
    seen = {r["doc_id"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in classify(df.drop("quality", "toxic"), labels).collect()}
    held = [m for m in made if m[0] not in seen]
    bad = [m for m in held if m[5] or not m[4]]
    good = [m for m in held if m not in bad]
    assert sum(got[m[0]]["kept"] for m in good) >= 0.98 * len(good)
    assert sum(not got[m[0]]["kept"] for m in bad) >= 0.95 * len(bad)
    out = classify(docs, labels)
    assert out.count() == docs.count() and out.filter("kept is null").count() == 0
    assert classify(docs, labels.filter("false")).filter("kept").count() == docs.count()
    assert classify(empty, labels).count() == 0


def test_site_rates_by_brute_force(spark):
    rng = random.Random(3)
    made = [(f"h{h}", f"p{p}", rng.random() * (0.2 + 0.1 * h), rng.random() ** 3) for h in range(5) for p in range(rng.randrange(1, 6)) for _ in range(rng.choice([1, 3, 40]))] + [("", "", 0.5, 0.5)]
    got = {(r["host"], r["path"]): (r["rate_low"], r["rate_toxic"]) for r in site_rates(spark.createDataFrame(made, "host string, path string, p_low double, p_toxic double")).collect()}

    def shrunk_to(sites, upper):
        """sites: key -> (documents, sum of probabilities); upper: key -> rate."""
        spread = sum(n * (s / n - upper[k]) ** 2 for k, (n, s) in sites.items())
        chance, scale = sum(upper[k] * (1 - upper[k]) for k in sites), sum(n * upper[k] * (1 - upper[k]) for k, (n, _) in sites.items())
        extra = (spread - chance) / scale
        weight = min(1e6, max(1.0, 1 / extra - 1)) if extra > 1e-6 else 1e6
        return {k: (s + weight * upper[k]) / (n + weight) for k, (n, s) in sites.items()}

    for t in (0, 1):
        paths, hosts = defaultdict(lambda: (0, 0.0)), defaultdict(lambda: (0, 0.0))
        for h, p, *x in made:
            paths[h, p], hosts[h] = (paths[h, p][0] + 1, paths[h, p][1] + x[t]), (hosts[h][0] + 1, hosts[h][1] + x[t])
        world = sum(x[2 + t] for x in made) / len(made)
        of_host = shrunk_to(hosts, dict.fromkeys(hosts, world))
        want = shrunk_to(paths, {k: of_host[k[0]] for k in paths})
        assert got.keys() == want.keys() and all(math.isclose(got[k][t], want[k], rel_tol=1e-9) for k in want)


def test_posterior_joins_evidence_and_site(spark):
    made = made_corpus(600)
    df = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, quality int, toxic int")
    got = classify(df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic"), rounds=1).collect()
    assert {r["host"] for r in got} == {None, "h1", "h3", "h0", "h2", "h4"} and {r["path"] for r in got} == {"p"}
    assert all(0 <= r["p_low"] <= 1 and 0 <= r["p_toxic"] <= 1 and r["kept"] == (r["p_low"] < 0.5 and r["p_toxic"] < 0.5) for r in got)
