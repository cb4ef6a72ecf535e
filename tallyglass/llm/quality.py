"""Quality classifier by hierarchical empirical Bayes.

A document's evidence is a naive Bayes classifier's: whole words and their prefixes, and bins of some measures of its
shape, each with the log odds that labelled documents give it. Its sum is calibrated on labelled documents that had no
part in these odds: a likelihood ratio for each bin of the sum. There are two targets, low quality and toxicity. Both
fits use a bounded sample of labelled documents (max_fit_docs, the first by the hash of their ids; near copies counted once; a
quarter for calibration);
everything else covers all rows.

Sites then lend each other strength. From the evidence of all documents come the global rate of a target, and rates of
hosts and of paths within hosts, by grouped sums. A host's rate is shrunk toward the global one, a path's toward its
host's, each as if `weight` more documents had been seen at the upper rate. The weight is estimated from the hosts (or
paths) themselves, by moments of a beta distribution: the less their rates differ beyond chance, the more they shrink,
so sparse sites fall back on what is above them. A document's posterior joins its evidence with its path's prior; from
the posteriors the rates are estimated again, a few times.

Results for odd input: null and empty texts have only their shape as evidence; null hosts and paths are a host and a path;
labels that are null or of unknown documents are not used; rows that repeat an id are rated each by its text; without
labelled documents of both kinds a target has no evidence and rejects nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, let, small, space_words, windows

TARGETS = ("low", "toxic")
WORD = re.compile(r"\w+")
#: Lengths of word prefixes that are features of their own.
PREFIXES = (4, 5, 6)
#: A feature counts if it is in at least so many labelled documents. Its log odds are shrunk toward 0 by some standard
#: errors, so that chance finds vanish; by how many, held-out documents decide.
MIN_DOCS, SHRINKS = 5, (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
#: A text is looked through in stretches of about so many characters, cut at space.
STRETCH = 1 << 20


def word_features(text: str) -> set[str]:
    found: set[str] = set()
    at = 0
    while at < len(text):
        end = text.find(" ", at + STRETCH)
        end = len(text) if end < 0 else end
        found.update(WORD.findall(text[at:end].lower()))
        at = end
    return found | {f"{w[:n]}*" for w in found for n in PREFIXES if len(w) > n}


def shape_features(text: str) -> list[str]:
    """Bins of measures of the whole text."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    measures = {
        "words": math.log2(n) / 2,
        "distinct": 10 * len(set(words)) / n,
        "twice": 10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "runs": 10 * sum(c for c in runs.values() if c > 1) / n,
        "upper": 10 * sum(map(str.isupper, words)) / n,
        "marks": 10 * sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n,
        "pipes": 20 * (text.count("|") + text.count("\t")) / n,
        "digits": 10 * sum(map(text.count, "0123456789")) / chars,
        "lines": 10 * len(set(lines)) / max(1, len(lines)),
        "length": chars / n / 2,
    }
    return [f"={name}:{min(20, int(x))}" for name, x in measures.items()]


def sketch(text: Column, pick) -> Column:
    """A hash that near copies of a text share as a rule: the least or greatest over its runs of 5 words; of short texts, of all words."""
    words = space_words(text)
    return let(words, lambda w: F.coalesce(pick(windows(F.size(w) - 4, lambda i: F.xxhash64(F.slice(w, i + 1, 5)))), F.xxhash64(w)))


def labelled(docs: DataFrame, labels: DataFrame, max_fit_docs: int) -> DataFrame:
    """(text, low, toxic, held) of a bounded sample of labelled documents, of near copies one; a quarter is held out. Words of a
    text that was copied often would else pass for words that often come with its label."""
    chosen = keep(labels.filter("doc is not null").groupBy("doc").agg(*(F.max(t).alias(t) for t in TARGETS)).orderBy(F.xxhash64("doc")).limit(max_fit_docs))
    sample = docs.join(small(chosen), "doc").select("doc", "text", *TARGETS)
    for pick in (F.array_min, F.array_max):
        first = F.min_by(F.struct(*sample.columns), F.struct(F.xxhash64("doc"), F.xxhash64("text"))).alias("r")
        sample = sample.groupBy(sketch(F.col("text"), pick).alias("k")).agg(first).select("r.*")
    return keep(sample.select("text", *TARGETS, (F.pmod(F.xxhash64(F.lit("held"), "doc"), F.lit(4)) == 0).alias("held")))


def fit(sample: DataFrame) -> dict[str, dict]:
    """For each target the rate among labelled documents, and of its features the log odds with their standard errors.
    The sample bounds their number."""

    def explode(batches):
        for b in batches:
            for t, *y in zip(*(b.column(k).to_pylist() for k in range(1 + len(TARGETS))), strict=True):
                f = [*word_features(t or ""), *shape_features(t or ""), ""]  # "" is in each document
                yield pa.RecordBatch.from_arrays([pa.array(f), *(pa.array([v] * len(f), pa.int32()) for v in y)], names=["feature", *TARGETS])

    ones = [F.sum(F.col(t)).alias(f"{t}_1") for t in TARGETS]
    known = [F.count(F.col(t)).alias(f"{t}_n") for t in TARGETS]
    often = " or ".join(f"{t}_n >= {MIN_DOCS}" for t in TARGETS)
    counts = keep(arrow_map(sample.filter("not held").select("text", *TARGETS), explode, "feature string, low int, toxic int").groupBy("feature").agg(*ones, *known).filter(f"{often} or feature = ''"))
    total = counts.filter("feature = ''").first()
    models = {}
    for t in TARGETS:
        n1, n = (total[f"{t}_1"] or 0, total[f"{t}_n"]) if total else (0, 0)
        models[t] = {"rate": n1 / n if n else 0.0, "features": {}, "odds": {}, "bins": []}
        if not n1 or n1 == n:
            continue
        # counts with a pseudo count of one document in all, spread over both kinds as they are
        c1, c0 = F.col(f"{t}_1") + n1 / n, F.col(f"{t}_n") - F.col(f"{t}_1") + (1 - n1 / n)
        rated = counts.filter((F.col("feature") != "") & (F.col(f"{t}_n") >= MIN_DOCS)).select("feature", (F.log(c1 / (n1 + 1)) - F.log(c0 / (n - n1 + 1))).alias("odds"), F.sqrt(1 / c1 + 1 / c0).alias("error"))
        sure = F.abs("odds") - min(SHRINKS) * F.col("error")
        # absence of a common word says little of a text in another language: only what speaks for the target, or shape, counts
        rated = rated.filter((sure > 0) & ((F.col("odds") > 0) | F.col("feature").startswith("=")))
        models[t]["features"] = {f: (x, e) for f, x, e in rated.collect()}
    return models


def shrink(features: dict[str, tuple[float, float]], z: float) -> dict[str, float]:
    """Log odds moved toward 0 by z standard errors, those that reach it left out."""
    return {f: math.copysign(abs(x) - z * e, x) for f, (x, e) in features.items() if abs(x) > z * e}


def score(found: set[str], shape: list[str], odds: dict[str, float]) -> float:
    """Sum of log odds: of overlapping features (a word and its prefixes) the strongest counts."""
    groups: dict[str, float] = {}
    for f in found:
        if (x := odds.get(f)) is not None:
            g = f[: PREFIXES[0]]
            groups[g] = max(x, groups.get(g, 0.0))
    return sum(groups.values()) + sum(odds.get(f, 0.0) for f in shape)


def pooled(by_bin: dict[int, list[float]]) -> tuple[list[tuple[float, float]], float]:
    """(bins, log likelihood): bins are (lowest score, log likelihood ratio), neighbours pooled until the ratio rises with the score."""
    n1, n0 = (sum(c[k] for c in by_bin.values()) for k in (0, 1))
    pools: list[list[float]] = []
    for x, (c1, c0) in sorted(by_bin.items()):
        pools.append([x, c1, c0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, c1, c0 = pools.pop()
            pools[-1][1] += c1
            pools[-1][2] += c0
    if not n1 or not n0:
        return [], -math.inf
    likelihood = sum(c1 * math.log((c1 + 0.5) / (c1 + c0 + 1)) + c0 * math.log((c0 + 0.5) / (c1 + c0 + 1)) for _, c1, c0 in pools)
    return [(x, math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))) for x, c1, c0 in pools], likelihood


def calibrate(sample: DataFrame, models: dict[str, dict]) -> None:
    """By the held-out documents: chooses how far each target's odds are shrunk, and gives it the likelihood ratios of its bins."""
    tried = {t: [shrink(models[t]["features"], z) for z in SHRINKS] for t in TARGETS}
    shared = sample.sparkSession.sparkContext.broadcast(tried)

    def rate(batches):
        for b in batches:
            for text, *labels in zip(*(b.column(k).to_pylist() for k in range(1 + len(TARGETS))), strict=True):
                found, shape = word_features(text or ""), shape_features(text or "")
                rows = [(t, k, max(-10, min(30, math.floor(score(found, shape, odds)))), y) for t, y in zip(TARGETS, labels, strict=True) if y is not None for k, odds in enumerate(shared.value[t])]
                yield pa.RecordBatch.from_pylist([dict(zip(("target", "k", "bin", "y"), r, strict=True)) for r in rows], pa.schema([("target", pa.string()), ("k", pa.int32()), ("bin", pa.int32()), ("y", pa.int32())]))

    binned = arrow_map(sample.filter("held").select("text", *TARGETS), rate, "target string, k int, bin int, y int")
    tables: dict[tuple[str, int], dict[int, list[float]]] = {}
    for r in binned.groupBy("target", "k", "bin", "y").count().collect():  # targets, shrinkages, 41 bins, 2 labels
        tables.setdefault((r["target"], r["k"]), {}).setdefault(r["bin"], [0.0, 0.0])[1 - r["y"]] += r["count"]
    for t in TARGETS:
        found = [(*pooled(tables.get((t, k), {})), k) for k in range(len(SHRINKS))]
        bins, _, k = max(found, key=lambda x: x[1])
        if models[t]["features"] and bins:
            models[t] |= {"odds": tried[t][k], "bins": bins}
    for t in TARGETS:
        models[t].pop("features")


def evidence(text: str | None, models: dict[str, dict]) -> list[float]:
    """Log likelihood ratio of each target given the text alone."""
    found, shape, out = word_features(text or ""), shape_features(text or ""), []
    for t in TARGETS:
        bins = models[t]["bins"]
        out.append(bins[max(0, bisect.bisect_right(bins, (score(found, shape, models[t]["odds"]), math.inf)) - 1)][1] if bins else 0.0)
    return out


def shrunk(sites: DataFrame, target: str, upper: Column) -> DataFrame:
    """sites (n, s_target: documents and the sum of their probabilities) with rate_target: s / n shrunk toward upper by a weight estimated from all sites."""
    n, mean = F.col("n"), F.col(f"s_{target}") / F.col("n")
    # moments: variance between sites beyond that of so many draws each
    moments = sites.agg(F.sum(n * F.pow(mean - upper, 2)).alias("spread"), F.sum(upper * (1 - upper)).alias("chance"), F.sum(n * upper * (1 - upper)).alias("scale")).first()
    extra = ((moments["spread"] or 0.0) - (moments["chance"] or 0.0)) / moments["scale"] if moments["scale"] else 0.0
    weight = min(1e6, max(1.0, 1 / extra - 1)) if extra > 1e-6 else 1e6
    return sites.withColumn(f"rate_{target}", (F.col(f"s_{target}") + weight * upper) / (n + weight))


def site_rates(rated: DataFrame) -> DataFrame:
    """(host, path, rate_low, rate_toxic) from the documents' probabilities p_low and p_toxic."""
    sums = lambda c: [F.sum(c.format(t)).alias(f"s_{t}") for t in TARGETS]
    paths = keep(rated.groupBy("host", "path").agg(F.count("*").alias("n"), *sums("p_{}")))
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("n"), *sums("s_{}")))
    world = hosts.agg(F.sum("n").alias("n"), *sums("s_{}")).first()
    for t in TARGETS:
        hosts = shrunk(hosts, t, F.lit((world[f"s_{t}"] or 0.0) / (world["n"] or 1)))
    priors = paths.join(hosts.select("host", *(F.col(f"rate_{t}").alias(f"up_{t}") for t in TARGETS)), "host")
    for t in TARGETS:
        priors = shrunk(priors, t, F.col(f"up_{t}"))
    return keep(priors.select("host", "path", *(f"rate_{t}" for t in TARGETS)))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, quality_col: str = "quality", toxic_col: str = "toxic",
    max_fit_docs: int = 20_000, cutoff: float = 0.5, rounds: int = 4,
) -> DataFrame:
    """(id, text_hash, host, path, p_low, p_toxic, kept) for each row: posterior probabilities that it is low or toxic; kept if both are below cutoff.
    rounds: how often the sites' rates are estimated anew from the posteriors that they led to.
    host, path: where a document is from, coarse and fine; the columns source and lang by default."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    # a null site is a site too: names get a mark in front, null is the one without
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    plain = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), marked(host).alias("host"), marked(path).alias("path"), F.xxhash64(text_col).alias("named"))
    bad = (F.col(quality_col) == 0).cast("int")
    sample = labelled(rows.select("doc", "text"), labels.select(F.col(id_col).alias("doc"), bad.alias("low"), F.col(toxic_col).cast("int").alias("toxic")), max_fit_docs)
    models = fit(sample)
    calibrate(sample, models)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def rate(batches):
        m = shared.value
        for b in batches:
            scores = [evidence(t.as_py(), m) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in (2, 3, 4)), *(pa.array([s[k] for s in scores], pa.float64()) for k in range(len(TARGETS)))], names=["doc", "host", "path", "named", *(f"e_{t}" for t in TARGETS)])

    kind = rows.schema["doc"].dataType.simpleString()
    rated = keep(arrow_map(rows, rate, f"doc {kind}, host string, path string, named long, e_low double, e_toxic double"))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    logit = lambda p: F.log(p / (1 - p))
    priors = None
    for k in range(rounds + 1):
        now = rated if priors is None else rated.join(small(priors), ["host", "path"], "left")
        for t in TARGETS:
            prior = F.lit(models[t]["rate"]) if priors is None else F.col(f"rate_{t}")
            prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
            now = now.withColumn(f"p_{t}", logistic(F.col(f"e_{t}") + logit(prior)) if models[t]["bins"] else F.lit(0.0))
        if k < rounds:
            priors = site_rates(now)
    return now.select(F.col("doc").alias(id_col), F.col("named").alias("text_hash"), plain("host"), plain("path"), *(f"p_{t}" for t in TARGETS), ((F.col("p_low") < cutoff) & (F.col("p_toxic") < cutoff)).alias("kept"))
