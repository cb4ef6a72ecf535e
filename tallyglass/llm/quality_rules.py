"""Quality rules whose cutoffs are chosen under control of false rejection, with DataFrame functions only.

Labelled good documents are the holdout, but for those that fail the base rule: these are rejected anyway, and the guarantee is
about the others. For each stratum, rule and cutoff of a fixed grid the number of good documents that the rule would reject
is counted. Cutoffs of a rule are nested, so they are tested in order from the loosest on and the first failure ends the
order: no correction is needed inside a rule, and Bonferroni's covers strata and rules. A cutoff is certified if so few
rejections would be unlikely (the exact binomial lower tail, below delta over the number of strata and rules) were the
true rate of false rejections alpha over the number of rules or more; of these the strictest is taken. So with probability
1 - delta the rules together reject at most a share alpha of the good documents of each stratum. A stratum with too few
labels has no such cutoff (with the defaults, and 4 strata, it takes about 1,150), and there its rules reject nothing.

Results for odd input: null and empty texts have no words and fail the base rule (too short); a null stratum is a
stratum; labels of unknown documents, null labels and labels other than 1 are not holdout; a label that repeats counts once,
and so does a labelled text that repeats its id; repeated rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, space_words, windows

#: Cutoffs of each rule, the strictest first. A document is rejected if its score is above the cutoff.
GRID = {
    "symbol_share": [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "dup_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_word_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "mean_word_chars": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}


def repeat_words(words: Column, n: int = 3) -> Column:
    """Words in windows of n words that are found twice or more in the text. Sorted by hash, equal windows stand side by side."""
    keys = windows(F.size(words) - n + 1, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, n)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, k: x["h"] == F.get(s, k)["h"]
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"]))

    def union(starts: Column) -> Column:
        acc = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        step = lambda a, i: F.struct((a["n"] + n - F.greatest(F.lit(0), a["upto"] - i)).alias("n"), (i + n).alias("upto"))
        return F.aggregate(starts, acc, step, lambda a: a["n"])

    return union(let(F.sort_array(keys), repeated))


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(doc, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = space_words(F.col(text_col))
    long = lambda c: c.cast("long")
    return docs.select(
        F.col(id_col).alias("doc"),
        F.col(stratum_col).cast("string").alias("stratum"),
        let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.coalesce(F.length(F.array_join(w, "")), F.lit(0))).alias("word_chars"), long(repeat_words(w)).alias("n_repeat_words"))).alias("w"),
        long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("x"),
    ).select("doc", "stratum", "w.*", "n_symbols", "x.*")


def scores() -> dict[str, Column]:
    """The score of each rule, from the measures; 0 where there is nothing to measure."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words"), "mean_word_chars": share("word_chars", "n_words")}


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), X binomial (n, p), in logarithms so that large n lose nothing."""
    p_ = F.lit(p)
    first = n * F.log(1 - p_)
    acc = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(p_ / (1 - p_))
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    return F.when(k >= n, 1.0).otherwise(F.exp(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), acc, step, lambda a: a["total"])))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff, n, k): the strictest certified cutoff of each stratum and rule; rows only where there is one.
    measured: what measures() gave, base failures left out; labels: doc, good."""
    held = labels.filter(F.col("good") == 1).select("doc").distinct().join(measured, "doc").distinct().select("stratum", *(c.alias(r) for r, c in scores().items()))
    counts = [F.struct(F.lit(r).alias("rule"), F.lit(float(x)).alias("cutoff"), F.count_if(F.col(r) > x).alias("k")) for r, grid in GRID.items() for x in grid]
    tested = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*counts).alias("c"))
    tested = keep(tested.select("stratum", "n", F.explode("c").alias("c")).select("stratum", "n", "c.*"))
    tests = max(tested.select("stratum", "rule").distinct().count(), 1)
    # far too many rejections need no tail: it is over one half above the mean
    tail = F.when(F.col("k") > F.col("n") * (alpha / len(GRID)), 1.0).otherwise(lower_tail(F.col("k"), F.col("n"), alpha / len(GRID)))
    return tested.filter(tail <= delta / tests).groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n", "k")).alias("c")).select("stratum", "rule", "c.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, kept) for each row."""
    measured = keep(measures(docs, id_col, text_col, stratum_col))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chosen = keep(cutoffs(measured.filter(~base_failed), labels.select(F.col(id_col).alias("doc"), F.col(label_col).alias("good")), alpha, delta))
    # a row for each stratum; the join on stratum is by broadcast where there are few of them
    by_stratum = chosen.withColumnRenamed("stratum", "of_stratum").groupBy("of_stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in GRID))
    scored = measured.join(F.broadcast(by_stratum) if chosen.count() <= 100_000 else by_stratum, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(c > F.col(f"{r}_cutoff"), F.lit(r)) for r, c in scores().items())))
    out = scored.withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return out.select(F.col("doc").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
