"""Measures over whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bind, words


def ngrams(w: Column, n: int = 3) -> Column:
    return bind(w, lambda x: F.transform(F.slice(x, F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(0))), lambda a, i: F.concat_ws(" ", a, *(F.get(x, i + k) for k in range(1, n)))))


def ngram_counts(docs: DataFrame, text: str, n: int = 3) -> DataFrame:
    return docs.select(F.explode(ngrams(words(F.col(text)), n)).alias("ngram")).groupBy("ngram").count()


def divergence(target: DataFrame, baseline: DataFrame, text: str, n: int = 3) -> DataFrame:
    """One row: ``kl``, the divergence of the target's n-grams from the baseline's with one added to every count."""
    t, b = ngram_counts(target, text, n).withColumnRenamed("count", "t"), ngram_counts(baseline, text, n).withColumnRenamed("count", "b")
    total, other = t.agg(F.sum("t").alias("total")), b.agg(F.sum("b").alias("base"), F.count("*").alias("kinds"))
    both = t.join(b, "ngram", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    sums = both.groupBy("t", "b").count()  # few distinct count pairs, so the totals meet few rows
    each = sums.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(other))  # one row each
    p = F.col("t") / F.col("total")
    q = (F.col("b") + 1) / (F.col("base") + F.col("kinds"))
    return each.agg(F.sum(F.col("count") * p * F.ln(p / q)).alias("kl"))


def thresholds(metrics: DataFrame, by: list[str], names: list[str], k: float = 2.0) -> DataFrame:
    """Mean, deviation and mean less ``k`` deviations of each measure."""
    cols = []
    for m in names:
        cols += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), (F.avg(m) - k * F.stddev_samp(m)).alias(f"{m}_threshold")]
    return metrics.groupBy(*by).agg(*cols)


def agreement(flags: list[Column], least: int) -> Column:
    """Whether at least so many flags agree."""
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return total >= least


def unknown_entities(found: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Entities that the table of known ones lacks."""
    return found.join(known.select(on), on, "left_anti")


def unigram_log_probability(docs: DataFrame, key: str, text: str, reference: DataFrame) -> DataFrame:
    """Mean log-probability of a text's words under a smoothed unigram model of a reference corpus."""
    counts = ngram_counts(reference, text, 1).withColumnRenamed("count", "c")
    total = counts.agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    each = docs.select(key, F.explode(words(F.col(text))).alias("ngram")).groupBy(key, "ngram").count()
    p = (F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + F.col("kinds") + 1)
    return each.join(counts, "ngram", "left").crossJoin(F.broadcast(total)).groupBy(key).agg((F.sum(F.col("count") * F.ln(p)) / F.sum("count")).alias("mean_log_probability"))
