"""Statistics of sentences and words. All are narrow: no text leaves its row, so they run in streams too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import bind, ratio, words


def sentence_lengths(text: Column) -> Column:
    """Word counts of the sentences of over three words."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.size(words(s))), lambda n: n > 3)


def sentence_stats(lengths: Column) -> Column:
    """``n, total, spread, mean, median, sd``; numbers are null under two sentences.

    ``spread`` is ``n sum(x^2) - sum(x)^2``, an integer, so flags compare integers.
    """

    def of(x: Column) -> Column:
        n = F.size(x).cast("long")
        total = F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
        square = F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
        ordered = F.array_sort(x)
        half = F.floor(n / 2).cast("int")
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, half)) / F.lit(2.0)
        spread = n * square - total * total
        some = n >= 2
        return F.struct(
            n.alias("n"), F.when(some, total).alias("total"), F.when(some, spread).alias("spread"),
            F.when(some, total / n).cast("double").alias("mean"), F.when(some, middle).cast("double").alias("median"),
            F.when(some, F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0)))).cast("double").alias("sd"),
        )

    return bind(lengths, of)


def ttr(w: Column) -> Column:
    """Distinct words by words; null for none."""
    return ratio(F.size(F.array_distinct(w)), F.size(w))


def mattr(w: Column, window: int = 100) -> Column:
    """Mean share of distinct words over all windows; under one window the plain share.

    A word adds to a window where it stands first: in those that start after its former place. In order of word and
    place a word's former place is its neighbour's.
    """

    def of(s: Column) -> Column:
        last = F.size(s) - window

        def adds(x: Column, k: Column) -> Column:
            return bind(F.get(s, k - 1), lambda before: count(x["j"], F.when(before["h"] == x["h"], before["j"] + 1).otherwise(0)))

        def count(j: Column, after: Column) -> Column:
            return F.greatest(F.lit(0), F.least(j, last) - F.greatest(F.lit(0), j - (window - 1), after) + 1).cast("long")

        total = F.aggregate(F.transform(s, adds), F.lit(0).cast("long"), lambda a, v: a + v)
        return total / (F.lit(window) * (last + 1)).cast("double")

    placed = F.array_sort(F.transform(w, lambda x, j: F.struct(F.xxhash64(x).alias("h"), j.alias("j"))))
    return F.when(F.size(w) >= window, bind(placed, of)).otherwise(ttr(w))


def repeated_ngrams(w: Column, n: int = 3, least: int = 2) -> Column:
    """Structs ``first, ngram, count`` of the n-grams that occur ``least`` times or more, in order of first sight."""

    def of(x: Column) -> Column:
        grams = F.transform(F.slice(x, F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(0))), lambda a, i: F.struct(F.concat_ws(" ", a, *(F.get(x, i + k) for k in range(1, n))).alias("ngram"), i.alias("first")))
        return bind(F.array_sort(grams), runs)

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda g, i: F.when((i == 0) | (g["ngram"] != F.get(s, i - 1)["ngram"]), i)), lambda i: i.isNotNull())
        return bind(starts, lambda b: F.transform(b, lambda at, j: F.struct(F.get(s, at)["first"].alias("first"), F.get(s, at)["ngram"].alias("ngram"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).cast("long").alias("count"))))

    return F.array_sort(F.filter(bind(w, of), lambda g: g["count"] >= least))
