"""Quality scores by positive-unlabelled learning with the non-negative risk.

A logistic model over binned surface measures minimises
``pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives))``. Positives are trusted documents,
unlabelled ones are all other web text that no one has judged. Both risks, the bins' quantiles and the class prior cover
all training rows: every step sums the gradient on the executors, over one byte a measure and row, and only a number a
weight reaches the driver. Steps start from a fit on a sample of ``START`` rows of each kind.

The class prior ``pi`` is estimated from positives and unlabelled rows alone: the unlabelled part of any set of texts is
at least ``pi`` times the trusted part of it, so the least ratio over the sets "scored over t" bounds it, and meets it
where hardly a bad text is left. The score that orders the texts is a first fit at a prior of one half to half of the rows;
the other half is counted.

Cases: null and empty texts have all measures zero and get a score like any other; without a positive
or an unlabelled row every score is 0.5; equal texts, equal scores; an id is trusted if all its labels are 1, and
judged rows that are not trusted teach nothing; all rows of a repeated id are taken; null ids are never judged; texts of
any length are measured whole; empty in, empty out; columns that are not named are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop, fold, map_arrow, materialize

#: Rows of each kind from which steps start, steps over all rows, and the shares at which measures are cut into bins.
START, STEPS = 12_000, 24
CUTS = [0.01, 0.03, 0.05, *(i / 12 for i in range(1, 12)), 0.95, 0.97, 0.99]
#: Least part of the trusted rows in a set that bounds the prior, and cells of its score.
LEAST, CELLS = 0.8, 1000
MARKS = [re.compile(p) for p in (r"[#$%&*^~@<>{}\\\[\]=_+]", r"[.,;:?'\"()-]", r"!", r"\|", r"[0-9]", r"[A-ZÀ-ÞŒ]")]
MEASURES = 19


def measures(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    chars = len(text)
    share = [len(p.findall(text)) / chars for p in MARKS]
    count = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    low = Counter(text.lower().split())
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    top = count.most_common(5)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), lengths.max(), len(count) / n ** 0.8, top[0][1] / n, sum(c for _, c in top) / n,
        len(low) / len(count), same, pairs, len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(len, words)) / chars, *share,
    ]


class Model:
    """Additive logistic model over bins."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, "right") for e, v in zip(self.edges, x.T)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[np.arange(x.shape[1]), self.bins(x)].sum(1) + self.bias)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(theta: np.ndarray, bins: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Risk and gradient parts of some rows, for unlabelled rows and then for positive ones: their number, the sum of their
    scores, and for each weight the sum of the scores' slopes that it touches. The loss is the score itself (the
    sigmoid loss), so the share of unlabelled rows that score high is drawn to the prior."""
    k = bins.shape[1]
    width = (theta.size - 1) // k
    flat = bins.astype(np.int64) + np.arange(k) * width
    s = _sigmoid(theta[flat].sum(1) + theta[-1])
    out = []
    for kind in (~positive, positive):
        g = (s * (1 - s))[kind]
        out += [[kind.sum(), s[kind].sum()], np.bincount(flat[kind].ravel(), np.repeat(g, k), theta.size - 1), [g.sum()]]
    return np.concatenate(out)


def gradient(parts: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk; where the bracket is negative the step ascends on it alone."""
    u, p = np.split(parts, 2)
    gu, gp = u[2:] / u[0], p[2:] / p[0]
    if u[1] / u[0] < prior * p[1] / p[0]:
        return prior * gp - gu
    return gu - 2 * prior * gp


def descend(parts_of, theta: np.ndarray, prior: float, steps: int, rate: float, decay: float = 1e-4) -> np.ndarray:
    """Adam with a falling rate."""
    m = v = 0.0
    for step in range(1, steps + 1):
        g = gradient(parts_of(theta), prior) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        theta = theta - rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The prior from counts of both kinds by score, from low to high; one half where one has none."""
    if not unlabelled.sum() or not positive.sum():
        return 0.5
    u, p = (np.cumsum(x[::-1]) / x.sum() for x in (unlabelled, positive))
    ok = p >= LEAST
    return float(np.clip(np.min(u[ok] / p[ok]), 0.01, 0.99))


def measured(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """A table in the shared folder: ``doc_id, held_out`` and the measures ``x`` of every row."""
    source = documents(docs).withColumn("held_out", fold(F.col("doc_id"), mod) == held)

    def run(batch):
        x = np.array([measures(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, MEASURES, np.int32), x)}

    return materialize(map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<double>"))


def train(rows: DataFrame, labels: DataFrame, start: int = START, steps: int = STEPS, mod: int = 3, held: int = 1) -> Model:
    """Learn from the rows of ``measured`` outside the held-out fold."""
    judged = labels.select("doc_id", F.col("quality").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), mod) != held))
    judged = judged.groupBy("doc_id").agg(F.min("y").alias("y"))
    both = rows.where("NOT held_out").join(judged, "doc_id", "left").where("y IS NULL OR y = 1")
    both = materialize(both.select(F.col("y").isNotNull().alias("positive"), F.xxhash64("doc_id").alias("h"), "x"))
    n = dict(both.groupBy("positive").count().collect())
    none = Model(np.zeros((MEASURES, 1)), np.zeros((MEASURES, 2)), 0.0, 0.5)
    if not n.get(True) or not n.get(False):
        drop(both)
        return none
    marks = both.where("NOT positive").agg(*(F.percentile_approx(F.get("x", F.lit(i)), F.array(*map(F.lit, CUTS)), 10_000) for i in range(MEASURES))).first()
    model = Model(np.array(list(marks)), none.weights, 0.0, 0.5)
    width = len(CUTS) + 1

    def binned(batch):
        x = np.array(batch.column("x").flatten()).reshape(-1, MEASURES)
        return {"positive": batch.column("positive"), "h": batch.column("h"), "b": [r.tobytes() for r in model.bins(x).astype(np.uint8)]}

    table = materialize(map_arrow(both, binned, "positive boolean, h long, b binary"))
    size = MEASURES * width + 1

    def read(batch):
        b = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(-1, MEASURES)
        return b, batch.column("positive").to_numpy(zero_copy_only=False).astype(bool), batch.column("h").to_numpy() & 1 == 0

    def total(of, length: int) -> np.ndarray:
        """Sums of vectors that ``of`` makes of batches, a vector a task."""

        def run(batches):
            out = sum((of(*read(b)) for b in batches if b.num_rows), np.zeros(length))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length), pa.int32()), pa.array(out, pa.float64())], ["i", "v"])

        found = table.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(length)
        out[[r["i"] for r in found]] = [r["v"] for r in found]
        return out

    some = [table.where("positive" if y else "NOT positive").orderBy("h", "b").limit(start).select("b", "h").collect() for y in (True, False)]
    bins = np.array([np.frombuffer(r["b"], np.uint8) for part in some for r in part])
    kind = np.arange(len(bins)) < len(some[0])
    even = np.array([r["h"] & 1 == 0 for part in some for r in part])
    if not (kind & even).any() or not (~kind & even).any():
        even[:] = True
    # Rows with an even hash order the texts, and those with an odd one are counted, so no row is counted by a fit that knows it.
    first = descend(lambda t: sums(t, bins[even], kind[even]), np.zeros(size), 0.5, 150, 0.1)

    def cells(b, positive, known):
        b, positive = b[~known], positive[~known]
        at = (_sigmoid(first[b.astype(np.int64) + np.arange(MEASURES) * width].sum(1) + first[-1]) * (CELLS - 1)).astype(np.int64)
        return np.concatenate([np.bincount(at[~positive], minlength=CELLS), np.bincount(at[positive], minlength=CELLS)]).astype(float)

    count = total(cells, 2 * CELLS)
    prior = prior_of(count[:CELLS], count[CELLS:])
    theta = descend(lambda t: sums(t, bins, kind), first, prior, 300, 0.05)
    theta = descend(lambda t: total(lambda b, p, _: sums(t, b, p), 2 * size + 4), theta, prior, steps, 0.02)
    drop(both, table)
    return Model(model.edges, theta[:-1].reshape(MEASURES, width), float(theta[-1]), prior)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``measured``."""

    def run(batch):
        x = np.array(batch.column("x").flatten()).reshape(-1, MEASURES)
        s = model.score(x) if len(x) else np.zeros(0)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= 0.5).astype("int32")}

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
