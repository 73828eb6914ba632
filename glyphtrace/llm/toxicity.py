"""Toxicity by a linear-chain conditional random field over tokens.

Two tags, clean and toxic. Training tokens are labelled from labelled documents: a token of a toxic
document is toxic if its form, or the start of it, occurs far more often in toxic than in clean
training documents. Emissions and transitions are fitted by exact forward-backward gradients; chains are
sentences of any length. A document's score is a logistic function of its
marginals (the two largest, their sum, and the sum of those near 1); offsets of tokens with a marginal over one half are reported.

Long chains are swept in blocks of ``BLOCK`` tokens: a block's effect on what comes into it is a product of
2 x 2 matrices, so blocks are swept side by side and joined by their matrices; results are those of one sweep.

Training takes a bounded sample of labelled rows: ``MOST`` rows of each label, by a hash of the id, of ``BUDGET`` code
points together (whole texts; the row that goes beyond ends the sample). Scoring reads whole texts.

Cases: null and empty texts have no tokens and get the score of no evidence; without rows of both
labels all scores are 0; equal texts, equal scores; rows without a label teach nothing; an id with both labels counts
as toxic; all rows of a repeated id are taken; texts of any length are read whole; columns that are not named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, leave_to, map_arrow, slices

MOST, BUDGET, BLOCK, TABLE = 2_000, 4_000_000, 64, 1 << 18
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¡¿"
CACHE = 1 << 18


def form(token: str) -> str:
    return token.lower().strip(EDGE)


def parts(word: str) -> list[str]:
    """What a token is known by: its form and its starts."""
    return ["w:" + word, *(f"{k}:{word[:k]}" for k in (3, 4, 5) if len(word) > k)]


def slots(word: str) -> list[int]:
    return [zlib.crc32(p.encode()) % TABLE for p in parts(word)] if word else []


class Field:
    """Emission of the toxic tag over the clean one, transitions, and the document's logistic weights."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, document: np.ndarray | None):
        self.weights, self.bias, self.moves, self.document = weights, bias, moves, document
        self.known: dict[str, tuple[float, bool]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def look(self, token: str) -> tuple[float, bool]:
        if (found := self.known.get(token)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = (float(self.weights[slots(form(token))].sum() + self.bias), token[-1] in ".!?")
            if len(token) <= 64:
                self.known[token] = found
        return found

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Probability of the toxic tag for each token of each text."""
        tokens = [t.split() for t in texts]
        sizes = [len(t) for t in tokens]
        if not sum(sizes):
            return [np.zeros(0) for _ in texts]
        look, known = self.look, self.known
        pairs = [known.get(w) or look(w) for t in tokens for w in t]
        emit, ends = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        p, _ = chains(emit, starts(ends, np.array(sizes)), self.moves)
        return np.split(p, np.cumsum(sizes)[:-1])

    def measure(self, p: np.ndarray) -> np.ndarray:
        if not p.size:
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        top = np.r_[np.sort(p)[-2:][::-1], 0.0]
        return np.array([1.0, top[0], top[1] if p.size > 1 else 0.0, np.log1p(p.sum()), np.log1p(p[p > 0.9].sum())])

    def score(self, ps: list[np.ndarray]) -> np.ndarray:
        if self.document is None:
            return np.zeros(len(ps))
        z = np.array([self.measure(p) for p in ps]).reshape(-1, 5) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def starts(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which tokens begin a chain: those of a text's start and those after a sentence's end."""
    first = np.zeros(ends.size, bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first[1:] |= ends[:-1]
    return first


def _step(x, m):
    """Log-odds of toxic carried across a transition: messages between two tags need one number each."""
    return np.logaddexp(m[0, 1], x + m[1, 1]) - np.logaddexp(m[0, 0], x + m[1, 0])


def forward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds of toxic at each token given the tokens of its chain up to it."""
    n = emit.size
    begin = np.flatnonzero(first)
    place = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
    start = np.flatnonzero(place % BLOCK == 0)
    length = np.diff(np.r_[start, n])
    number = place[start] // BLOCK  # of a block in its chain
    comes = np.zeros(start.size)
    if number.any():
        comes = _incoming(emit, start, number, moves)
    out = np.empty(n)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < order.size:  # blocks of like length together, as a rectangle of places x blocks
        to = int(np.searchsorted(length[order], length[order[at]] * 1.25 + 4, "right"))
        which = order[at:to]
        rows = np.arange(length[which].max())[:, None]
        real = rows < length[which]
        where = np.where(real, start[which] + rows, 0)
        x = emit[where]
        x[0] += np.where(number[which] > 0, _step(comes[which], moves), 0.0)
        for i in range(1, len(x)):
            x[i] += _step(x[i - 1], moves)
        out[where[real]] = x[real]
        at = to
    return out


def _incoming(emit: np.ndarray, start: np.ndarray, number: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For each block of a chain of several, the log-odds at the token before it."""
    feeds = np.flatnonzero(np.r_[number[1:] > 0, False])  # blocks that another follows; they are full
    e = emit[start[feeds] + np.arange(BLOCK)[:, None]]
    # Odds o become (A o + B) / (C o + D): logarithms of the matrix's four numbers.
    a, b, c, d = (np.full(feeds.size, v) for v in (0.0, -np.inf, -np.inf, 0.0))
    for i in range(BLOCK):
        a, c = e[i] + np.logaddexp(moves[1, 1] + a, moves[0, 1] + c), np.logaddexp(moves[1, 0] + a, moves[0, 0] + c)
        b, d = e[i] + np.logaddexp(moves[1, 1] + b, moves[0, 1] + d), np.logaddexp(moves[1, 0] + b, moves[0, 0] + d)
    head = number[feeds] == 0
    x = e[0].copy()
    for i in range(1, BLOCK):
        x = e[i] + _step(x, moves)
    comes = np.zeros(start.size)
    comes[feeds[head] + 1] = x[head]
    by = np.argsort(number[feeds], kind="stable")
    cuts = np.searchsorted(number[feeds][by], np.arange(1, number.max() + 1))
    for lo, hi in zip(cuts, np.r_[cuts[1:], by.size]):  # the k-th blocks of all chains
        k = by[lo:hi]
        x = comes[feeds[k]]
        comes[feeds[k] + 1] = np.logaddexp(a[k] + x, b[k]) - np.logaddexp(c[k] + x, d[k])
    return comes


def chains(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and the log-odds ahead. The backward sweep is a forward one over reversed chains."""
    ahead = forward(emit, first, moves)
    last = np.r_[first[1:], True]
    back = forward(emit[::-1], last[::-1], moves.T)[::-1] - emit
    return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60))), ahead


def moved_pairs(first: np.ndarray, moves: np.ndarray, p: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Expected number of each move between two tags, summed over all chains.

    The log-odds ahead of a token and the marginal after it give the odds of both tags of a pair.
    """
    out = np.zeros((2, 2))
    inner = ~first[1:]
    x, q = ahead[:-1][inner], p[1:][inner]
    for b, share in ((0, 1 - q), (1, q)):  # the tag before, given the next
        before = 1 / (1 + np.exp(-np.clip(x + moves[1, b] - moves[0, b], -60, 60)))
        out[1, b] = (share * before).sum()
        out[0, b] = (share * (1 - before)).sum()
    return out


def token_labels(texts: list[str], toxic: np.ndarray, least: int = 4, odds: float = 2.5) -> set[str]:
    """Parts of tokens that mark toxic documents."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        seen[int(y)].update({p for w in set(text.split()) for p in parts(form(w))})
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    return {p for p, c in seen[1].items() if c >= least and p != "w:" and np.log((c + 0.5) / n1) - np.log((seen[0][p] + 0.5) / n0) >= odds}


def fit(texts: list[str], toxic: np.ndarray, share: float, steps: int = 60, rate: float = 0.15, decay: float = 1e-6) -> Field:
    """Adam on the token likelihood, then logistic weights of documents; ``share``: toxic part of the labelled rows."""
    field = Field(np.zeros(TABLE, np.float32), -3.0, np.zeros((2, 2)), None)
    if toxic.sum() == 0 or toxic.sum() == len(toxic):
        return field
    marks = token_labels(texts, toxic)
    kinds: dict[str, int] = {}
    each_text = [np.array([kinds.setdefault(w, len(kinds)) for w in t.split()], np.int32) for t in texts]
    sizes, kind = np.array([len(k) for k in each_text]), np.concatenate(each_text)
    marked = np.array([bool(marks.intersection(parts(form(w)))) for w in kinds], bool)
    tag = marked[kind] & np.repeat(toxic.astype(bool), sizes)
    ends = np.array([w[-1] in ".!?" for w in kinds], bool)[kind]
    each = [slots(form(w)) for w in kinds]
    owner, slot = np.repeat(np.arange(len(each)), [len(s) for s in each]), np.array([s for x in each for s in x], np.int64)
    used, slot = np.unique(slot, return_inverse=True)
    first = starts(ends, sizes)
    inner = np.flatnonzero(~first[1:])
    observed = np.bincount(tag[inner] * 2 + tag[inner + 1], minlength=4).reshape(2, 2).astype(float)
    w, bias, m, v = np.zeros(used.size), -3.0, 0.0, 0.0
    moves = np.log((observed + 1) / (observed + 1).sum(1, keepdims=True))  # where transitions start
    for step in range(1, steps + 1):
        emit = (np.bincount(owner, w[slot], len(each)) + bias)[kind]
        p, ahead = chains(emit, first, moves)
        by_kind = np.bincount(kind, p - tag, len(each))
        pairs = moved_pairs(first, moves, p, ahead) - observed
        grad = np.r_[np.bincount(slot, by_kind[owner], used.size), by_kind.sum(), pairs.ravel()] / max(tag.sum(), 1)
        grad[: used.size] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias, moves = w - change[: used.size], bias - change[used.size], moves - change[used.size + 1 :].reshape(2, 2)
    field.weights[used], field.bias, field.moves = w, bias, moves
    p, _ = chains((np.bincount(owner, w[slot], len(each)) + bias)[kind], first, moves)
    x = np.array([field.measure(q) for q in np.split(p, np.cumsum(sizes)[:-1])])
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    theta = np.zeros(5)
    for _ in range(50):  # Newton steps
        s = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * s * (1 - s))[:, None]).T @ x / len(x) + np.eye(5) * 1e-4
        theta = theta - np.clip(np.linalg.solve(hess, x.T @ (weight * (s - toxic)) / len(x) + 1e-4 * theta), -2, 2)
    field.document = theta
    return field


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, budget: int = BUDGET, mod: int = 3, held: int = 1) -> Field:
    """Learn from labelled rows outside the held-out fold."""
    own = documents(docs).where(fold(F.col("doc_id"), mod) != held).withColumn("h", F.xxhash64("text"))
    judged = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id"), mod) != held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = judged.agg(F.avg("y")).first()[0]
    order = (F.xxhash64("doc_id"), "doc_id", "h")
    ids = [F.broadcast(judged.where(F.col("y") == y).orderBy(*order[:2]).limit(2 * most)) for y in (0, 1)]
    texts, tags = [], []
    for y in (0, 1):
        found = own.join(ids[y], "doc_id", "left_semi")
        sizes = found.select("doc_id", "h", F.length("text").alias("n")).orderBy(*order).limit(most).collect()  # numbers only
        upto = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), budget, "right")) + 1
        if not sizes:
            continue
        taken = docs.sparkSession.createDataFrame([(r["doc_id"], r["h"]) for r in sizes[:upto]], own.select("doc_id", "h").schema).distinct()
        rows = own.join(F.broadcast(taken), ["doc_id", "h"], "left_semi").orderBy(*order).limit(upto).collect()
        texts += [r["text"] for r in rows]
        tags += [y] * len(rows)
    return fit(texts, np.array(tags, np.float64), share or 0.0)


def score_documents(docs: DataFrame, field: Field, mod: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, offsets``: spans (code points) of tokens more likely toxic than not."""

    def run(batch):
        texts = batch.column("text").to_pylist()
        ps = field.marginals(texts)
        s = field.score(ps)
        spans = []
        for text, p in zip(texts, ps):
            bad = set(np.flatnonzero(p > 0.5).tolist()) if p.size else ()
            at = [m.span() for i, m in enumerate(re.finditer(r"\S+", text)) if i in bad] if bad else []
            spans.append([{"start": a, "end": b} for a, b in at])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= threshold).astype("int32"), "offsets": spans}

    source = documents(docs).withColumn("held_out", fold(F.col("doc_id"), mod) == held)
    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, offsets array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, field: Field, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they are."""

    def run(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch, 128):
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(field.score(field.marginals(texts)) < threshold, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
