"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of ``least`` or more: none is missed.

Of two such sets, each of n shingles or more, the first n - ceil(least n) + 1 shingles in any one order of all
shingles have one in common (prefix filter). The order is by hash, with shingles known to be frequent at the end; a bitmap that is
learnt from every ``EACH``-th text tells them. It decides what the join costs, never what it finds: any order is right.

Texts that meet under a shingle are compared by signatures: a shingle flips one of 512 bits, so two signatures differ in no
more bits than the sets in shingles, and what differs in too many cannot be similar. What may be similar is
linked to a spanning forest, and the links are then verified. Where all links of a group hold, every similar pair of the group is connected
by them; in a group with a link that does not hold, all pairs between classes that are still apart are verified.

Cases: texts without words are similar to one another and to no others; texts under five words have one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, leave_to, materialize, may_be_in, sieve, slices

WORDS, BITS = 5, 512
#: Texts of which one is looked at for frequent shingles, and how often one is found there to count as frequent.
EACH, FREQUENT = 32, 8
#: Bits by which shingles are counted: fewer bytes move, and a chance meeting only lets a shingle through that no other text has.
COUNTED = (1 << 40) - 1
#: Members of a shingle's group that one task compares; larger groups go to pairs of blocks.
GROUP = 20_000


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Different 64-bit hashes of all runs of ``words`` words, of the whole text where it is shorter; none of no words."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    m = max(n - words + 1, 1)
    x = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(n, words)):
        x = (x ^ h[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
    return np.unique((x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def prefix(s: np.ndarray, frequent: Callable[[np.ndarray], np.ndarray], least: float) -> np.ndarray:
    """Shingles under which a set meets all that are similar; 0 stands for a set without any."""
    if not s.size:
        return np.zeros(1, np.int64)
    last = frequent(s)
    return np.concatenate([s[~last], s[last]])[: s.size - math.ceil(least * s.size - 1e-9) + 1]


def signature(s: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles flips."""
    odd = np.bincount((s >> 20) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be(sign: np.ndarray, n: np.ndarray, i: int, of: np.ndarray, least: float) -> np.ndarray:
    """Which of the members ``of`` can be similar to member ``i``: false only where they are not."""
    apart = np.bitwise_count(sign[of] ^ sign[i]).sum(1, dtype=np.int64)
    return (apart <= (n[of] + n[i]) * ((1 - least) / (1 + least)) + 1e-6) & (np.minimum(n[of], n[i]) >= least * np.maximum(n[of], n[i]) - 1e-6)


def spanning(sign: np.ndarray, n: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect what may be similar, by breadth-first search over what is left."""
    out, left = [], np.arange(n.size)
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        while reached and left.size:
            at = reached.pop()
            near = may_be(sign, n, at, left, least)
            if near.any():
                found = left[near]
                out += [(at, q) for q in found]
                reached += list(found)
                left = left[~near]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches sorted by their first column, cut anew so that no group is in two: columns, and starts of groups."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols)]
        key = cols[0]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held = [c[start[-1] :] for c in cols]
        if start.size > 1:
            yield *(c[: start[-1]] for c in cols), start[:-1]
    if held is not None:
        yield *held, np.zeros(1, np.int64)


def _pack(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], ["k", "a", "b"][-len(cols) :])


def _forests(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """``k, a, b``: links of each group; 0 for ``k`` where the group has no other pair."""
    for k, tid, n, sign, start in _groups(batches):
        size = np.diff(np.r_[start, k.size])
        a = start[size == 2]
        apart = np.bitwise_count(sign[a] ^ sign[a + 1]).sum(1, dtype=np.int64)
        a = a[apart <= (n[a] + n[a + 1]) * ((1 - least) / (1 + least)) + 1e-6]
        x, y = np.unique(np.stack([tid[a], tid[a + 1]]), axis=1)
        if x.size:
            yield _pack(np.zeros(x.size), np.minimum(x, y), np.maximum(x, y))
        keys, ends = [], []
        for at, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            for i, j in spanning(sign[at : at + m], n[at : at + m], least):
                keys.append(k[at])
                ends.append((tid[at + i], tid[at + j]))
        if keys:
            x, y = np.array(ends, np.int64).T
            yield _pack(np.array(keys, np.int64), np.minimum(x, y), np.maximum(x, y))


def _across(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """``a, b``: all pairs of each group that may be similar and are of two classes."""
    for _, tid, n, sign, root, start in _groups(batches):
        for at, m in zip(start.tolist(), np.diff(np.r_[start, tid.size]).tolist()):
            for i in range(at, at + m - 1):
                of = np.arange(i + 1, at + m)
                of = of[root[of] != root[i]]
                of = of[may_be(sign, n, i, of, least)]
                if of.size:
                    yield _pack(np.minimum(tid[of], tid[i]), np.maximum(tid[of], tid[i]))


def wide(s: np.ndarray) -> np.ndarray:
    """A signature of four bits or more a shingle; of two widths, the wider one folds to the other."""
    size = max(BITS, 1 << (4 * s.size).bit_length())
    odd = np.bincount((s >> 8) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _nearer(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` of which the wide signatures do not show that they are not similar."""
    for batch in batches:
        a, b, nx, ny = (batch.column(i).to_numpy() for i in range(4))
        most, ok = (nx + ny) * ((1 - least) / (1 + least)) + 1e-6, np.zeros(a.size, bool)
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            ok[i] = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, x.size))).sum(dtype=np.int64)) <= most[i]
        yield _pack(a[ok], b[ok])


def verified(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets themselves are similar. Sets move only for pairs that wide signatures let through."""
    may = sieve(pairs.select(F.explode(F.array("a", "b")).alias("tid")))

    def signs(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch.filter(pa.array(may(batch.column("tid").to_numpy())))):
                each = [shingle_set(t) for t in part.column("text").to_pylist()]
                cols = pa.array([s.size for s in each], pa.int64()), pa.array([wide(s).tobytes() for s in each], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("tid"), *cols], ["tid", "n", "w"])

    held = materialize(texts.mapInArrow(signs, "tid long, n long, w binary"))
    both = pairs.join(held.toDF("a", "nx", "x"), "a").join(held.toDF("b", "ny", "y"), "b").select("a", "b", "nx", "ny", "x", "y")
    near = materialize(both.mapInArrow(lambda it: _nearer(it, least), "a long, b long"))
    drop(held)
    still = sieve(near.select(F.explode(F.array("a", "b")).alias("tid")))

    def sets(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch.filter(pa.array(still(batch.column("tid").to_numpy())))):
                yield pa.RecordBatch.from_arrays([part.column("tid"), pa.array([shingle_set(t) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))], ["tid", "s"])

    held = materialize(texts.mapInArrow(sets, "tid long, s array<long>"))
    both = near.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    good = materialize(both.where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    drop(held, near)
    return good


def once(texts: DataFrame, many: DataFrame) -> DataFrame:
    """Each of ``tid, text`` once; only those in the one column of ``many`` are shuffled."""
    told = may_be_in(texts, "tid", many, "told")
    return told.where("NOT told").select("tid", "text").unionByName(told.where("told").groupBy("tid").agg(F.first("text").alias("text")))


def links(texts: DataFrame, many: DataFrame, first: DataFrame, components: Callable[[DataFrame], DataFrame], least: float, group: int = GROUP) -> DataFrame:
    """Links ``a < b`` that connect all pairs of ``tid, text`` with a similarity of ``least`` or more, and no others.

    ``many``: the ids of texts that stand more than once. ``first``: candidates ``a < b`` found otherwise.
    """

    def every(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch):
                each = [shingle_set(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each))], ["h"])

    sample = texts.where(F.pmod("tid", F.lit(EACH)) == 0).mapInArrow(every, "h long")
    frequent = sieve(sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("h"))

    def heads(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch):
                each = [prefix(shingle_set(t), frequent, least) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each) & COUNTED)], ["x"])

    single = once(texts, many)
    met = materialize(single.mapInArrow(heads, "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1"))
    shared = sieve(met.select("x"), min(max(1 << 20, 1 << (8 * met.count()).bit_length()), 1 << 27))

    def entries(batches):
        leave_to(__name__)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for tid, text in zip(part.column("tid").to_pylist(), part.column("text").to_pylist()):
                    s = shingle_set(text)
                    h = prefix(s, frequent, least)
                    h = h[shared(h & COUNTED)]
                    if h.size:
                        rows.append((h, tid, s.size, signature(s)))
                if rows:
                    h, tid, n, sign = zip(*rows)
                    kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h, tid, n, sign), kinds)], ["h", "tid", "n", "sign"])

    index = materialize(single.mapInArrow(entries, "h array<long>, tid long, n long, sign array<long>"))
    rows = index.select(F.explode("h").alias("h"), "tid", "n", "sign")
    large = met.where(F.col("n") > group).select("x", (F.col("n") * 4 / group + 1).cast("long").alias("m"))
    if large.limit(1).count():  # blocks of half a group at most, every pair of blocks under a key of its own
        told = rows.withColumn("x", F.col("h").bitwiseAND(F.lit(COUNTED))).join(F.broadcast(large), "x", "left").withColumn("i", F.pmod(F.xxhash64("tid"), F.coalesce("m", F.lit(1))))
        told = told.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(1)) - 1)))
        rows = told.withColumn("h", F.when(F.col("m").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j"))))
    keyed = rows.select(F.col("h").alias("k"), "tid", "n", "sign")
    found = materialize(keyed.repartition("k").sortWithinPartitions("k", "tid").mapInArrow(lambda it: _forests(it, least), "k long, a long, b long"))
    pairs = materialize(found.select("a", "b").unionByName(first).distinct())
    good = verified(single, pairs, least)
    open_ = materialize(found.where("k <> 0").join(pairs.join(good, ["a", "b"], "left_anti"), ["a", "b"], "left_semi").select("k").distinct())
    if open_.limit(1).count():
        roots = components(good)
        apart = keyed.join(open_, "k", "left_semi").join(roots, F.col("tid") == F.col("node"), "left").select("k", "tid", "n", "sign", F.coalesce("root", "tid").alias("root"))
        more = apart.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: _across(it, least), "a long, b long").distinct()
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
        good = materialize(good.unionByName(verified(single, more, least)))
        drop(more)
    drop(met, index, found, pairs, open_)
    return good
