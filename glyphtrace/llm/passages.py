"""Substring dedup with compact windows.

Words are runs of anything but the six ASCII spaces, A-Z folded; tokens are shingles of ``SHINGLE``
words. Under one hash function a Cartesian tree over a text's token hashes groups all its subsequences
by their smallest hash: the window ``(l, c, r)`` stands for every subsequence that holds ``c`` and lies in
``[l, r]``. Only windows that hold at least ``LEAST`` words are kept, about ``2 n / LEAST`` of them.

Windows of an equal smallest token are joined by intervals: every passage of ``TOKENS`` tokens around ``c`` holds one
of ``SLOTS`` intervals of ``COMMON`` tokens that stand at fixed distances from ``c``, and two windows meet where such an
interval has one smallest hash under another function too. So a candidate agrees in two functions over one and the same
interval. Candidates are compared shingle by shingle; passages of at least ``LEAST`` words whose shingle sets have a
Jaccard similarity of ``SIMILAR`` or more are repeats.

What meets in one class (token, interval, second hash) is linked to one of its windows, so links grow with the windows
and never with their pairs. Windows that are not similar to that one are dealt anew, into classes of whole passages of
``TOKENS`` tokens (equal hash of all, or equal smallest hashes under three functions) that hold ``c``. Any exact repeat
of ``LEAST`` words is thus linked, directly or by others that hold it; similar passages are missed where the functions
do not meet (by test, under 3 % at a similarity of 0.8 to 0.85). Equal windows of one task are linked there and
only the first of them is sent, so a passage that a third of all texts share sends one row a task.

Cases: null and empty texts and texts under ``LEAST`` words have no passages; a repeat inside one text
does not count; rows of equal text are copies of each other even if their ids are equal, and are known by a
64-bit hash (some three chance meetings among 10^10 different texts); null ids are kept; texts of any length are read
whole, a window's reach of over 127 tokens to either side is cut, since longer passages hold more windows; without
repeats the result is empty; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, drop, join_spread, materialize, sieve, slices
from .simhash import components

SHINGLE, LEAST, HASHES, SIMILAR = 5, 50, 4, 0.8
#: Tokens of the shortest passage, intervals around a window's smallest token, their distance, and their tokens.
TOKENS, SLOTS, STEP = LEAST - SHINGLE + 1, 5, 9
COMMON = TOKENS - STEP
#: Bits of a window's reach to either side, and of a slot's second hash; 0 stands for an interval beyond the text.
REACH, SIGN = 7, 21


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of all shingles of a text."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in text.encode().lower().split()], np.uint64)
    n = words.size - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(out, 0)


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, least: int, twice: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Compact windows of at least ``least`` tokens. Of equal smallest hashes the one nearest the middle is the
    root, so runs of one token give a balanced tree; ``twice`` marks tokens that stand more than once."""
    out, todo = [], [(0, h.size - 1)]
    while todo:
        l, r = todo.pop()
        if r - l + 1 < least:
            continue
        part = h[l : r + 1]
        c = int(part.argmin())
        if twice is not None and twice[l + c]:
            same = np.flatnonzero(part == part[c])
            c = int(same[np.abs(same - (r - l) / 2).argmin()])
        c += l
        out.append((l, c, r))
        if c - l >= least:
            todo.append((l, c - 1))
        if r - c >= least:
            todo.append((c + 1, r))
    return out


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` numbers in a row."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return np.minimum(h[: h.size - rest], h[rest:]) if rest else h


def rolled(s: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` numbers in a row, from hashes of powers of two of them."""
    out, at, size = None, 0, 1
    while size <= width:
        if width & size:
            out = s if out is None else mixed(out[: s.size - at], 7) + s[at:]
            at += size
        s = mixed(s[:-size], 8) + s[size:] if s.size > size else s[:0]
        size *= 2
    return mixed(out, 9)


def signs(h: np.ndarray) -> np.ndarray:
    """For each place the second hash, in ``SIGN`` bits, of the interval that starts there, after ``STEP * (SLOTS - 1)``
    zeros and before as many as places ask for."""
    low = lowest(h, COMMON)
    out = np.zeros(h.size + STEP * (SLOTS - 1), np.int64)
    out[STEP * (SLOTS - 1) : STEP * (SLOTS - 1) + low.size] = np.maximum((low >> np.uint64(64 - SIGN)).view(np.int64), 1)
    return out


WINDOWS = "key long, tid long, at long, s1 long, s2 long, b long, ab long"


def _emit(batch: pa.RecordBatch, least: int, hashes: int) -> pa.RecordBatch:
    """Windows of a batch; of windows alike in everything but the text the first, the others as links to it (``b, ab``)."""
    parts, reach, seen = [], (1 << REACH) - 1, set()
    for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist()):
        if tid in seen:
            continue
        seen.add(tid)
        s = shingles(text)
        if s.size < least:
            continue
        _, back, count = np.unique(s, return_inverse=True, return_counts=True)
        twice = count[back] > 1 if count.size < s.size else None
        each = [mixed(s, k + 1) for k in range(hashes)]
        second = [signs(h) for h in each]
        for k, h in enumerate(each):
            w = np.array(windows(h, least, twice), np.int64)
            c = w[:, 1]
            v = [second[(k + 1) % hashes][c + STEP * (SLOTS - 1 - i)] for i in range(SLOTS)]
            at = c << 2 * REACH | np.minimum(c - w[:, 0], reach) << REACH | np.minimum(w[:, 2] - c, reach)
            parts.append((h[c].view(np.int64) & ~7 | k, np.full(c.size, tid), at, v[0] | v[1] << SIGN | v[2] << 2 * SIGN, v[3] | v[4] << SIGN))
    key, tid, at, s1, s2 = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 5))
    order = np.lexsort((tid, s2, s1, key))
    key, tid, at, s1, s2 = (x[order] for x in (key, tid, at, s1, s2))
    new = np.r_[True, (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])] if key.size else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if key.size else np.zeros(0, np.int64)
    linked = tid != tid[first]
    none = ~linked
    b, ab = (pa.array(np.where(linked, x, 0), pa.int64(), mask=none) for x in (tid, at))
    own = [np.where(linked, x[first], x) for x in (tid, at)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, *own, s1, s2)), b, ab], [x.split()[0] for x in WINDOWS.split(", ")])


LINKS = "a long, b long, aa long, ab long, key long, s1 long, s2 long, mask long"


def _links(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in LINKS.split(", ")])


def _sign(s1: np.ndarray, s2: np.ndarray, slot: int) -> np.ndarray:
    return (s1 >> SIGN * slot if slot < 3 else s2 >> SIGN * (slot - 3)) & (1 << SIGN) - 1


def _stars(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Links of each window to the one of the smallest text in each of its classes (the next text's for those of that text),
    with the slots in which they meet; and the windows that others are linked to. ``rows`` are in order of the key."""
    key, tid, at, s1, s2 = rows
    n, codes, bits, heads = key.size, [], [], []
    for slot in range(SLOTS):
        v = _sign(s1, s2, slot)
        some = np.flatnonzero(v)
        if not some.size:
            continue
        i = some[np.lexsort((tid[some], v[some], key[some]))]
        new = np.r_[True, (key[i[1:]] != key[i[:-1]]) | (v[i[1:]] != v[i[:-1]])]
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        place = np.arange(i.size)
        other = np.minimum.reduceat(np.where(tid[i] != tid[i[start]][run], place, i.size), start)
        second = other[run]
        own = tid[i] == tid[i[start]][run]
        to = np.where(own, second, start[run])
        ok = (to < i.size) & (to != place) & ~(own & (place == start[run]))
        codes.append(i[to[ok]] * n + i[ok])
        bits.append(np.full(int(ok.sum()), 1 << slot))
        heads += [i[start], i[other[other < i.size]]]
    if not codes:
        return [np.zeros(0, np.int64)] * 8, np.zeros(0, np.int64)
    code, bit = np.concatenate(codes), np.concatenate(bits)
    order = np.argsort(code, kind="stable")
    code, bit = code[order], bit[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if code.size else np.zeros(0, np.int64)
    mask = np.bitwise_or.reduceat(bit, new) if code.size else bit
    a, b = code[new] // n, code[new] % n
    return [tid[a], tid[b], at[a], at[b], key[b], s1[b], s2[b], mask], np.unique(np.concatenate(heads))


def _meet(batches):
    """From windows in order of ``key``: links inside each class. Of a key that goes on only the windows that others are
    linked to are held, no more than a bounded number of second hashes for each slot."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        made = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if made.any():
            key, tid, at, s1, s2 = (x[made] for x in cols)
            yield _links([tid, batch.column("b").drop_null().to_numpy(), at, batch.column("ab").drop_null().to_numpy(), key, s1, s2, np.full(key.size, (1 << SLOTS) - 1)])
        rows = [x[~made] for x in cols]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not rows[0].size:
            continue
        links, heads = _stars(rows)
        if links[0].size:
            yield _links(links)
        heads = heads[rows[0][heads] == rows[0][-1]]
        held = [x[heads] for x in rows]


def _around(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For windows whose link was not similar: classes of whole passages that hold the smallest token."""
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    for tid, text, places in zip(batch.column("tid").to_numpy(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
        s = shingles(text)
        low = [lowest(mixed(s, k + 1), TOKENS) for k in range(3)]
        kinds = rolled(s, TOKENS), mixed(low[0], 11) + mixed(low[1], 12) + mixed(low[2], 13)
        for at in places:
            c = at >> 2 * REACH
            l, r = c - (at >> REACH & (1 << REACH) - 1), c + (at & (1 << REACH) - 1)
            i = np.arange(max(c - TOKENS + 1, l), min(c, r - TOKENS + 1) + 1)
            for kind in kinds:
                for col, x in zip(out, (mixed(kind[i], 14).view(np.int64), np.full(i.size, tid), np.full(i.size, at))):
                    col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["cls", "tid", "at"])


#: How far a passage's two places may drift apart inside it, in tokens.
DRIFT = 64


def _places(v: np.ndarray, order: np.ndarray, want: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Of the places in ``y`` of the values ``v`` those nearest to ``want``; ``code`` are value and place, in order."""
    k = np.searchsorted(code, v * n + np.clip(want, 0, n - 1))
    low, high = np.maximum(k - 1, 0), np.minimum(k, code.size - 1)
    off = [np.where(code[c] // n == v, np.abs(order[c] - want), 1 << 40) for c in (low, high)]
    return np.where(off[0] <= off[1], order[low], order[high])


def shared(x: np.ndarray, y: np.ndarray, least: int = TOKENS, similar: float = SIMILAR) -> list[tuple[int, int, int, int]]:
    """Intervals of ``x`` and of ``y`` (ends included) of at least ``least`` tokens each whose sets are similar enough.

    Equal tokens are gathered along diagonals that drift by no more than ``DRIFT``. Between the u-th and the w-th equal
    token of a diagonal the similarity is enough where ``(1 + 1 / similar) k - i - p`` of the w-th (its number, and its
    places in both) is not below that of the u-th, so running maxima give the farthest w for each u.
    """
    need, g, n = int(np.ceil(2 * similar * least / (1 + similar) - 1e-9)), 1 + 1 / similar, y.size
    values, vy = np.unique(y, return_inverse=True)
    at = np.minimum(np.searchsorted(values, x), max(values.size - 1, 0))
    i = np.flatnonzero(values[at] == x) if n else np.zeros(0, np.int64)
    if i.size < need:
        return []
    v, order = at[i], np.argsort(vy, kind="stable")
    code = vy[order].astype(np.int64) * n + order
    by = np.argsort(v, kind="stable")  # the k-th of equal tokens in x first goes with the k-th in y
    new = np.r_[True, v[by][1:] != v[by][:-1]]
    rank = np.empty(i.size, np.int64)
    rank[by] = np.arange(i.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.searchsorted(vy[order], np.arange(values.size))
    count = np.diff(np.r_[first, n])
    d = order[first[v] + np.minimum(rank, count[v] - 1)] - i
    along = np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[along]) > DRIFT) + 1
    out: list[tuple[int, int, int, int]] = []
    for part in np.split(along, cuts):
        if part.size * 2 < need:  # half of a passage's tokens at least stand once, or as often as in the other
            continue
        part = np.sort(part)
        want = i + np.rint(np.interp(i, i[part], d[part])).astype(np.int64)
        p = _places(v, order, want, code, n)
        near = np.abs(p - want) <= DRIFT
        a, b = i[near], p[near]
        if a.size < need:
            continue
        f = g * np.arange(a.size) - a - b
        top = np.maximum.accumulate(f[::-1])  # from the right
        far = a.size - 1 - np.searchsorted(top, f + 2 - g - 1e-9)
        u = np.flatnonzero(far - np.arange(a.size) + 1 >= need)
        w = far[u]
        longer = w > np.r_[-1, np.maximum.accumulate(w)[:-1]] if u.size else np.zeros(0, bool)
        u, w = u[longer], w[longer]
        k = 0
        while k < u.size:  # intervals that cover all that any covers
            fit = _fit(x, y, int(a[u[k]]), int(a[w[k]]), int(b[u[k] : w[k] + 1].min()), int(b[u[k] : w[k] + 1].max()), least, similar)
            if fit:
                if not any(e <= fit[0] and fit[1] <= h and o <= fit[2] and fit[3] <= q for e, h, o, q in out):
                    out.append(fit)
                k = max(int(np.searchsorted(u, w[k], "right")) - 1, k + 1)
            else:
                k += 1
    return out


def _fit(x, y, i: int, j: int, p: int, q: int, least: int, similar: float) -> tuple[int, int, int, int] | None:
    """The intervals themselves, filled up on either side to ``least`` tokens, where their sets are similar enough."""

    def fill(lo, hi, n):
        return [(s, s + least - 1) for s in range(max(hi - least + 1, 0), min(lo, n - least) + 1)] if hi - lo + 1 < least else [(lo, hi)]

    return next(((a, b, c, d) for a, b in fill(i, j, x.size) for c, d in fill(p, q, y.size) if _alike(x[a : b + 1], y[c : d + 1], similar)), None)


def _alike(x: np.ndarray, y: np.ndarray, similar: float) -> bool:
    u, v = set(x.tolist()), set(y.tolist())
    return len(u & v) >= similar * len(u | v)


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[tuple] = []
    xs, ys = batch.column("xs"), batch.column("ys")
    head = [batch.column(c).to_pylist() for c in ("a", "b", "la", "lb")]
    for n, (a, b, la, lb) in enumerate(zip(*head)):
        for i, j, p, q in shared(xs[n].values.to_numpy(zero_copy_only=False), ys[n].values.to_numpy(zero_copy_only=False)):
            rows.append((a, b, la + i, la + j + SHINGLE, lb + p, lb + q + SHINGLE))
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "sa", "ea", "sb", "eb"])


def _pairs(links: DataFrame) -> DataFrame:
    """Pairs of texts ``a < b``, each with the span of their windows in both."""
    left = lambda at: F.shiftright(at, 2 * REACH) - F.shiftright(at, REACH).bitwiseAND(F.lit((1 << REACH) - 1))
    right = lambda at: F.shiftright(at, 2 * REACH) + at.bitwiseAND(F.lit((1 << REACH) - 1))
    turned = F.col("a") > F.col("b")
    aa, ab = (F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("ab", "aa"), ("aa", "ab")))
    each = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), left(aa).alias("la"), right(aa).alias("ra"), left(ab).alias("lb"), right(ab).alias("rb"))
    return each.groupBy("a", "b").agg(*(f(c).alias(c) for f, c in ((F.min, "la"), (F.max, "ra"), (F.min, "lb"), (F.max, "rb"))))


def _of(texts: DataFrame, tids: DataFrame) -> Callable:
    """Maps Arrow batches of those of ``texts`` that may be among ``tids``."""
    may = sieve(tids)

    def over(fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
        def run(batches):
            for batch in batches:
                some = batch.filter(pa.array(may(batch.column("tid").to_numpy())))
                yield from (fn(p) for p in slices(some, rows))

        return texts.mapInArrow(run, schema)

    return over


def _compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, sa, ea, sb, eb``: verified intervals (ends excluded) of the pairs."""

    def tokens(batch):
        each = [(shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(each, pa.list_(pa.int32()))], ["tid", "s"])

    found = _of(texts, pairs.select(F.explode(F.array("a", "b")).alias("tid")))(tokens, "tid long, s array<int>")
    held = materialize(found.groupBy("tid").agg(F.first("s").alias("s")))
    cut = lambda lo, hi: F.slice("s", (F.col(lo) + 1).cast("int"), (F.col(hi) - F.col(lo) + 1).cast("int"))
    left = pairs.join(held, pairs.a == held.tid).select("a", "b", "la", "lb", "rb", cut("la", "ra").alias("xs"))
    both = left.join(held, left.b == held.tid).select("a", "b", "la", "lb", "xs", cut("lb", "rb").alias("ys"))
    done = materialize(both.mapInArrow(lambda it: (_verify(p) for b in it for p in slices(b)), "a long, b long, sa long, ea long, sb long, eb long"))
    drop(held)
    return done


def _failed(links: DataFrame, found: DataFrame) -> DataFrame:
    """``tid, at, cls``: linked windows that lie in no passage verified with the window they are linked to, by class."""
    sides = found.select("a", "b", F.col("sb").alias("s"), F.col("eb").alias("e")).unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("sa").alias("s"), F.col("ea").alias("e")))
    l, f, c = links.alias("l"), sides.alias("f"), F.shiftright("l.ab", 2 * REACH)
    bad = l.join(f, (F.col("l.a") == F.col("f.a")) & (F.col("l.b") == F.col("f.b")) & (c >= F.col("f.s")) & (c + SHINGLE <= F.col("f.e")), "left_anti")
    sign = lambda i: F.shiftright(F.col("s1" if i < 3 else "s2"), SIGN * (i % 3)).bitwiseAND(F.lit((1 << SIGN) - 1))
    slots = F.array(*(F.when(F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1, F.xxhash64("key", F.lit(i), sign(i))) for i in range(SLOTS)))
    return bad.select(F.col("b").alias("tid"), F.col("ab").alias("at"), F.explode(F.array_compact(slots)).alias("cls")).distinct()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES) -> DataFrame:
    """``a, b`` (numbers of texts) with verified word intervals ``sa, ea`` and ``sb, eb`` (ends excluded): links enough to
    connect what shares a passage, and to cover every passage, not all pairs of texts that share one."""
    texts = documents(docs, id_col, text_col).select(F.xxhash64("text").alias("tid"), "text")
    spread = texts.mapInArrow(lambda it: (_emit(p, TOKENS, hashes) for b in it for p in slices(b)), WINDOWS)
    dealt = spread.repartition(F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("b", "ab"))).sortWithinPartitions("key", "tid")
    links = materialize(dealt.mapInArrow(_meet, LINKS))
    pairs = materialize(_pairs(links))
    found = _compared(texts, pairs)
    # The first window of a class has been compared with all; those that failed may still go with one another.
    failed = materialize(_failed(links, found))
    many = failed.groupBy("cls").agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.count("*").alias("n")).where("low < high").select("cls", "n")
    again = join_spread(failed, many, "cls").groupBy("tid").agg(F.array_distinct(F.collect_list("at")).alias("places"))  # of one text
    again = materialize(again)
    near = _of(texts, again.select("tid"))(lambda p: p, "tid long, text string").groupBy("tid").agg(F.first("text").alias("text"))
    fine = materialize(near.join(again, "tid").mapInArrow(lambda it: (_around(p) for b in it for p in slices(b, 64)), "cls long, tid long, at long"))
    ends = fine.groupBy("cls").agg(F.min(F.struct("tid", "at")).alias("head"), F.max(F.struct("tid", "at")).alias("tail"), F.count("*").alias("n")).where("head.tid < tail.tid")
    to = F.when(F.col("tid") == F.col("head.tid"), F.col("tail")).otherwise(F.col("head"))
    more = join_spread(fine, ends, "cls").select(to.alias("to"), "tid", "at").select(F.col("to.tid").alias("a"), F.col("tid").alias("b"), F.col("to.at").alias("aa"), F.col("at").alias("ab"))
    later = materialize(_pairs(more))
    both = found.unionByName(_compared(texts, later))
    drop(links, pairs, failed, again, fine, later)
    return both


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id, n_texts, n_words, spans`` for documents that share a passage with another.

    ``component_id`` is the smallest id that verified links and exact copies reach, ``n_texts`` the number of different
    texts they reach, ``spans`` the repeated words as ``start:end`` (end excluded), ``n_words`` how many.
    """
    found = repeats(docs, id_col, text_col)
    own = documents(docs, id_col, text_col)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = materialize(own.select("doc_id", F.xxhash64("text").alias("tid"), words.alias("words")))
    texts = slim.where(F.col("words") >= LEAST).groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.max("words").alias("words"))
    whole = texts.where("copies > 1").select("tid", F.lit(0).cast("long").alias("s"), F.col("words").alias("e"))
    sides = found.select(F.col("a").alias("tid"), F.col("sa").alias("s"), F.col("ea").alias("e")).union(found.select("b", "sb", "eb")).union(whole)
    ends = sides.groupBy("tid", "s").agg(F.max("e").alias("e"))  # no more rows for a text than it has words
    order = Window.partitionBy("tid").orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = ends.withColumn("before", before).withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("tid", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = merged.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("spans"), F.sum(F.col("e") - F.col("s")).alias("n_words"))
    nodes = materialize(components(found.select("a", "b").distinct()))
    rooted = materialize(texts.join(spans, "tid").join(nodes, texts.tid == nodes.node, "left").select("tid", "low", "copies", "spans", "n_words", F.coalesce("root", "tid").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_texts"), F.count("*").alias("n"))
    named = join_spread(rooted, lowest, "root").select("tid", "component_id", "n_texts", "n_words", "spans", F.col("copies").alias("n"))
    return join_spread(slim.drop("words"), named, "tid").select("doc_id", "component_id", "n_texts", "n_words", "spans")
