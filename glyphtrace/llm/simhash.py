"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into segments. With a distance of at most 4, some choice of ``picks``
segments differs in at most one bit altogether (3 segments and 1 pick: 4 bits over 3 segments leave
one with at most 1; 5 and 2, 6 and 3, 7 and 4 likewise). Each choice is indexed once for every bit of
it with that bit removed, so two such fingerprints meet in an equality of at least one variant. What
meets is verified by the full distance. More picks mean longer keys and fewer chance meetings; the
choice follows from the number of distinct fingerprints and any choice finds every link.

Inside a group of equal variants only a spanning forest of the links is kept, so a dense group yields
fewer links than it has members. Groups beyond ``GROUP`` members are dealt over pairs of blocks.

Cases: null and empty texts have fingerprint zero and link like others; equal texts share a
fingerprint; rows with a null id take the group's smallest id (null if there is none); empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import likeness
from .common import documents, drop, join_spread, map_arrow, materialize

DISTANCE, WORDS, SEED, SKETCHES = 4, 4, 42, 1
#: Members of a variant's group that one task compares; larger groups go to pairs of blocks.
GROUP = 20_000


def fingerprint(text: str, words: int = WORDS) -> int:
    tokens = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    n = len(tokens)
    if not n:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return digest(joined, SEED)
    size = np.fromiter(map(len, tokens), np.int64, n)
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: n - words + 1].tolist(), end[words - 1 :].tolist())
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, h.size, 1 << 15):
        part = h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` with the 64 bits as a signed long."""

    def run(batch):
        fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))}

    source = documents(docs, id_col, text_col)
    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(picks: int) -> list[int]:
    """Signed 64-bit masks: every choice of segments less one bit."""
    segments = {1: 3, 2: 5, 3: 6, 4: 7}[picks]
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    bits = [sum(1 << b for b in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    out = []
    for choice in combinations(bits, picks):
        whole = sum(choice)
        out += [whole & ~(1 << b) for b in range(64) if whole >> b & 1]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def picks_for(distinct: int) -> int:
    """Segments in a key, so that no more than some 64 fingerprints share one by chance: keys of 20, 25, 31 and 35 bits.
    A fingerprint has 64, 256, 640 or 1,280 variants of 16 bytes: 1, 4, 10 or 20 KB of index; every choice finds every link."""
    return next((p for p, most in ((1, 1 << 26), (2, 1 << 31), (3, 1 << 37)) if distinct <= most), 4)


def forest(x: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what is within ``distance``, by breadth-first search over what is left."""
    if x.size <= 256:
        near = (np.bitwise_count(x[:, None] ^ x) <= distance).sum(1) > 1
        if not near.any():
            return []
        x = x[near]
    out, left = [], x
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        while reached and left.size:
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out += [(at, q) for q in found]
                reached += list(found)
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], most: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``k1, k2`` with ``fp``: links, or the members themselves of groups that are too large."""
    names = ["k1", "k2", "a", "b"]
    held: list[np.ndarray] = []
    key, count, late = None, 0, False

    def close():
        if count > 1 and not late:
            x = np.unique(np.concatenate(held)).view(np.uint64)
            yield from forest(x, distance)

    def pack(k1, k2, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (k1, k2, a, b)], names)

    for batch in batches:
        k1, k2, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        n = fp.size
        if not n:
            continue
        new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        end = np.r_[new[1:], n]
        links: list[tuple[int, int]] = []
        deferred: list[tuple] = []
        first, last = 0, len(new) - 1
        inner = np.arange(len(new))
        # The first run may go on from before and the last may go on after: they are gathered; others are whole.
        whole = inner[(inner > first) & (inner < last)]
        two = whole[end[whole] - new[whole] == 2]
        a, b = fp[new[two]], fp[new[two] + 1]
        ok = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (a != b)
        pairs = [np.stack([a[ok], b[ok]])]
        edge = [first] if first == last else [first, last]
        for i in [first, *whole[end[whole] - new[whole] > 2].tolist(), *edge[1:]]:
            run = fp[new[i] : end[i]]
            if i in edge:
                now = (k1[new[i]], k2[new[i]])
                if now != key:
                    links += close()
                    held, key, count, late = [], now, 0, False
                count += run.size
                if not late:
                    held.append(run)
                if count > most:
                    deferred += [(now, r) for r in ([run] if late else held)]
                    held, late = [], True
            elif run.size > most:
                deferred.append(((k1[new[i]], k2[new[i]]), run))
            else:
                links += forest(np.unique(run).view(np.uint64), distance)
        if links:
            pairs.append(np.array(links, np.uint64).view(np.int64).T)
        a, b = np.concatenate(pairs, axis=1)
        if a.size:
            yield pack(np.full(a.size, -1), np.zeros(a.size), np.minimum(a, b), np.maximum(a, b))
        for (j, k), run in deferred:
            yield pack(np.full(run.size, j), np.full(run.size, k), run, run)
    if rest := list(close()):
        a, b = np.array(rest, np.uint64).view(np.int64).T
        yield pack(np.full(a.size, -1), np.zeros(a.size), np.minimum(a, b), np.maximum(a, b))


def _compare(keyed: DataFrame, most: int, distance: int) -> DataFrame:
    dealt = keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(lambda it: _links(it, most, distance), "k1 long, k2 long, a long, b long")


def link(fps: DataFrame, distance: int = DISTANCE, picks: int | None = None, group: int = GROUP) -> DataFrame:
    """Links ``a < b`` (a spanning forest of each group) between distinct fingerprints ``fp``."""
    if picks is None:
        picks = picks_for(fps.count())
    variants = fps.select(F.posexplode(F.array(*(F.lit(m) for m in masks(picks)))).alias("k1", "m"), "fp")
    # One number for a variant; a chance meeting of two variants only adds to a group, whose members are all verified.
    keyed = variants.select(F.lit(0).cast("long").alias("k1"), F.xxhash64("k1", F.col("fp").bitwiseAND(F.col("m"))).alias("k2"), "fp")
    found = materialize(_compare(keyed, group, distance))
    links, late = found.where("k1 < 0").select("a", "b"), found.where("k1 >= 0")
    if late.limit(1).count():  # blocks of half a group, every pair of blocks in a task of its own
        late = late.select("k1", "k2", F.col("a").alias("fp"))
        sizes = late.groupBy("k1", "k2").agg((F.count("*") * 4 / group + 1).cast("long").alias("n"))
        block = late.join(sizes, ["k1", "k2"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")))
        pairs = block.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        low, high = F.least("i", "j"), F.greatest("i", "j")
        blocks = pairs.select(F.xxhash64("k1", "k2").alias("k1"), (low * F.col("n") + high).alias("k2"), "fp")
        blocks = blocks.withColumn("k1", F.col("k1").bitwiseAND(F.lit((1 << 62) - 1)))
        links = links.union(_compare(blocks, 1 << 62, distance).where("k1 < 0").select("a", "b"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: connected components of ``a, b`` by alternating large and small stars, in tables of the shared folder.
    Nodes that hold a large part of all links are joined apart, so no task gets all links of one."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialize(join_spread(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        drop(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id that links reach from each document."""
    own = materialize(fingerprints(docs, id_col, text_col, words))
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    nodes = components(link(least.select("fp"), distance))
    rooted = materialize(least.join(nodes, least.fp == nodes.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = join_spread(rooted.select("root", "fp", F.col("n").alias("rows")), lowest, "root")
    return join_spread(own, named.select("fp", "component_id", F.col("rows").alias("n")), "fp").select("doc_id", "fp", "component_id")


def sketches(text: str, seeds: int = SKETCHES) -> list[int]:
    """Fingerprints of 62 bits of a text's different words, each under a hash of its own; the seed is the upper two bits."""
    words = set(text.encode().lower().split())
    if not words:
        return [k << 62 for k in range(seeds)]
    h, out = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64), []
    for k in range(seeds):
        x = (h ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1)) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for i in range(0, x.size, 1 << 15):
            ones += np.unpackbits(x[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > x.size, bitorder="little").view("<u8")[0]) & (1 << 62) - 1 | k << 62)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, component_id``: the smallest id that links between texts reach whose five-word shingles have a Jaccard
    similarity of ``least`` or more. Every such pair of texts is linked, directly or by others.

    First candidates are texts that have one of ``SKETCHES`` fingerprints of their different words within ``distance``, by the
    same variants as ``near_duplicates``; single words, since an edit changes fewer of them than of shingles. Equal
    fingerprints and linked ones meet by their smallest text. A spanning forest keeps what is near together, but not what is
    similar: a link of it may fail the check, and similar texts may have no near fingerprints. ``likeness.links`` verifies
    the candidates and finds all the others by the shingles themselves.
    """
    source = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tid"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batch):
        each = np.array([sketches(t) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "tid": batch.column("tid"), "f": pa.ListArray.from_arrays(np.arange(0, each.size + 1, SKETCHES, np.int32), each)}

    own = materialize(map_arrow(source, run, f"doc_id {kind}, tid long, f array<long>"))
    texts = materialize(own.groupBy("tid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("f").alias("f")))
    nodes = texts.select("tid", F.explode("f").alias("fp"))
    heads = materialize(nodes.groupBy("fp").agg(F.min("tid").alias("head"), F.max("tid").alias("high"), F.count("*").alias("n")))
    same = join_spread(nodes, heads.where("head < high").select("fp", "head", "n"), "fp").where("tid <> head").select(F.col("head").alias("a"), F.col("tid").alias("b"))
    links, one = link(heads.select("fp"), distance), heads.select("fp", "head")
    between = links.join(one.toDF("a", "ha"), "a").join(one.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    pairs = same.union(between).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs)
    found = components(likeness.links(source.select("tid", "text"), texts.where("n > 1").select("tid"), pairs, components, least))
    rooted = materialize(texts.drop("f").join(found, texts.tid == found.node, "left").select("tid", "low", "n", F.coalesce("root", "tid").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = join_spread(rooted.select("root", "tid", F.col("n").alias("rows")), lowest, "root")
    out = join_spread(own.drop("f"), named.select("tid", "component_id", F.col("rows").alias("n")), "tid").select("doc_id", "component_id")
    drop(pairs, heads, texts)
    return out


def hex_fingerprint(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")
