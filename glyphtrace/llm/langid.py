"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. An n-gram's vector is the product of its letters'
vectors, each rotated by its place; a text's vector is the sum over its n-grams, and so is a
language's prototype over all its training texts. The cosine between the two decides.

Letters: a-z and other letters (by a hash of the code point) share 128 classes; anything else is the
one class of gaps. Prototypes are exact integer sums over every training row, so their value does not
depend on partitions. They come to the driver as languages x dimensions numbers.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first language
by code point; with no training rows everything is ``und``; rows with a null language teach nothing; texts of any length
are read whole, in blocks of n-grams; repeated rows get equal results; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

DIMENSIONS, GRAM, CLASSES, BLOCK = 512, 3, 128, 1 << 13


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; 0 for what is no letter."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = 27 + (c * 2654435761 >> 7) % (CLASSES - 27)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(4)
def _letters(dimensions: int) -> np.ndarray:
    """For each place of an n-gram, the rotated vectors of all classes."""
    base = np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))
    return np.stack([np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)])


def _grams(text: str) -> tuple[np.ndarray, bool]:
    """Codes of the n-grams of a text between two gaps, and whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    table = _classes()
    kinds = table[np.minimum(points, 0xFFFF)]
    if (high := np.flatnonzero(points > 0xFFFF)).size:
        kinds[high] = [27 + (c * 2654435761 >> 7) % (CLASSES - 27) if chr(c).isalpha() else 0 for c in points[high].tolist()]
    kinds = np.concatenate([[0], kinds, [0]])
    if kinds.size < GRAM:
        return np.zeros(0, np.int64), False
    codes = kinds[: kinds.size - GRAM + 1].copy()
    for i in range(1, GRAM):
        codes = codes * CLASSES + kinds[i : kinds.size - GRAM + 1 + i]
    return codes[codes > 0], bool(kinds.any())


def _counts(texts: list[str | None]) -> tuple[np.ndarray, int, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has letters, the n-grams of the longest, and blocks of ``BLOCK`` n-gram codes with their counts
    (texts x codes), so memory does not grow with the number of different n-grams."""
    each = [_grams(t or "") for t in texts]
    sizes = [g.size for g, _ in each]

    def blocks():
        if not sum(sizes):
            return
        codes, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), sizes)
        if codes.size > BLOCK:
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
        cuts = np.searchsorted(at, np.arange(0, codes.size + BLOCK, BLOCK)) if codes.size > BLOCK else [0, at.size]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            some = codes[k * BLOCK : (k + 1) * BLOCK]
            if some.size:
                n = len(texts) * some.size
                yield some, np.bincount(row[lo:hi] * some.size + at[lo:hi] - k * BLOCK, minlength=n).reshape(len(texts), some.size)

    return np.array([x for _, x in each], bool), max(sizes, default=0), blocks()


def _vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    letters, out = _letters(dimensions), None
    for i in range(GRAM):
        part = letters[i][codes // CLASSES ** (GRAM - 1 - i) % CLASSES]
        out = part if out is None else out * part
    return out


def prototypes(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Sum of the n-gram vectors of each language's texts."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 128):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                member = np.array([[x == n for x in langs] for n in names], np.float64)
                for codes, counts in _counts(part.column("text").to_pylist())[2]:
                    bundle = (member @ counts) @ _vectors(codes, dimensions).astype(np.float64)
                    for name, v in zip(names, bundle):
                        sums[name] = sums.get(name, 0) + v.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    texts = train.select(train[text_col].alias("text"), train[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    parts = texts.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sums.select("lang", F.col("v.x").alias("v")).collect()  # languages x dimensions
    return {r["lang"]: np.array(r["v"], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: dict, text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns ``keep`` (name: Column) with ``lang_pred`` and ``score``, the cosine where it is above 0."""
    names = sorted(profiles)
    unit = np.stack([profiles[n] / max(np.linalg.norm(profiles[n]), 1e-12) for n in names]) if names else np.zeros((0, dimensions))

    carried = list(keep)

    def run(batch):
        lang, score = [], []
        for part in slices(batch, 128):
            letters, longest, blocks = _counts(part.column("text").to_pylist())
            if not names or not letters.any():
                lang += ["und"] * part.num_rows
                score += [0.0] * part.num_rows
                continue
            kind = np.float32 if longest < 1 << 24 else np.float64  # in which sums of that many ones are exact
            v = np.zeros((part.num_rows, dimensions), kind)
            for codes, counts in blocks:
                v += counts.astype(kind) @ _vectors(codes, dimensions).astype(kind)
            v = v.astype(np.float64)
            cos = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            best = cos.argmax(1)
            lang += [names[b] if ok else "und" for b, ok in zip(best, letters)]
            score += [float(min(max(cos[i, b], 0), 1)) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters))]
        return {"lang_pred": lang, "score": score} | {k: batch.column(k) for k in carried}

    source = docs.select(*(c.alias(k) for k, c in keep.items()), docs[text_col].alias("text"))
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(source, run, f"{kinds}, lang_pred string, score double")
