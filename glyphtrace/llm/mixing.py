"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key that is a hash of its id and text. A source's documents are ordered by that key; the
key's leading digits cut a source into ranges of about equal size, each range is summed by itself and
shifted by the sums of the ranges before it, and the source's budget cuts where it is reached. A
budget above the source's size takes whole passes first.

Targets: sources by code point (null last) weigh ``weights`` in turn and share ``share`` of all sizes;
none goes above ``most`` times its size, the excess goes to the others by weight (water level).

Cases: null texts have size 0 and hash like the empty text, as do null ids; rows of equal id and text are
interchangeable; texts of any length are read whole; extra columns are not read; no documents, no rows. Ranges are as
many as rows ask for, so one id, or none, in a third of all rows does not make one range of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prefix_sums

#: Rows of a range, about, and the most digits of the hex key that make one.
ROWS, DIGITS = 50_000, 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``."""
    order = sizes.select("source", "source_size", F.col("source").isNull().cast("int").alias("last"), F.coalesce("source", F.lit("")).alias("name"), F.lit(1).alias("one"))
    ranked = prefix_sums(order, ["last", "name"], {"rank": "one"})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", "last", "name", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    capped = capped.withColumn("level", F.col("cap") / F.col("w"))
    filled = materialize(prefix_sums(capped, ["level", "last", "name"], {"caps": "cap", "below": "w"}))
    total, weighed = filled.agg(F.sum("source_size"), F.sum("w")).first()
    if total is None:
        return filled.select("source", "source_size", F.lit(0.0).alias("target"))
    rest = F.lit(float(share * total)) - F.col("caps")
    water = rest / (F.lit(weighed) - F.col("below"))
    level = filled.where(water * F.col("w") <= F.col("cap")).agg(F.min_by(water, F.struct("level", "last", "name"))).first()[0]
    lam = float("inf") if level is None else level
    return filled.select("source", "source_size", F.least(F.lit(lam) * F.col("w"), F.col("cap").cast("double")).alias("target"))


def word_count(text):
    """Runs of anything but the six ASCII spaces."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_order(id_col: Column, text_col: Column | None = None) -> Column:
    """The key by which a source's documents are ordered: a hash of id and text, so rows of one id are spread."""
    parts = [F.coalesce(id_col.cast("string"), F.lit(""))] + ([F.coalesce(text_col, F.lit(""))] if text_col is not None else [])
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, keep_source: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken``; with ``keep_source`` also ``source`` and ``order``, the key (then of the id alone)."""
    key = mix_order(docs[id_col], None if keep_source else docs[text_col])
    slim = materialize(docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"), key.alias("key")))
    digits = next((k for k in range(1, DIGITS) if 16**k * ROWS >= slim.count()), DIGITS)
    slim = slim.withColumn("part", F.substring("key", 1, digits))
    ranges = slim.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("shift", F.coalesce(F.sum("sum").over(before), F.lit(0))))
    goal = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    goal = goal.withColumn("budget", F.floor("target").cast("long"))
    plan = ranges.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "part", "shift", "source_size", "target", "budget")
    here = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = slim.withColumn("before", F.coalesce(F.sum("size").over(here), F.lit(0)))
    both = local.alias("l").join(plan.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source")) & (F.col("l.part") == F.col("p.part")))
    passes = F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))
    rest = F.col("budget") - passes * F.col("source_size") - F.col("shift") - F.col("before")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    more = [F.col("l.source").alias("source"), F.col("key").alias("order")] if keep_source else []
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, CASE r WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, cap / w AS level,
             coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS below,
             row_number() OVER o AS rn, sum(source_size) OVER () AS total, sum(w) OVER () AS weighed
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((1.5 * total::DOUBLE - caps::DOUBLE) / (weighed - below)::DOUBLE, rn) AS lam FROM f
      WHERE (1.5 * total::DOUBLE - caps::DOUBLE) / (weighed - below)::DOUBLE * w <= cap),
t AS (SELECT source, source_size, least(lam * w, cap::DOUBLE) AS target FROM f, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(budget // nullif(source_size, 0), 0) * size
            + greatest(0, least(budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before, size)) AS BIGINT) AS taken
FROM p
"""
