"""Corpus stages: rows of documents in, rows of documents out.

Stages know rows by ``row_key``, so null and repeated ids are rows like others. All columns of the
input come back, whatever their names. What a stage decides is a small table of keys; a bitmap of them tells each task which of
its rows to look up, so rows that nothing is decided about are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, materialize, may_be_in
from .mixing import mix, mix_order, word_count
from .secrets import row_key
from .simhash import similar


def column(name: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def _rows(docs: DataFrame) -> DataFrame:
    """``key, row, text, source, doc_id``: every row under its key, all columns in a struct."""
    named = F.struct(*(column(c) for c in docs.columns))
    return docs.select(row_key(docs["doc_id"], docs["text"]).alias("key"), named.alias("row"))


def _plain(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (null first), then key.

    Cases: null and empty texts are duplicates of one another; rows of equal id and text are one; empty in, empty out.
    """
    rows = _rows(docs).withColumn("h", F.xxhash64("key"))
    own = rows.select(F.struct(F.col("row").getField("doc_id").alias("doc_id"), "key").alias("id"), F.col("row").getField("text").alias("text"))
    found = materialize(similar(own, "id", "text").select(F.col("doc_id.key").alias("key"), (F.col("doc_id.key") == F.col("component_id.key")).alias("first")))
    # Rows to look up: those of other documents of a group, and those that stand more than once.
    many = materialize(found.groupBy("key").agg(F.bool_or("first").alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1"))
    told = may_be_in(rows, "h", many.select(F.xxhash64("key")), "told")
    some = told.where("told").join(many, "key", "left").where("first IS NULL OR first")
    once = some.where("first").groupBy("key").agg(F.first("row").alias("row"))
    return _plain(told.where("NOT told").select("row").unionByName(some.where("first IS NULL").select("row")).unionByName(once.select("row")), docs)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut gives its first words only.

    A source's documents before its cut, by key, are taken once more than those after it: a row a source tells what to do
    with all others, and only rows of the cut's own key are looked up.
    Cases: documents without words are not taken; rows of equal id and text are taken one after the other; a null source is
    one of its own; empty in, empty out.
    """
    rows = _rows(docs).withColumn("source", F.col("row").getField("source").cast("string")).withColumn("size", word_count(F.col("row").getField("text")))
    plan = materialize(mix(rows.select("key", F.col("row").getField("text").alias("text"), "source"), "key", "text", "source", keep_source=True, **options))
    passes = F.coalesce(F.expr("CAST(floor(target) AS bigint) div nullif(source_size, 0)"), F.lit(0))
    each = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "size", "taken", passes.alias("passes"), F.col("doc_id").alias("key"), F.col("order").alias("place"))
    whole = F.col("taken") >= (F.col("passes") + 1) * F.col("size")
    cuts = materialize(each.where("size > 0").groupBy("name").agg(F.first("passes").alias("passes"), F.min(F.when(~whole, F.struct("place", "key"))).alias("cut"), F.count("*").alias("n")))
    takes = each.join(cuts.select(F.col("cut.key").alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("taken", "size"))).alias("takes"))  # of equal rows
    all_rows = rows.where("size > 0").withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("place", mix_order(F.col("key")))
    told = join_spread(all_rows, cuts, "name")
    at = F.struct("place", "key")
    times = F.when(F.col("cut").isNull() | (at < F.col("cut")), F.col("passes") + 1).otherwise(F.col("passes"))
    plain = told.where(F.col("cut").isNull() | (at != F.col("cut"))).withColumn("times", times).where("times > 0")
    edge = told.where(at == F.col("cut")).withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    edge = edge.join(takes, "key").withColumn("take", F.get("takes", F.col("i") - 1))
    full = plain.select("row", F.explode(F.expr("array_repeat(1, CAST(times AS int))")).alias("_")).select("row")
    again = edge.select("row", F.explode(F.expr("array_repeat(1, CAST(take.taken div take.size AS int))")).alias("_")).select("row")
    part = edge.withColumn("words", (F.col("take.taken") % F.col("take.size")).cast("int")).where("words > 0")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row").getField("text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("words")), "")
    part = part.select(*((head if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
    return _plain(full.unionByName(again), docs).unionByName(part)
