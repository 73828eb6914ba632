"""Shared plumbing: table access, shared-folder tables, Arrow mapping, distributed prefix sums.

Every operator selects the columns it names at once, so extra columns of any name pass by unread;
null texts count as empty unless an operator states otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, where driver and executors are one, gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and that nothing reads any more."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_spread(rows: DataFrame, one: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """Join ``rows`` to ``one``, which has a row for a key and, as ``n``, how many rows the key has (or more).

    Keys of over a ``most``-th of all rows, fewer than ``most`` by count, are sent to every task; the others are joined
    by a shuffle in which no key is large. Keys are not null.
    """
    one = materialize(one)
    total, top = one.agg(F.sum("n"), F.max("n")).first()
    limit = (total or 0) // most + 1000
    if (top or 0) <= limit:
        return rows.join(one.drop("n"), key)
    hot = F.broadcast(one.where(F.col("n") > limit).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(one.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def sieve(keys: DataFrame, bits: int = 1 << 23) -> Callable[[np.ndarray], np.ndarray]:
    """A test over arrays that all of the one long column ``keys`` pass, and few others while keys are fewer than
    ``bits``. Only ``bits`` bits meet on the driver, whatever the number of keys."""
    x = F.pmod(F.col(keys.columns[0]), F.lit(bits)) + 1
    parts = keys.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for i, b in parts:
        out[(i - 1) * 4096 : i * 4096] = np.frombuffer(bytes(b), np.uint8)

    def test(values: np.ndarray) -> np.ndarray:
        at = values & (bits - 1)
        return (out[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return test


def may_be_in(rows: DataFrame, col: str, keys: DataFrame, name: str, most: int = 1 << 30) -> DataFrame:
    """``rows`` with a boolean ``name``: true for every row whose long ``col`` is in the one column of ``keys``, and false
    for nearly all others. A table of 16 bits a key, 128 MB at most, is what every task gets; no row is shuffled."""
    bits = min(max(1 << 15, 1 << (16 * keys.count()).bit_length()), most)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    hits = keys.select(at(F.col(keys.columns[0])).alias("x"))
    maps = hits.groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits"))
    place = F.bitmap_bit_position(at(F.col(col)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.get(F.array(*(F.lit(1 << k) for k in range(8))), place.bitwiseAND(F.lit(7)).cast("int"))) != 0, F.lit(False))
    both = rows.withColumn("_bucket", F.bitmap_bucket_number(at(F.col(col)))).join(F.broadcast(maps), "_bucket", "left")
    return both.withColumn(name, hit).drop("_bucket", "_bits")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text becomes empty."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a batch into a dict of columns matching ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_to(fn.__module__)
        for batch in batches:
            for part in slices(batch):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((cols[f.name], f) for f in arrow)], schema=arrow
                )

    return df.mapInArrow(run, out)


_KEPT: dict[tuple, object] = {}


def kept(owner: str, key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` makes, kept in this Python worker from task to task, until a task of another module comes."""
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def leave_to(owner: str) -> None:
    """Drop what tasks of other modules have kept: workers are used again, and caches of several operators would add up."""
    for name in [k for k in _KEPT if k[0] != owner]:
        del _KEPT[name]
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, the sum of the rows before this one in ``order``.

    Rows are dealt by range; each range is summed by itself and shifted by the totals of the ranges
    before it, so the only thing met in one place is a row for each range.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    shift = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(up_to), F.lit(0)).alias(f"_{n}") for n in sums))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()})
    return local.join(shift, "_range").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *(f"_{n}" for n in sums))
