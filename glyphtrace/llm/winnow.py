"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are runs of anything but white space; in runs of over ``PIECE`` code points every code point is a token, so scripts
without spaces, and data such as base64, have grams at every offset. A gram's hash is a cyclic polynomial over the 64-bit hashes
of ``K`` tokens in a row: it rolls by one rotation, and grams of two and of four tokens, shared by neighbours, make it up.
Of every ``WINDOW`` grams in a row the smallest is kept, the rightmost among equals, with its place. Any passage of
``K + WINDOW - 1`` tokens that two texts share gives them a common hash.

Grams are ordered by the upper half of their hash. A gram is one number then: that half in the upper bits and its place,
counted down, in the lower 31, so the smallest number of a window is its smallest hash and of equals the rightmost. Window
minima double in width (2, 4, 8, 16 grams), so each costs four comparisons. What is kept has the whole hash.

Cases: null and empty texts have an empty fingerprint; texts shorter than a gram or a window count as
one; two empty fingerprints are alike (1.0), an empty and another are not (0.0). Rows are ordered by id
downwards (null last), then by a hash of the text; rows of equal id and text follow one another; a single row follows itself;
texts of any length are read whole; columns that are not named are not read; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, WINDOW, PIECE, PLACES = 5, 16, 24, (1 << 31) - 1
TOKEN = r"(?<!\S)\S{1,%d}(?!\S)|\S" % PIECE


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though lambdas in ``use`` read it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _turned(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _joined(a: Column, b: Column, n: int, step: int) -> Column:
    """Each number of ``a`` turned by ``n`` bits, with the one of ``b`` that stands ``step`` places on."""
    return F.transform(a, lambda x, i: _turned(x, n).bitwiseXOR(F.coalesce(F.get(b, i + step), F.lit(0).cast("long"))))


def grams(text: Column) -> Column:
    """The hashes of all grams in order."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    count = lambda h: F.greatest(F.size(h) - (K - 1), F.least(F.size(h), F.lit(1)))
    four = lambda h: bind(_joined(h, h, 1, 1), lambda two: _joined(two, two, 2, 2))
    return bind(hashes, lambda h: F.slice(bind(four(h), lambda f: _joined(f, h, 1, K - 1)), F.lit(1), count(h)))


def winnow(text: Column) -> Column:
    """Structs ``hash, place`` of the grams that are kept, in order of their windows."""

    def kept(g: Column) -> Column:
        width, out = 1, F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), 31).bitwiseOR(F.lit(PLACES) - i))
        while width < WINDOW:
            out = bind(out, _nearer(width))
            width *= 2
        # The last WINDOW - 1 minima are of windows that overhang the end; a text shorter than a window keeps one.
        full = lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (WINDOW - 1), F.least(F.size(m), F.lit(1))))
        place = lambda x: (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("int")
        return F.transform(F.array_distinct(bind(out, full)), lambda x: F.struct(F.get(g, place(x)).alias("hash"), place(x).alias("place")))

    return bind(grams(text), kept)


def _nearer(step: int) -> Callable[[Column], Column]:
    """The smaller of each number and the one ``step`` places on."""
    return lambda g: F.transform(g, lambda x, i: F.least(x, F.get(g, i + step)))


def digest(kept: Column) -> Column:
    """``hash:place`` of what is kept, comma-joined; the hash in 16 hexadecimal digits."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit(":"), x["place"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of kept hashes."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - both
        return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))

    hashes = [F.array_distinct(v) for v in (a, b)]
    return bind(hashes[0], lambda x: bind(hashes[1], lambda y: share(x, y)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept``: arrays of structs with hash and place, for matching passages."""
    return docs.select(docs[id_col].alias("doc_id"), winnow(F.coalesce(docs[text_col], F.lit(""))).alias("kept"))


def followers(slim: DataFrame) -> DataFrame:
    """``doc_id, k, h, n, chars, next_k, next_h``: each different row (``k, h``: hashes of id and text), how often it stands,
    and the one that follows by id downwards (null last), then ``h``; the first follows the last.

    Rows are dealt by range and ordered range by range; of each range only the first row meets the others' in one place.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    groups = slim.groupBy("doc_id", "k", "h").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    dealt = materialize(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = F.struct("k", "h")
    here = Window.partitionBy("part").orderBy(*order)
    ranked = dealt.withColumns({"next": F.lead(own).over(here), "place": F.row_number().over(here)})
    heads = ranked.where("place = 1").select("part", own.alias("head"))  # a row for each range
    after = Window.orderBy("part").rowsBetween(1, 1)
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = heads.select("part", F.coalesce(F.first("head").over(after), F.first("head").over(first)).alias("turn"))
    both = ranked.join(turn, "part").withColumn("to", F.coalesce("next", "turn"))
    return both.select("doc_id", "k", "h", "n", "chars", F.col("to.k").alias("next_k"), F.col("to.h").alias("next_h"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit (second half replaced by the next text's start), and their likeness.

    Who follows whom is found on ids and hashes alone. Texts are dealt once by their own hashes, equal rows combined before;
    each then sends its fingerprint and the start that is asked for to the row before it.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    known = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), docs[id_col].isNull()).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = materialize(followers(known.select("doc_id", "k", "h", F.length("text").alias("chars"))))
    half = lambda n: F.floor(n / 2).cast("int")
    # Hashes and places travel as arrays of numbers, a third of the size of structs; the row before needs hashes only.
    own = known.select("k", "h", "text", winnow(F.col("text")).alias("kept"))
    own = own.select("k", "h", "text", F.transform("kept", lambda x: x["hash"]).alias("hashes"), F.transform("kept", lambda x: x["place"]).alias("places"))
    # One struct, so both joins read the same columns and share one shuffle.
    own = own.groupBy("k", "h").agg(F.first(F.struct("text", "hashes", "places")).alias("own")).select("k", "h", "own.*")
    asked = order.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.col("next_k").alias("k"), F.col("next_h").alias("h"), half(F.col("chars")).alias("half"))
    sent = own.join(asked, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("start"), F.col("hashes").alias("next_hashes"))
    both = own.join(order.select("doc_id", "k", "h", "n"), ["k", "h"]).join(sent, ["k", "h"])
    # Of equal rows all but the last are followed by one like them.
    last = F.struct(F.lit(True).alias("last"), F.lit(1).cast("long").alias("times"))
    runs = F.when(F.col("n") == 1, F.array(last)).otherwise(F.array(last, F.struct(F.lit(False).alias("last"), (F.col("n") - 1).alias("times"))))
    both = both.withColumn("run", F.explode(runs))
    n = F.length("text")
    start = F.when(F.col("run.last"), F.col("start")).otherwise(F.substring(F.col("text"), F.lit(1), half(n)))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half(n)), start)
    edits = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "hashes", "places", F.when(F.col("run.last"), F.col("next_hashes")).otherwise(F.col("hashes")).alias("next_hashes"), "run.times")
    done = edits.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "hashes", "places", "next_hashes", winnow(F.col("edited")).alias("edited_kept"), "times")
    edited_hashes = F.transform("edited_kept", lambda x: x["hash"])
    own_kept = F.zip_with("hashes", "places", lambda x, p: F.named_struct(F.lit("hash"), x, F.lit("place"), p))
    out = done.select(
        "doc_id", "n_chars", "edited_sha256", digest(own_kept).alias("fingerprint"), digest(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), edited_hashes).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), F.explode(F.expr("array_repeat(1, CAST(times AS int))")).alias("_"),
    )
    return out.drop("_")
