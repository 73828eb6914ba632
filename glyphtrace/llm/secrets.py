"""Secret scans with corpus-wide ownership frequency.

Three base patterns give spans per document. Every matched value is hashed; hashes are aggregated by
distinct repositories and owners over the whole corpus. A value that looks live and that no more than
``max_owners`` owners have in no more than ``max_repos`` repositories is owner-specific and adds a ``live``
span over the value; one that more owners or repositories have is a copied example and adds nothing.

Copies of one text (equal words, A-Z folded) count as one, of one owner and one repository: of those that
hold it, the one with most texts that have the value. So a value in a single text stays live wherever that
text was copied. Near copies count as texts of their own.

Cases: null texts are empty; null owners and repositories count as one each; rows of equal id and text
get equal results; where a value's texts are spread evenly over holders, the holder that is last by code point has them;
texts of any length are read whole; empty in, empty out; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, may_be_in

KINDS = ("assign", "access", "hex", "live")
#: Only ASCII letters fold: a long s or a Kelvin sign is no keyword's letter.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as longer runs of [0-9a-f]+ : runs are matched from their start
#: Repositories of one owner that may have a value before it counts as a copied example.
MAX_REPOS = 20


def base_spans(text: str) -> list[tuple[int, int, int, int, str]]:
    """start, kind, end, the value's start, the value; by start, then kind."""
    found = [(m.start(), 0, m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def looks_live(value: str) -> bool:
    """High entropy for its length. No list of words that samples carry: how many have the value decides that."""
    n = len(value)
    if n < 8:
        return False
    entropy = -sum(c / n * math.log2(c / n) for c in sorted(Counter(value).values()))
    return entropy + 1e-9 >= min(3.0, 0.75 * math.log2(n))


def row_key(id_col: Column, text_col: Column) -> Column:
    """The same for rows of equal id and text only."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text_col, F.lit(""))).cast("binary"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """A table in the shared folder: ``key, doc_id, owner, repo, copy, n_*, base_sha256`` and ``found``, the base spans."""

    def run(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "copy", "found")}
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            kinds = Counter(s[1] for s in spans)
            for i, k in enumerate(KINDS[:3]):
                out[f"n_{k}"].append(kinds[i])
            out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans).encode()).hexdigest())
            out["copy"].append(xxhash.xxh3_128_hexdigest(b" ".join(text.encode().lower().split())) if spans else None)
            out["found"].append([{"start": a, "kind": k, "end": b, "from": v, "to": v + len(x), "value": xxhash.xxh3_128_hexdigest(x), "live": looks_live(x)} for a, k, b, v, x in spans])
        return out | {k: batch.column(k) for k in ("key", "doc_id", "owner", "repo")}

    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(row_key(docs[id_col], docs[text_col]).alias("key"), docs[id_col].alias("doc_id"), docs[owner_col].cast("string").alias("owner"), docs[repo_col].cast("string").alias("repo"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,kind:int,end:int,from:int,to:int,value:string,live:boolean>>"
    return materialize(map_arrow(source, run, f"key string, doc_id {kind}, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, copy string, found {spans}"))


def _holders(each: DataFrame, col: str) -> DataFrame:
    """``value, n``: distinct holders, where each text belongs to the one of ``col`` that has most texts with the value.
    Distinct rows are counted level by level, so a value that a third of the documents share is combined before it
    meets in one place."""
    held = each.select("value", "copy", F.coalesce(F.concat(F.lit("="), col), F.lit("")).alias("holder")).distinct()
    texts = held.groupBy("value", "holder").agg(F.count("*").alias("texts"))
    most = held.join(texts, ["value", "holder"]).groupBy("value", "copy").agg(F.max(F.struct("texts", "holder")).alias("most"))
    return most.select("value", "most.holder").distinct().groupBy("value").agg(F.count("*").alias("n"))


def ownership(scanned: DataFrame) -> DataFrame:
    """``value, n_owners, n_repos`` over the corpus, copies of one text counted once."""
    each = scanned.where(F.size("found") > 0).select("owner", "repo", "copy", F.explode("found.value").alias("value"))
    owners, repos = (_holders(each, c).withColumnRenamed("n", f"n_{c}s") for c in ("owner", "repo"))
    return owners.join(repos, "value")


def live_spans(scanned: DataFrame, max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """``key, live`` for rows with owner-specific live-looking values: structs of start, kind, end."""
    each = scanned.where(F.exists("found", lambda s: s["live"])).select("key", F.explode(F.filter("found", lambda s: s["live"])).alias("s"))
    each = each.select("key", F.struct(F.col("s.from").alias("start"), F.lit(3).alias("kind"), F.col("s.to").alias("end")).alias("span"), F.col("s.value").alias("value")).distinct()
    own = ownership(scanned).where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("value")
    return each.join(own, "value", "left_semi").groupBy("key").agg(F.collect_set("span").alias("live"))


def secret_spans(docs: DataFrame, max_owners: int = 1, max_repos: int = MAX_REPOS, **columns: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live``."""
    scanned = scan(docs, **columns)
    both = scanned.join(live_spans(scanned, max_owners, max_repos), "key", "left")
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    live = F.coalesce("live", F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(F.array_sort(F.concat(base, live)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"), F.size(live).cast("long").alias("n_live"))


def redact(docs: DataFrame, max_owners: int = 1, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_repos: int = MAX_REPOS) -> DataFrame:
    """All rows and columns of ``docs``; owner-specific live-looking values in the text give way to ``mask``. Only rows that
    have such values, and the few that a bitmap of their keys takes for such, are joined to them."""
    live = live_spans(scan(docs, id_col, text_col, owner_col, repo_col), max_owners, max_repos)
    live = materialize(live.select(F.col("key").alias("_live_key"), F.array_sort(F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("_live")))
    own = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    rows = docs.select(row_key(docs[id_col], docs[text_col]).alias("_live_key"), own.alias("row")).withColumn("h", F.xxhash64("_live_key"))
    told = may_be_in(rows, "h", live.select(F.xxhash64("_live_key")), "told")
    both = told.where("told").join(live, "_live_key", "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None:
                return text
            out, at = [], 0
            for a, b in ((s["start"], s["end"]) for s in found):
                if b > at:
                    out += [text[at : max(a, at)], mask]
                    at = b
            return "".join(out) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    new = both.select("row", masked(F.col("row").getField(text_col), "_live").alias("new"))
    new = new.select(*((F.col("new") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
    return told.where("NOT told").select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(new)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{24,}')) AS x(kind, pattern)),
m AS (SELECT doc_id, source, t, kind, pattern, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS rest
      FROM d, p WHERE regexp_matches(t, pattern)),
e AS (SELECT doc_id, source, t, kind, hits[i] AS hit, pattern,
             list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS b
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
v AS (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(hit, pattern, 2) ELSE hit END AS value FROM e),
s AS (SELECT doc_id, source, t, kind, CAST(b AS BIGINT) AS b, CAST(b + length(hit) AS BIGINT) AS f, value FROM v
      WHERE length(value) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
h AS (SELECT value, list_sum(list_transform(map_values(histogram), lambda c: -(c / length(value)) * log2(c / length(value)))) AS entropy
      FROM (SELECT value, list_histogram(string_split(value, '')) AS histogram FROM (SELECT DISTINCT value FROM s))),
c AS (SELECT DISTINCT value, array_to_string(list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda w: w <> ''), ' ') AS copy,
             coalesce('=' || source, '') AS owner, coalesce('=' || CAST(doc_id AS VARCHAR), '') AS repo FROM s),
co AS (SELECT value, copy, owner, count(*) OVER (PARTITION BY value, owner) AS n FROM (SELECT DISTINCT value, copy, owner FROM c)),
cr AS (SELECT value, copy, repo, count(*) OVER (PARTITION BY value, repo) AS n FROM (SELECT DISTINCT value, copy, repo FROM c)),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM (SELECT value, copy, arg_max(owner, (n, owner)) AS owner FROM co GROUP BY ALL) GROUP BY value),
r AS (SELECT value, count(DISTINCT repo) AS repos FROM (SELECT value, copy, arg_max(repo, (n, repo)) AS repo FROM cr GROUP BY ALL) GROUP BY value),
live AS (SELECT value FROM o JOIN r USING (value) JOIN h USING (value)
         WHERE owners <= 1 AND repos <= 20 AND length(value) >= 8 AND entropy + 1e-9 >= least(3.0, 0.75 * log2(length(value)))),
g AS (SELECT doc_id, kind, b, f FROM s UNION
      SELECT doc_id, 3, b + CASE WHEN kind = 0 THEN f - b - length(value) ELSE 0 END, f FROM s JOIN live USING (value)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             coalesce(string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || b || ':' || f, ',' ORDER BY b, kind) FILTER (kind < 3), '') AS base,
             string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || b || ':' || f, ',' ORDER BY b, kind) AS spans,
             count(*) FILTER (kind = 3) AS n_live FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
