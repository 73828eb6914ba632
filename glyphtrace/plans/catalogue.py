"""Queries by name, and the SQL that DuckDB runs on the same tables. All read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.expr import count_of, words
from ..operators import advanced, artifacts, corpus, homoglyph, lexical, marks, provenance, structure
from ..sources.files import extension_type
from . import scan
from .marked import text_column, text_sql

QUERIES: dict = {}
ORACLE: dict = {}
WS = chars.WS


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("t"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", text_column(F.col("doc_id"), F.col("text")).alias("t"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def joined(c):
    return F.array_join(c, "|")


M = f"WITH m AS (SELECT doc_id, lang, source, {text_sql()} AS t FROM documents)\n"
D = "WITH m AS (SELECT doc_id, lang, source, text AS t FROM documents)\n"
n_of = lambda p: f"CAST(len(regexp_extract_all(t, {q(p)})) AS BIGINT)"
words_sql = lambda t="t": f"list_filter(string_split_regex(lower({t}), '[{WS}]+'), lambda w: w <> '')"
span = lambda b: f"[\\x{{{b[0]:X}}}-\\x{{{b[1]:X}}}]"
any_of = lambda pats, flag, names=None: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {q(chars.java(p))}{flag}) THEN {q(n)} END" for p, n in zip(pats, names or pats)) + "], lambda x: x IS NOT NULL), '|')"


# ---- characters


@query(M + "SELECT doc_id, " + ", ".join(f"{n_of(f'\\x{{{c:X}}}')} AS u{c:04x}" for c in chars.ZERO_WIDTH) + " FROM m")
def zero_width_counts(spark, sf):
    found = marked(spark, sf).withColumn("z", marks.zero_width(F.col("t")))
    return found.select("doc_id", *(F.coalesce(F.try_element_at("z", F.lit(f"U+{c:04X}")), F.lit(0)).cast("long").alias(f"u{c:04x}") for c in chars.ZERO_WIDTH))


@query(M + f"SELECT doc_id, {n_of(span(chars.VARIATION_SELECTORS))} AS n FROM m")
def variation_selector_counts(spark, sf):
    return marked(spark, sf).select("doc_id", marks.variation_selectors(F.col("t")).alias("n"))


@query(M + "SELECT doc_id, array_to_string(list_filter([" + ", ".join(q(chr(c)) for c in chars.BIDI) + "], lambda c: contains(t, c)), '|') AS controls FROM m")
def bidi_controls(spark, sf):
    return marked(spark, sf).select("doc_id", joined(marks.bidi_controls(F.col("t"))).alias("controls"))


@query(M + f"SELECT doc_id, array_to_string(regexp_extract_all(t, {q(span(chars.MATH_ALPHANUMERIC))}), '|') AS found FROM m")
def math_alphanumerics(spark, sf):
    return marked(spark, sf).select("doc_id", joined(marks.math_alphanumerics(F.col("t"))).alias("found"))


@query(M + f"SELECT doc_id, array_to_string(regexp_extract_all(t, {q(span(chars.TAG_CHARACTERS))}), '|') AS found FROM m")
def tag_characters(spark, sf):
    return marked(spark, sf).select("doc_id", joined(marks.tag_characters(F.col("t"))).alias("found"))


_MAP = ", ".join(f"({q(k)}, {q(f'U+{ord(k):04X}')}, {q(v)})" for k, v in chars.homoglyphs().items())
_CHARS = M + f""", h(ch, codepoint, latin) AS (VALUES {_MAP}),
k AS (SELECT doc_id, t FROM m WHERE regexp_matches(t, {q(homoglyph.MAPPED)})),
c AS (SELECT doc_id, unnest(range(len(s))) AS p, unnest(s) AS ch FROM (SELECT doc_id, string_split(t, '') AS s FROM k)),
"""


@query(_CHARS.rstrip().removesuffix(",") + " SELECT doc_id, CAST(p AS INTEGER) AS position, c.ch AS letter, codepoint, latin FROM c JOIN h ON c.ch = h.ch")
def homoglyph_hits(spark, sf):
    return homoglyph.hits(marked(spark, sf), "doc_id", "t").select("doc_id", "position", F.col("char").alias("letter"), "codepoint", F.col("latin_equivalent").alias("latin"))


@query(
    _CHARS
    + f"""f AS (SELECT doc_id, p, ch, CAST(regexp_matches(ch, '[A-Za-z0-9]') AS INT) AS la, CAST(regexp_matches(ch, {q(homoglyph.SCRIPT)}) AS INT) AS hg FROM c),
r AS (SELECT *, la * lead(la, 1, 0) OVER w * lead(la, 2, 0) OVER w AS run, lag(la, 1, 0) OVER w AS before, lead(la, 1, 0) OVER w AS after FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT *, sum(la) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS l,
             sum(hg) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS g,
             max(run) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 100 PRECEDING AND 98 FOLLOWING) AS word FROM r)
SELECT doc_id, CAST(p AS INTEGER) AS position, s.ch AS letter FROM s JOIN h ON s.ch = h.ch
WHERE l > 0 AND g < 0.3 * (l + g) AND word > 0 AND (before + after) > 0"""
)
def homoglyph_suspicious(spark, sf):
    return homoglyph.hits(marked(spark, sf), "doc_id", "t").where("suspicious").select("doc_id", "position", F.col("char").alias("letter"))


@query(M + f"SELECT lang, CAST(sum({n_of('[A-Za-z0-9]')}) AS BIGINT) AS latin, CAST(sum({n_of(homoglyph.SCRIPT)}) AS BIGINT) AS script FROM m GROUP BY lang")
def script_mix_by_lang(spark, sf):
    return marked(spark, sf).groupBy("lang").agg(F.sum(count_of(F.col("t"), homoglyph.LATIN)).alias("latin"), F.sum(count_of(F.col("t"), homoglyph.SCRIPT)).alias("script"))


@query(M + f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {q(homoglyph.SCRIPT)}))), '|') AS letters FROM m")
def script_characters(spark, sf):
    return marked(spark, sf).select("doc_id", joined(homoglyph.script_characters(F.col("t"))).alias("letters"))


@query(M + ", p AS (SELECT doc_id, t, unnest(range(0, len(t), 97)) AS p FROM m) SELECT doc_id, CAST(p AS INTEGER) AS position, substr(t, greatest(1, p - 49), p + 51 - greatest(0, p - 50)) AS context FROM p")
def surrounding_context(spark, sf):
    """The context of every 97th position of every text."""
    each = marked(spark, sf).where(F.length("t") > 0).select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1, F.lit(97))).alias("position"))
    return each.select("doc_id", "position", homoglyph.surrounding_context(F.col("t"), F.col("position"), 50).alias("context"))


@query(M + f"SELECT doc_id, CASE WHEN nfc_normalize(t) <> t THEN 'non_nfc' WHEN regexp_matches(t, {q(f'[{chars.DECOMPOSABLE}]')}) THEN 'non_nfd' ELSE 'normalized' END AS form FROM m")
def normalization_form(spark, sf):
    return marked(spark, sf).select("doc_id", marks.normal_form(F.col("t")).alias("form"))


# ---- provenance


_SPACES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(t), {q(u)}) THEN {q('namespace:' + u)} END" for u in chars.NAMESPACE_URLS) + "], lambda x: x IS NOT NULL), '|')"


@query(M + f"SELECT doc_id, {_SPACES} AS found FROM m")
def c2pa_namespace(spark, sf):
    return marked(spark, sf).select("doc_id", joined(provenance.namespaces(F.col("t"))).alias("found"))


@query(M + f"SELECT doc_id, {any_of(chars.STRUCTURAL, ', ' + q('i'), ['pattern:' + p for p in chars.STRUCTURAL])} AS found FROM m")
def c2pa_structural(spark, sf):
    return marked(spark, sf).select("doc_id", joined(provenance.structural(F.col("t"))).alias("found"))


@query(M + f", f AS (SELECT doc_id, t, {_SPACES} || {any_of(chars.STRUCTURAL, ', ' + q('i'))} AS x FROM m) SELECT doc_id, CASE WHEN x = '' THEN '' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(t), {q(k)}) THEN {q(k)} END" for k in chars.LEGACY) + "], lambda x: x IS NOT NULL), '|') END AS found FROM f")
def c2pa_legacy(spark, sf):
    return marked(spark, sf).select("doc_id", joined(provenance.legacy(F.col("t"), provenance.findings(F.col("t")))).alias("found"))


# ---- sentences and words


_SENT = f""", s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda x: len({words_sql('x')})), lambda n: n > 3) AS x FROM m),
z AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n, CAST(list_sum(x) AS BIGINT) AS total, CAST(list_sum(list_transform(x, lambda v: v * v)) AS BIGINT) AS squares, list_median(x) AS median FROM s),
y AS (SELECT doc_id, n, CASE WHEN n >= 2 THEN total END AS total, CASE WHEN n >= 2 THEN n * squares - total * total END AS spread, CASE WHEN n >= 2 THEN CAST(median AS DOUBLE) END AS median FROM z)
"""


@query(D + _SENT + "SELECT doc_id, n, total, spread, round(total / n, 6) AS mean, median, round(sqrt(spread / (n * (n - 1))), 6) AS sd FROM y")
def sentence_stats(spark, sf):
    found = plain(spark, sf).select("doc_id", lexical.sentence_stats(lexical.sentence_lengths(F.col("t"))).alias("s"))
    return found.select("doc_id", "s.n", "s.total", "s.spread", F.round("s.mean", 6).alias("mean"), "s.median", F.round("s.sd", 6).alias("sd"))


@query(D + _SENT + "SELECT doc_id, n, spread FROM y WHERE spread > 0 AND spread < 25 * n * (n - 1)")
def low_variance_docs(spark, sf):
    found = plain(spark, sf).select("doc_id", lexical.sentence_stats(lexical.sentence_lengths(F.col("t"))).alias("s"))
    return found.where("s.spread > 0 AND s.spread < 25 * s.n * (s.n - 1)").select("doc_id", "s.n", "s.spread")


@query(D + f", w AS (SELECT doc_id, {words_sql()} AS w FROM m) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, round(len(list_distinct(w)) / nullif(len(w), 0), 6) AS ttr FROM w")
def ttr(spark, sf):
    w = plain(spark, sf).select("doc_id", words(F.col("t")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.round(lexical.ttr(F.col("w")), 6).alias("ttr"))


_MATTR = f""", w AS (SELECT doc_id, {words_sql()} AS w FROM m),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS tok, unnest(range(len(w))) AS j FROM w WHERE len(w) > 100),
p AS (SELECT doc_id, n, j, lag(j) OVER (PARTITION BY doc_id, tok ORDER BY j) AS prev FROM e),
a AS (SELECT doc_id, n, CAST(sum(greatest(0, least(j, n - 100) - greatest(0, j - 99, coalesce(prev, -1) + 1) + 1)) AS BIGINT) AS total FROM p GROUP BY doc_id, n)
"""


@query(D + _MATTR + "SELECT doc_id, CAST(n AS BIGINT) AS n_words, round(total / (100 * (n - 99)), 6) AS mattr FROM a")
def mattr(spark, sf):
    w = plain(spark, sf).select("doc_id", words(F.col("t")).alias("w")).where(F.size("w") > 100)
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.round(lexical.mattr(F.col("w")), 6).alias("mattr"))


@query(D + _MATTR + ", d AS (SELECT doc_id, len(list_distinct(w)) / len(w) AS ttr FROM w WHERE len(w) > 1000) SELECT doc_id, ttr < 0.45 AS low_ttr, total / (100 * (n - 99)) < 0.55 AS low_mattr FROM a JOIN d USING (doc_id)")
def low_diversity_docs(spark, sf):
    w = plain(spark, sf).select("doc_id", words(F.col("t")).alias("w")).where(F.size("w") > 1000)
    return w.select("doc_id", (lexical.ttr(F.col("w")) < 0.45).alias("low_ttr"), (lexical.mattr(F.col("w")) < 0.55).alias("low_mattr"))


_GRAMS = f""", w AS (SELECT doc_id, {words_sql()} AS w FROM m),
e AS (SELECT doc_id, w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] AS ngram, j FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS j FROM w WHERE len(w) > 2)),
g AS (SELECT doc_id, ngram, CAST(count(*) AS BIGINT) AS n, CAST(min(j) AS INTEGER) AS first FROM e GROUP BY doc_id, ngram HAVING count(*) >= 2)
"""


@query(D + _GRAMS + "SELECT doc_id, ngram, n, first FROM g")
def repeated_trigrams(spark, sf):
    found = plain(spark, sf).select("doc_id", F.explode(lexical.repeated_ngrams(words(F.col("t")))).alias("g"))
    return found.select("doc_id", "g.ngram", F.col("g.count").alias("n"), "g.first")


@query(D + _GRAMS + "SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM g JOIN m USING (doc_id) GROUP BY source")
def repetition_summary(spark, sf):
    found = plain(spark, sf).select("source", lexical.repeated_ngrams(words(F.col("t"))).alias("g")).where(F.size("g") > 0)
    return found.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["count"])).alias("occurrences"))


# ---- structure

_HEAD = f", h AS (SELECT doc_id, regexp_extract_all(t, {q('(?m)' + structure.HEADING)}, 1) AS a, regexp_extract_all(t, {q('(?m)' + structure.HEADING)}, 2) AS b FROM m), e AS (SELECT doc_id, unnest(range(len(a))) AS i, len(unnest(a)) AS level, regexp_replace(regexp_replace(unnest(b), '^[{WS}]+', ''), '[{WS}]+$', '') AS title FROM h)\n"


@query(M + _HEAD + "SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(level AS INTEGER) AS level, title FROM e")
def heading_outline(spark, sf):
    found = marked(spark, sf).select("doc_id", F.posexplode(structure.headings(F.col("t"))).alias("i", "h"))
    return found.select("doc_id", "i", "h.level", "h.title")


@query(M + _HEAD + ", l AS (SELECT doc_id, i, level, lag(level, 1, 6) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM e) SELECT doc_id, CAST(sum(CAST(level > prev + 1 AS INT) + CAST(i = 0 AND level <> 1 AS INT)) AS BIGINT) AS issues, CAST(count(*) AS BIGINT) AS headings FROM l GROUP BY doc_id")
def heading_issues(spark, sf):
    found = marked(spark, sf).select("doc_id", structure.headings(F.col("t")).alias("h")).where(F.size("h") > 0)
    return found.select("doc_id", structure.heading_issues(F.col("h")).alias("issues"), F.size("h").cast("long").alias("headings"))


_LIST = f"CASE WHEN len(list_distinct(regexp_extract_all(t, {q('(?m)' + structure.BULLET)}, 1))) > 1 THEN 'mixed' WHEN len(list_distinct(regexp_extract_all(t, {q('(?m)' + structure.BULLET)}, 1))) = 1 AND len(regexp_extract_all(t, {q('(?m)' + structure.ITEM)}, 1)) > 0 THEN 'uniform' ELSE 'none' END"


@query(M + f"SELECT doc_id, {_LIST} AS lists FROM m")
def list_uniformity(spark, sf):
    return marked(spark, sf).select("doc_id", structure.list_uniformity(F.col("t")).alias("lists"))


@query(M + f"SELECT doc_id, CAST(len(regexp_extract_all(t, {q('(?m)' + structure.ORDERED)}, 1)) AS BIGINT) AS items FROM m")
def ordered_lists(spark, sf):
    return marked(spark, sf).select("doc_id", F.size(structure.ordered_items(F.col("t"))).cast("long").alias("items"))


_CODE = f"{n_of(structure.TAGGED)} AS tagged, {n_of(structure.UNTAGGED)} AS untagged"


@query(M + f", c AS (SELECT doc_id, {_CODE} FROM m) SELECT doc_id, tagged, untagged, round(tagged / nullif(tagged + untagged, 0), 6) AS ratio FROM c")
def code_block_ratio(spark, sf):
    found = marked(spark, sf).select("doc_id", structure.code_blocks(F.col("t")).alias("b"))
    return found.select("doc_id", "b.tagged", "b.untagged", F.round(structure.tagged_ratio(F.col("b")), 6).alias("ratio"))


_LINES = "string_split(t, chr(10))"
_SPACING = f"CAST(list_sum(list_transform({_LINES}, lambda l: CAST(NOT regexp_matches(l, {q(structure.SPACED)}) AND regexp_matches(l, {q(structure.UNSPACED)}) AS INT) + CAST(regexp_matches(l, '[{WS}]$') AS INT))) AS BIGINT)"


@query(M + f"SELECT doc_id, {_SPACING} AS issues, CAST(len({_LINES}) AS BIGINT) AS n_lines FROM m")
def spacing_issues(spark, sf):
    return marked(spark, sf).select("doc_id", structure.spacing_issues(F.col("t")).alias("issues"), structure.lines(F.col("t")).cast("long").alias("n_lines"))


# ---- artifacts


@query(M + f"SELECT doc_id, {any_of(chars.PROMPTS, ', ' + q('i'))} AS found FROM m")
def prompt_leakage_hits(spark, sf):
    return marked(spark, sf).select("doc_id", joined(artifacts.prompt_leakage(F.col("t"))).alias("found"))


@query(M + f"SELECT doc_id, {any_of(chars.END_TOKENS, '')} AS found FROM m")
def eos_hits(spark, sf):
    return marked(spark, sf).select("doc_id", joined(artifacts.end_tokens(F.col("t"))).alias("found"))


@query(M + f"SELECT doc_id, {any_of(chars.ATTRIBUTION, ', ' + q('i'))} AS found FROM m")
def attribution_hits(spark, sf):
    return marked(spark, sf).select("doc_id", joined(artifacts.attribution(F.col("t"))).alias("found"))


@query("SELECT page_id, " + any_of(["<metadata", "<!--", r"\bdata-[a-z0-9-]+=", 'name="generator"'], ", 'i'", ["metadata", "comment", "data_attribute", "generator"]) + " AS found FROM (SELECT page_id, html AS t FROM pages)")
def embedded_metadata(spark, sf):
    return load(spark, sf, "pages").select("page_id", joined(artifacts.embedded_metadata(F.col("html"))).alias("found"))


# ---- roll-ups

_ROLL = (
    M
    + _SENT
    + _GRAMS.replace(", w AS", ", w AS", 1)
    + _MATTR.split("e AS", 1)[1].join([", e2 AS", ""]).replace("FROM e)", "FROM e2)").replace("p AS (", "p AS (", 1)
    + _HEAD.replace(", e AS", ", e3 AS")
    + f""", l AS (SELECT doc_id, i, level, lag(level, 1, 6) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM e3),
hi AS (SELECT doc_id, sum(CAST(level > prev + 1 AS INT) + CAST(i = 0 AND level <> 1 AS INT)) AS issues, count(*) AS c FROM l GROUP BY doc_id),
cb AS (SELECT doc_id, {_CODE} FROM m),
gg AS (SELECT DISTINCT doc_id FROM g),
f AS (SELECT m.doc_id, m.lang, m.source,
  coalesce(y.spread > 0 AND y.spread < 25 * y.n * (y.n - 1), false) AS sd,
  coalesce(len(w.w) > 1000 AND len(list_distinct(w.w)) / len(w.w) < 0.45, false) AS ttr,
  coalesce(len(w.w) > 1000 AND a.total / (100 * (a.n - 99)) < 0.55, false) AS mattr,
  coalesce(hi.issues = 0 AND hi.c > 3, false) AS headings,
  {_LIST} = 'uniform' AS lists,
  coalesce(cb.tagged / nullif(cb.tagged + cb.untagged, 0) < 0.3, false) AS code,
  nfc_normalize(t) <> t OR regexp_matches(t, {q(f'[{chars.DECOMPOSABLE}]')}) AS normal_form,
  regexp_matches(t, {q(f'[{chars.class_of(chars.BIDI)}]')}) AS bidi,
  regexp_matches(t, {q(span(chars.MATH_ALPHANUMERIC))}) AS math,
  regexp_matches(t, {q(span(chars.TAG_CHARACTERS))}) AS tags,
  {any_of(chars.PROMPTS, ', ' + q('i'))} <> '' AS prompts,
  gg.doc_id IS NOT NULL AS repeats,
  {any_of(chars.END_TOKENS, '')} <> '' AS end_tokens,
  {_SPACING} = 0 AND len({_LINES}) > 50 AS spacing
 FROM m LEFT JOIN y USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN cb USING (doc_id) LEFT JOIN gg USING (doc_id)
 WHERE len(t) > 100)
"""
)
_ANY = " OR ".join(f'"{k}"' for k in scan.FLAGS)


def flagged(spark, sf):
    rows = marked(spark, sf).where(F.length("t") > 100)
    return scan.statistics(rows, "t", mattr_over=scan.DEFAULT.long_words).select("doc_id", "lang", "source", *(v.alias(k) for k, v in scan.flags(F.col("stats")).items()))


@query(_ROLL + "SELECT doc_id, " + ", ".join(f'"{k}"' for k in scan.FLAGS) + f", ({_ANY}) AS has_mark FROM f")
def statistical_rollup(spark, sf):
    return flagged(spark, sf).select("doc_id", *scan.FLAGS, F.greatest(*scan.FLAGS).alias("has_mark"))


@query(_ROLL + "SELECT source, CAST(count(*) AS BIGINT) AS docs, " + ", ".join(f'CAST(count_if("{k}") AS BIGINT) AS "{k}"' for k in scan.FLAGS) + " FROM f GROUP BY source")
def flag_counts_by_source(spark, sf):
    return flagged(spark, sf).groupBy("source").agg(F.count("*").alias("docs"), *(F.count_if(k).alias(k) for k in scan.FLAGS))


_SUM = " + ".join(f'CAST("{k}" AS INT)' for k in scan.FLAGS)


@query(_ROLL + f"SELECT doc_id, CAST({_SUM} AS INTEGER) AS n, ({_SUM}) >= 3 AS agreed FROM f")
def agreement_flags(spark, sf):
    n = sum((F.col(k).cast("int") for k in scan.FLAGS), F.lit(0))
    return flagged(spark, sf).select("doc_id", n.alias("n"), corpus.agreement([F.col(k) for k in scan.FLAGS], 3).alias("agreed"))


@query(_ROLL + f"SELECT quality, toxic, CAST(count(*) AS BIGINT) AS docs, CAST(count_if({_ANY}) AS BIGINT) AS flagged FROM f JOIN labels USING (doc_id) GROUP BY quality, toxic")
def label_vs_flags(spark, sf):
    both = flagged(spark, sf).join(load(spark, sf, "labels"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count_if(F.greatest(*scan.FLAGS)).alias("flagged"))


@query(_ROLL + f"SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(count_if({_ANY}) AS BIGINT) AS flagged FROM f GROUP BY ROLLUP (lang, source)")
def flag_rollup(spark, sf):
    return flagged(spark, sf).rollup("lang", "source").agg(F.count("*").alias("docs"), F.count_if(F.greatest(*scan.FLAGS)).alias("flagged"))


@query()
def finding_filter(spark, sf):
    """The full scan of the marked corpus, flat columns only."""
    from ..sources.files import from_table

    results = scan.findings(scan.scan_texts(from_table(marked(spark, sf), "doc_id", "t")))
    return results.select("file", "file_type", "size", "has_watermark", "has_statistical_watermark", F.size("homoglyphs").alias("homoglyphs"), F.size("suspicious_homoglyphs").alias("suspicious"), F.array_join("notes", "; ").alias("notes"))


# ---- other tables


@query(r"SELECT page_id, CASE WHEN x = 'svg' THEN 'svg' WHEN x = 'png' THEN 'png' WHEN x IN ('jpg', 'jpeg') THEN 'jpg' WHEN x IN (" + ", ".join(q(e) for e in chars.TEXT_EXTENSIONS) + r") THEN 'text' END AS kind FROM (SELECT page_id, regexp_extract(lower(url), '\.([^./]+)$', 1) AS x FROM pages)")
def file_type_of_url(spark, sf):
    return load(spark, sf, "pages").select("page_id", extension_type(F.col("url")).alias("kind"))


def _page_marks(key: str, table: str, col: str) -> str:
    return f"SELECT {key}, {any_of(chars.PROMPTS, ', ' + q('i'))} AS prompts, {any_of(chars.END_TOKENS, '')} AS end_tokens, {n_of(f'[{chars.class_of(chars.ZERO_WIDTH)}]')} AS invisible FROM (SELECT {key}, {col} AS t FROM {table})"


def _marks_of(df, *keys):
    invisible = count_of(F.col("t"), f"[{chars.class_of(chars.ZERO_WIDTH)}]")
    return df.select(*keys, joined(artifacts.prompt_leakage(F.col("t"))).alias("prompts"), joined(artifacts.end_tokens(F.col("t"))).alias("end_tokens"), invisible.alias("invisible"))


@query(_page_marks("page_id", "pages", "html"))
def page_marks(spark, sf):
    return _marks_of(load(spark, sf, "pages").withColumn("t", F.col("html")), "page_id")


@query(_page_marks("conv_id, turn", "conversations", "text"))
def conversation_marks(spark, sf):
    return _marks_of(load(spark, sf, "conversations").withColumn("t", F.col("text")), "conv_id", "turn")


@query(D + f", w AS (SELECT doc_id, list_filter(string_split_regex(t, '[{WS}]+'), lambda w: w <> '') AS w FROM m), c AS (SELECT doc_id, w, unnest(range(0, len(w), 500)) AS i FROM w) SELECT doc_id, CAST(i // 500 AS INTEGER) AS chunk_idx, array_to_string(w[i + 1 : i + 500], ' ') AS chunk FROM c")
def chunk_500(spark, sf):
    return plain(spark, sf).select("doc_id", F.posexplode(advanced.chunks(F.col("t"), 500)).alias("chunk_idx", "chunk"))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.label, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.e, b.e) END AS c FROM v a JOIN v b ON a.label = b.label) SELECT label, CAST(round(sqrt(count(*))) AS BIGINT) AS n, round(avg(c), 4) AS clustering FROM p GROUP BY label")
def embedding_cluster_by_label(spark, sf):
    found = advanced.clustering(load(spark, sf, "embeddings"), "label", "embedding")
    return found.select("label", F.col("n").cast("long").alias("n"), F.round("embedding_clustering", 4).alias("clustering"))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), t AS (SELECT label, arg_min(e, vec_id) AS topic FROM v GROUP BY label) SELECT label, round(avg(list_cosine_similarity(e, topic)), 4) AS drift FROM v JOIN t USING (label) GROUP BY label")
def topic_drift_by_label(spark, sf):
    v = load(spark, sf, "embeddings")
    topics = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("topic"))
    return advanced.drift(v, topics, "label", "embedding", "topic").select("label", F.round("semantic_drift", 4).alias("drift"))


_KL = f"""SELECT doc_id, w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] AS ngram FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS j FROM w WHERE len(w) > 2)"""


@query(
    D
    + f""", w AS (SELECT doc_id, source = 'src0' AS own, {words_sql()} AS w FROM m),
e AS (SELECT own, w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] AS ngram FROM (SELECT own, w, unnest(range(len(w) - 2)) AS j FROM w WHERE len(w) > 2)),
a AS (SELECT ngram, count(*) AS t FROM e WHERE own GROUP BY ngram), b AS (SELECT ngram, count(*) AS b FROM e WHERE NOT own GROUP BY ngram)
SELECT round(sum(t / (SELECT sum(t) FROM a) * ln((t / (SELECT sum(t) FROM a)) / ((coalesce(b, 0) + 1) / (SELECT sum(b) + count(*) FROM b)))), 6) AS kl FROM a LEFT JOIN b USING (ngram)"""
)
def ngram_kl_vs_baseline(spark, sf):
    docs = plain(spark, sf)
    return corpus.divergence(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "t").select(F.round("kl", 6).alias("kl"))


@query(D + _SENT + f", w AS (SELECT doc_id, {words_sql()} AS w FROM m), x AS (SELECT lang, sqrt(spread / (y.n * (y.n - 1))) AS sd, len(list_distinct(w)) / nullif(len(w), 0) AS ttr FROM m JOIN y USING (doc_id) JOIN w USING (doc_id)) SELECT lang, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_sd, round(avg({m}) - 2 * stddev_samp({m}), 6) AS {m}_threshold" for m in ("sd", "ttr")) + " FROM x GROUP BY lang")
def baseline_thresholds(spark, sf):
    rows = plain(spark, sf).select("lang", lexical.sentence_stats(lexical.sentence_lengths(F.col("t")))["sd"].alias("sd"), lexical.ttr(words(F.col("t"))).alias("ttr"))
    out = corpus.thresholds(rows, ["lang"], ["sd", "ttr"])
    return out.select("lang", *(F.round(c, 6).alias(c) for c in out.columns if c != "lang"))


@query(D + f", w AS (SELECT doc_id, {words_sql()} AS w FROM m), e AS (SELECT doc_id, unnest(w) AS tok FROM w), c AS (SELECT tok, count(*) AS c FROM e GROUP BY tok), s AS (SELECT sum(c) + count(*) + 1 AS s FROM c) SELECT doc_id, round(avg(ln((c + 1) / s)), 6) AS mean_log_probability FROM e JOIN c USING (tok), s GROUP BY doc_id")
def unigram_perplexity(spark, sf):
    docs = plain(spark, sf)
    found = corpus.unigram_log_probability(docs, "doc_id", "t", docs)
    return found.select("doc_id", F.round("mean_log_probability", 6).alias("mean_log_probability"))


@query(D + f", w AS (SELECT doc_id, {words_sql()} AS w FROM m), e AS (SELECT DISTINCT unnest(w) AS entity FROM w), k AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[{WS}]+'), lambda w: w <> '')) AS entity FROM benchmark) SELECT entity FROM e ANTI JOIN k USING (entity)")
def unknown_entities(spark, sf):
    found = plain(spark, sf).select(F.explode(words(F.col("t"))).alias("entity")).distinct()
    known = load(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("entity")).distinct()
    return corpus.unknown_entities(found, known, "entity")


# ---- bytes: fixed literals; the SQL reads their hexadecimal digits

_BYTES = [
    ("png_min.png", "89504E470D0A1A0A0000000D4948445200000001"), ("png_bad.png", "89504E470D0A1A0A6332504100000000000000000000"),
    ("png_fixed.png", "89504E470D0A1A0A0000000049484452000000000000000463327061616161610000000000"), ("jumbf_c2pa", "FFD8FF6A756D6266433250410000000000"),
    ("jumbf_tail", "FFD8FF6A756D626643325041"), ("jumbf_only", "FFD8FF6A756D62660000"), ("c2pa_only", "FFD8FF633270610000"), ("nul_text", "410042"),
    ("bom_text", "EFBBBF61"), ("empty", ""), ("latin.txt", "636166E9"),
]


def literal_files(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_BYTES, "path string, hex string")
    return rows.select("path", F.unhex("hex").alias("content")).withColumn("length", F.octet_length("content").cast("long"))


_HEX = "WITH b(path, hex) AS (VALUES " + ", ".join(f"({q(p)}, {q(h)})" for p, h in _BYTES) + "),\n" + r"""
k AS (SELECT path, hex, CAST(length(hex) // 2 AS BIGINT) AS size,
  CASE WHEN path LIKE '%.png' THEN 'png' WHEN path LIKE '%.txt' THEN 'text' WHEN hex LIKE '89504E470D0A1A0A%' THEN 'png'
       WHEN hex LIKE 'FFD8FF%' THEN 'jpg' WHEN hex LIKE 'EFBBBF%' THEN 'text' WHEN NOT regexp_matches(hex, '^(..)*00') THEN 'text' ELSE 'binary' END AS file_type FROM b)
"""


@query(
    _HEX
    + r""", f AS (SELECT *, regexp_matches(hex, '^(..)*6A756D6266') AS jumbf,
  regexp_matches(hex, '^(..)*63327061') OR regexp_matches(substr(hex, 1, length(hex) - 2), '^(..)*[46]332[57]0[46]1') AS brand,
  path LIKE '%.png' AND hex LIKE '89504E470D0A1A0A%' AND size > 16 AND regexp_matches(substr(hex, 17, 8), '^([46]332[57]0[46]1|[57]0[57]2[57]6[46]E|[46]D[46]5[57]4[46]1)$') AS png FROM k),
g AS (SELECT *, (jumbf AND brand) OR png AS hit, file_type IN ('png', 'jpg', 'binary') AS bin FROM f)
SELECT path AS file, file_type, size, CASE WHEN bin THEN hit END AS binary_c2pa_detected, CASE WHEN bin THEN jumbf END AS jumbf_found, CASE WHEN bin THEN jumbf AND brand END AS c2pa_brand_found,
  CASE WHEN bin THEN hit ELSE regexp_matches(hex, '^(..)*(E2808[BCD]|E281A0|EFBBBF|EFB88[0-9A-F])') END AS has_watermark,
  CASE WHEN bin AND hit THEN 'Binary C2PA (JUMBF) detected' WHEN bin AND jumbf THEN 'JUMBF container detected' ELSE '' END AS notes FROM g"""
)
def binary_jumbf(spark, sf):
    results = scan.scan_files(literal_files(spark))
    return results.select("file", "file_type", "size", "binary_c2pa_detected", "jumbf_found", "c2pa_brand_found", "has_watermark", F.array_join("notes", "; ").alias("notes"))


@query(
    _HEX.replace("WITH b", "WITH RECURSIVE b", 1)
    + r""", w(path, hex, place, idx) AS (SELECT path, hex, CAST(8 AS BIGINT), 0 FROM b WHERE hex LIKE '89504E470D0A1A0A%' UNION ALL
  SELECT path, hex, place + 12 + CAST('0x' || substr(hex, 2 * place + 1, 8) AS BIGINT), idx + 1 FROM w WHERE 2 * place + 16 <= length(hex))
SELECT path, CAST(idx AS INTEGER) AS idx, decode(unhex(substr(hex, 2 * place + 9, 8))) AS type, CAST('0x' || substr(hex, 2 * place + 1, 8) AS BIGINT) AS length FROM w WHERE 2 * place + 16 <= length(hex)"""
)
def png_chunks(spark, sf):
    found = literal_files(spark).select("path", F.explode(provenance.png_chunks(F.col("content"))).alias("c"))
    return found.select("path", "c.idx", "c.type", "c.length")


@query(
    _HEX
    + r"""SELECT path, file_type, CASE WHEN file_type <> 'text' THEN NULL WHEN hex IN (SELECT hex FROM k WHERE regexp_matches(hex, '^([0-7].|C[2-9A-F][89AB].|D.[89AB].|E[1-9A-CEF][89AB].[89AB].)*$')) THEN decode(unhex(hex))
  ELSE array_to_string(list_transform(range(size // 2), lambda i: chr(CAST('0x' || substr(hex, CAST(4 * i + 3 AS BIGINT), 2) || substr(hex, CAST(4 * i + 1 AS BIGINT), 2) AS INTEGER))), '') END AS text FROM k"""
)
def decode_fallback(spark, sf):
    from ..sources.files import decode, file_type

    kind = file_type(F.col("path"), F.col("content"))
    return literal_files(spark).select("path", kind.alias("file_type"), F.when(kind == "text", decode(F.col("content"))).alias("text"))
