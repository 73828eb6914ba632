"""The scan: classify, decode, detect, roll up. One narrow stage: no row is shuffled, and none needs a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import chars
from ..functions.expr import once
from ..operators import advanced, artifacts, homoglyph, lexical, marks, provenance, structure
from ..sources.files import BINARY, decode, file_type

HITS = "array<struct<position:int,char:string,codepoint:string,latin_equivalent:string,suspicious:boolean>>"
NO_STRINGS = "CAST(array() AS array<string>)"
FAILED = "Error processing file"
FLAGS = ("sd", "ttr", "mattr", "headings", "lists", "code", "normal_form", "bidi", "math", "tags", "prompts", "repeats", "end_tokens", "spacing")


def statistics(df: DataFrame, text: str = "text", config: Config = DEFAULT, native: bool = False, mattr_over: int | None = None) -> DataFrame:
    """``df`` with a struct ``stats`` of all statistical measures of a text. The moving share of distinct words is left out
    up to ``mattr_over`` words (a window, if not given). What reads ``stats`` reads fields: it is computed once."""
    t = F.col(text)
    step = df.withColumn("_words", lexical.words(t)).withColumn("_sentences", lexical.sentence_stats(lexical.sentence_lengths(t)))
    step = step.withColumns({"_headings": structure.headings(t), "_blocks": structure.code_blocks(t, config.compat)})
    n = F.size("_words")
    made = once(
        step,
        "stats",
        F.struct(
            F.col("_sentences").alias("sentences"), n.cast("long").alias("n_words"), lexical.ttr(F.col("_words")).alias("ttr"),
            F.when(n > (config.mattr_window if mattr_over is None else mattr_over), lexical.mattr(F.col("_words"), config.mattr_window)).alias("mattr"),
            F.col("_headings").alias("headings"), structure.heading_issues(F.col("_headings")).alias("heading_issues"),
            structure.list_uniformity(t).alias("lists"), F.col("_blocks").alias("blocks"), structure.tagged_ratio(F.col("_blocks")).alias("tagged_ratio"),
            structure.spacing_issues(t).alias("spacing_issues"), structure.lines(t).alias("lines"),
            marks.normal_form(t, native).alias("normal_form"), marks.bidi_controls(t).alias("bidi"), marks.math_alphanumerics(t).alias("math"), marks.tag_characters(t).alias("tags"),
            artifacts.prompt_leakage(t).alias("prompts"), lexical.repeated_ngrams(F.col("_words"), config.ngram, config.min_repeats).alias("repeats"),
            artifacts.end_tokens(t, config.compat).alias("end_tokens"),
        ),
    )
    return made.select(*df.columns, "stats")


def flags(s: Column, config: Config = DEFAULT) -> dict[str, Column]:
    """Each statistical check as a boolean that is never null."""
    sd, n = s["sentences"], s["n_words"]
    low = sd["spread"] < F.lit(config.sentence_sd**2) * sd["n"] * (sd["n"] - 1)
    found = {
        "sd": low & (sd["spread"] > 0) if config.compat else low,
        "ttr": (n > config.long_words) & (s["ttr"] < config.ttr), "mattr": (n > config.long_words) & (s["mattr"] < config.mattr),
        "headings": (s["heading_issues"] == 0) & (F.size(s["headings"]) > config.headings), "lists": s["lists"] == "uniform",
        "code": s["tagged_ratio"] < config.tagged_ratio,
        "normal_form": s["normal_form"] != "normalized" if config.compat else s["normal_form"] == "non_nfc",
        "bidi": F.size(s["bidi"]) > 0, "math": F.size(s["math"]) > 0, "tags": F.size(s["tags"]) > 0, "prompts": F.size(s["prompts"]) > 0,
        "repeats": F.size(unusual(s["repeats"], config)) > 0, "end_tokens": F.size(s["end_tokens"]) > 0, "spacing": (s["spacing_issues"] == 0) & (s["lines"] > config.spacing_lines),
    }
    return {k: F.coalesce(found[k], F.lit(False)) for k in FLAGS}


def unusual(repeats: Column, config: Config = DEFAULT) -> Column:
    """Repeats but those that begin or end with a common phrase; as published the phrases, of two words, match none."""
    if config.compat:
        return repeats
    usual = "^(" + "|".join(chars.COMMON_PHRASES) + ") | (" + "|".join(chars.COMMON_PHRASES) + ")$"
    return F.filter(repeats, lambda r: ~r["ngram"].rlike(usual))


# The published notes, in the order of the checks.
NOTES = {
    "sd": "Low sentence length variance (std_dev=%.1f)", "ttr": "Low TTR (%.3f)", "mattr": "Low MATTR (%.3f)", "headings": "Perfect heading hierarchy (AI-like)",
    "lists": "Uniform list markers (AI-like)", "code": "Low code block tagging (ratio=%.2f)", "normal_form": "Non-normalized Unicode (%s)", "bidi": "Bidi override chars: [%s]",
    "math": "Math alphabetic chars: [%s]", "tags": "Tag characters: [%s]", "prompts": "Prompt leakage: [%s]", "repeats": "Unusual token repetition: [%s]",
    "end_tokens": "EOS patterns: [%s]", "spacing": "Perfect markdown spacing (AI-like)",
}


def quoted(texts: Column) -> Column:
    """Texts as the published notes list them: in quotes, backslashes doubled."""

    def one(x: Column) -> Column:
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.array_join(F.transform(texts, one), ", ")


def code_points(found: Column, form: str, digits: int) -> Column:
    """Characters as quoted code points of at least so many digits."""
    name = lambda c: F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0"))
    each = lambda c: F.concat(F.lit("'" + form), F.lpad(name(c), F.greatest(F.length(name(c)), F.lit(digits)), F.lit("0")), F.lit("'"))
    return F.array_join(F.transform(found, each), ", ")


def notes(s: Column, f: dict[str, Column], config: Config = DEFAULT) -> Column:
    """Notes in the order of the checks."""
    first = lambda a: F.slice(a, 1, 3)
    grams = F.transform(unusual(s["repeats"], config), lambda r: r["ngram"])
    values = {
        "sd": s["sentences"]["sd"], "ttr": s["ttr"], "mattr": s["mattr"], "code": s["tagged_ratio"], "normal_form": s["normal_form"], "bidi": F.lower(code_points(s["bidi"], "\\u", 4)),
        "math": code_points(s["math"], "U+", 4), "tags": code_points(s["tags"], "U+", 6), "prompts": quoted(first(s["prompts"])), "repeats": quoted(first(grams)), "end_tokens": quoted(s["end_tokens"]),
    }
    rows = [(k, F.format_string(text, values[k]) if k in values else F.lit(text)) for k, text in NOTES.items()]
    return F.array_compact(F.array(*(F.when(f[k], v) for k, v in rows)))


def scan_texts(rows: DataFrame, config: Config = DEFAULT, tagger: Callable | None = None, embedder: Callable | None = None) -> DataFrame:
    """Full result rows for text rows ``file, file_type, size, text, error``. Names may repeat; only ``advanced`` measures are joined by name."""
    t = F.col("text")
    found = provenance.findings(t)
    base = rows.withColumns({"c2pa_structural": found}).withColumns({"zero_width": marks.zero_width(t), "variation_selectors": marks.variation_selectors(t), "c2pa_indicators": F.concat("c2pa_structural", provenance.legacy(t, F.col("c2pa_structural")))})
    base = once(base, "_letters", F.coalesce(homoglyph.letters(t, config), F.array().cast(HITS)))
    plain = lambda h: F.struct(h["position"], h["char"], h["codepoint"], h["latin_equivalent"])
    pair = F.struct(F.transform("_letters", plain).alias("homoglyphs"), F.transform(F.filter("_letters", lambda h: h["suspicious"]), plain).alias("suspicious_homoglyphs"))
    base = once(base, "_hits", pair).select("*", "_hits.*").drop("_letters", "_hits")
    gate = F.lit(config.statistical) & F.col("file_type").isin("text", "svg", "md") & (F.length(t) > config.statistical_min_chars)
    full = statistics(base.withColumn("_gated", F.when(gate, t)), "_gated", config)
    s = F.col("stats")
    full = full.withColumn("_open", F.coalesce(gate, F.lit(False)))
    raised = {k: F.col("_open") & v for k, v in flags(s, config).items()}
    flag = F.greatest(*raised.values())
    said = F.struct(flag.alias("_flag"), F.when(F.col("_open"), notes(s, raised, config)).otherwise(F.expr(NO_STRINGS)).alias("_notes"))
    full = once(full, "_said", said).select("*", "_said.*").drop("_said")
    if config.advanced:
        more = advanced.measures(rows.where(F.col("file_type").isin("text", "svg", "md")), "file", "text", tagger, embedder, config)
        full = full.join(more, "file", "left")
    else:
        full = full.withColumns({"pos_ngrams": F.lit(None).cast("struct<nn_ratio:double,passive_ratio:double,adj_noun_ratio:double,det_noun_ratio:double,pron_verb_ratio:double>"), "embedding_clustering": F.lit(None).cast("double"), "semantic_drift": F.lit(None).cast("double"), "has_advanced_watermark": F.lit(None).cast("boolean"), "advanced_notes": F.expr(NO_STRINGS)})
    marked = (F.size(F.map_keys("zero_width")) > 0) | (F.col("variation_selectors") > 0) | (F.size("c2pa_structural") > 0) | (F.size("suspicious_homoglyphs") > 0)
    foreign = F.when((F.size("homoglyphs") > 0) & (F.size("suspicious_homoglyphs") == 0), F.format_string("Found %d homoglyph chars in a legitimate foreign-language context", F.size("homoglyphs")))
    kept = lambda c: F.when(F.col("_open"), c)
    adv = F.coalesce("advanced_notes", F.expr(NO_STRINGS))
    return full.select(
        "file", "file_type", "size", "error", "zero_width", "variation_selectors", (F.size("c2pa_structural") > 0).alias("c2pa_metadata"), "c2pa_structural", "c2pa_indicators",
        F.lit(None).cast("boolean").alias("binary_c2pa_detected"), F.lit(None).cast("boolean").alias("jumbf_found"), F.lit(None).cast("boolean").alias("c2pa_brand_found"), F.lit(None).cast("string").alias("binary_error"),
        "homoglyphs", "suspicious_homoglyphs",
        kept(s["sentences"]["mean"]).alias("sentence_avg_length"), kept(s["sentences"]["median"]).alias("sentence_median_length"), kept(s["sentences"]["sd"]).alias("sentence_length_variance"),
        kept(s["ttr"]).alias("ttr"), kept(s["mattr"]).alias("mattr"),
        kept(F.transform(s["headings"], lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["title"]))).alias("heading_hierarchy"), kept(s["heading_issues"]).alias("heading_hierarchy_consistency"),
        kept(s["lists"]).alias("list_uniformity"), kept(s["tagged_ratio"]).alias("code_block_tagged_ratio"), kept(s["spacing_issues"]).alias("markdown_spacing_issues"), kept(s["normal_form"]).alias("unicode_normalization"),
        kept(s["bidi"]).alias("bidi_overrides"), kept(s["math"]).alias("math_alphabetic_chars"), kept(s["tags"]).alias("tag_characters"), kept(s["prompts"]).alias("prompt_leakage"),
        kept(F.map_from_entries(F.transform(s["repeats"], lambda r: F.struct(r["ngram"], r["count"])))).alias("token_repetition"), kept(s["end_tokens"]).alias("eos_patterns"),
        kept(F.col("_flag")).alias("has_statistical_watermark"), kept(F.col("_notes")).alias("statistical_notes"),
        "pos_ngrams", "embedding_clustering", "semantic_drift", "has_advanced_watermark", "advanced_notes",
        F.when(F.col("error").isNull(), marked | F.col("_flag") | F.coalesce("has_advanced_watermark", F.lit(False))).alias("has_watermark"),
        F.when(F.col("error").isNotNull(), F.array(F.lit(FAILED))).otherwise(F.array_union(F.array_union(F.array_compact(F.array(foreign)), F.col("_notes")), adv)).alias("notes"),
    )


def scan_binaries(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Result rows for ``path, length, content, file_type, error``; text columns come in as null by ``unionByName``. What could
    not be read has its error in ``binary_error`` and ``error``, and is neither clean nor marked."""
    data = provenance.sample(F.col("content"), config)
    step = rows.withColumn("_data", data).withColumns({"jumbf_found": provenance.has_jumbf(F.col("_data")), "_brand": provenance.has_brand(F.col("_data"), config.compat), "_png": provenance.png_marked(F.col("path"), F.col("content"), config.compat)})
    brand = F.col("jumbf_found") & F.col("_brand")
    hit = brand | F.col("_png")
    note = F.when(hit, "Binary C2PA (JUMBF) detected").when(F.col("jumbf_found"), "JUMBF container detected")
    return step.select(F.col("path").alias("file"), "file_type", F.col("length").alias("size"), "error", hit.alias("binary_c2pa_detected"), "jumbf_found", brand.alias("c2pa_brand_found"), F.col("error").alias("binary_error"), hit.alias("has_watermark"), F.when(F.col("error").isNotNull(), F.array(F.lit(FAILED))).otherwise(F.array_compact(F.array(note))).alias("notes"))


def scan_files(found: DataFrame, config: Config = DEFAULT, tagger: Callable | None = None, embedder: Callable | None = None) -> DataFrame:
    """Full result rows for ``path, length, content`` (and ``error``, where the source gives one)."""
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    typed = found.select("path", "length", "content", error.alias("error"), file_type(F.col("path"), F.col("content")).alias("file_type"))
    texts = typed.where(~F.col("file_type").isin(*BINARY)).select(F.col("path").alias("file"), "file_type", F.col("length").alias("size"), decode(F.col("content"), config.compat).alias("text"), "error")
    binaries = typed.where(F.col("file_type").isin(*BINARY))
    return scan_texts(texts, config, tagger, embedder).unionByName(scan_binaries(binaries, config), allowMissingColumns=True)


def findings(results: DataFrame) -> DataFrame:
    """Rows that have anything to tell."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return results.where(on("has_watermark") | F.col("error").isNotNull() | (F.size("notes") > 0) | on("jumbf_found") | on("c2pa_brand_found") | on("has_statistical_watermark") | on("has_advanced_watermark"))


def exit_code(results: DataFrame) -> int:
    """1 where any row is flagged; rows with an error alone do not count."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return int(bool(results.agg(F.bool_or(on("has_watermark") | on("has_statistical_watermark") | on("has_advanced_watermark"))).first()[0]))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts of rows and of flagged rows by rollup."""
    return results.rollup(*by).agg(F.count("*").alias("files"), F.count_if("has_watermark").alias("flagged"), F.count_if(F.col("error").isNotNull()).alias("errors"))
