"""The scalar detectors as SQL functions, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import chars


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions over one text; they are inlined, so they stay inside the JVM's plan."""

    def quoted(pattern: str) -> str:
        return "r'" + pattern.replace("'", r"\x27") + "'"

    span = lambda b: f"[\\x{{{b[0]:X}}}-\\x{{{b[1]:X}}}]"
    words = f"filter(split(lower(t), {quoted(f'[{chars.WS}]+')}), w -> w <> '')"
    made = {
        "zero_width_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(f'[{chars.class_of(chars.ZERO_WIDTH)}]')}) AS BIGINT)"),
        "variation_selector_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(span(chars.VARIATION_SELECTORS))}) AS BIGINT)"),
        "bidi_control_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(f'[{chars.class_of(chars.BIDI)}]')}) AS BIGINT)"),
        "math_alphanumeric_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(span(chars.MATH_ALPHANUMERIC))}) AS BIGINT)"),
        "tag_character_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(span(chars.TAG_CHARACTERS))}) AS BIGINT)"),
        "homoglyph_count": ("BIGINT", f"CAST(regexp_count(t, {quoted(f'[{chars.class_of(map(ord, chars.homoglyphs()))}]')}) AS BIGINT)"),
        "word_list": ("ARRAY<STRING>", words),
        "type_token_ratio": ("DOUBLE", f"try_divide(CAST(size(array_distinct({words})) AS DOUBLE), CAST(size({words}) AS DOUBLE))"),
        "line_count": ("INT", r"size(split(t, '\n'))"),
        "has_prompt_leakage": ("BOOLEAN", " OR ".join(f"t RLIKE {quoted('(?iu)' + chars.java(p))}" for p in chars.PROMPTS)),
        "has_end_token": ("BOOLEAN", " OR ".join(f"t RLIKE {quoted(p)}" for p in chars.END_TOKENS)),
    }
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(made)
