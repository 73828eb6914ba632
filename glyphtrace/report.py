"""Findings as JSON, as text and as a Markdown table. Rows are streamed to the driver one partition at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(results: DataFrame) -> DataFrame:
    """One JSON text a row; keys are strings throughout, so repeated n-grams serialise too."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value"))


def lines(results: DataFrame, verbose: bool = False) -> Iterator[str]:
    """The human report."""
    n = 0
    for r in results.toLocalIterator():
        n += 1
        yield f"{r['file']} [{r['file_type']}, {r['size']} bytes]"
        if r["error"]:
            yield f"  error: {r['error']}"
        for k, v in (r["zero_width"] or {}).items():
            yield f"  zero-width {k}: {v}"
        if r["variation_selectors"]:
            yield f"  variation selectors: {r['variation_selectors']}"
        for x in (r["c2pa_structural"] or [])[:5]:
            yield f"  provenance: {x}"
        hits = r["suspicious_homoglyphs"] or []
        for h in hits[: None if verbose else 5]:
            yield f"  look-alike {h['codepoint']} for '{h['latin_equivalent']}' at {h['position']}"
        if len(hits) > 5 and not verbose:
            yield f"  ... and {len(hits) - 5} more"
        for note in r["notes"] or []:
            yield f"  {note}"
        if verbose and r["sentence_avg_length"] is not None:
            yield f"  sentences: mean {r['sentence_avg_length']:.1f}, median {r['sentence_median_length']:.1f}, deviation {r['sentence_length_variance']:.1f}"
        if verbose and r["ttr"] is not None:
            yield f"  distinct words: {r['ttr']:.3f}" + (f", moving {r['mattr']:.3f}" if r["mattr"] is not None else "")
    yield f"{n} file(s) with findings" if n else "No findings"


def cell(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def to_markdown(results: DataFrame) -> Iterator[str]:
    yield "| file | type | size | flagged | notes |"
    yield "|---|---|---|---|---|"
    for r in results.select("file", "file_type", "size", "has_watermark", F.array_join("notes", "; ").alias("notes")).toLocalIterator():
        yield f"| {cell(r['file'])} | {r['file_type']} | {r['size']} | {'yes' if r['has_watermark'] else 'no'} | {cell(r['notes'])} |"
