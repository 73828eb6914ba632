"""Detectors against fixed rows; quirks in both modes."""

import random
import re
import unicodedata
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphtrace.config import DEFAULT
from glyphtrace.functions import chars, sql
from glyphtrace.operators import advanced, artifacts, homoglyph, lexical, marks, provenance, structure
from glyphtrace.plans import catalogue, scan
from glyphtrace.sources.files import from_table


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


RUSSIAN = "Привет, это обычный русский текст для проверки системы. Здесь нет никаких знаков, кроме букв родного языка! Все хорошо и спокойно сегодня."


@pytest.mark.parametrize("text,want", [("abc", "normalized"), ("é", "non_nfd"), ("e\u0301", "non_nfc"), ("й", "non_nfd"), ("한", "non_nfd"), ("а", "normalized"), ("", "normalized"), (None, None)])
def test_normal_form(spark, text, want):
    assert one(spark, text, marks.normal_form) == want


def test_white_space_class_is_pythons():
    found = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), chars.WS) + "]")
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            assert bool(found.fullmatch(chr(c))) == chr(c).isspace() or not unicodedata.category(chr(c))


@pytest.mark.parametrize("text,levels,issues", [("#\n\nT", [1], 0), ("#x", [], None), ("# a\n## b\n### c\n## d", [1, 2, 3, 2], 0), ("## A", [2], 1), ("# a\n### b", [1, 3], 1), (None, None, None)])
def test_headings(spark, text, levels, issues):
    found = one(spark, text, structure.headings)
    assert (None if found is None else [h["level"] for h in found]) == levels
    assert one(spark, text, lambda t: structure.heading_issues(structure.headings(t))) == issues


@pytest.mark.parametrize("text,want", [("- a", "uniform"), ("- a\n* b", "mixed"), ("- \n* b", "mixed"), ("* * *", "uniform"), ("---", "none"), ("**b**", "none"), ("- ", "none")])
def test_lists(spark, text, want):
    assert one(spark, text, structure.list_uniformity) == want


FENCE = "```"


@pytest.mark.parametrize("text,want", [(f"{FENCE}py\na\n{FENCE}\nx\n{FENCE}py\nb\n{FENCE}", 2 / 3), (f"{FENCE}py\na\n{FENCE}", 1.0), (f"{FENCE}c++\na\n{FENCE}", None), (f"{FENCE}\na\n{FENCE}", 0.0), ("", None)])
def test_code_blocks(spark, text, want):
    got = one(spark, text, lambda t: structure.tagged_ratio(structure.code_blocks(t)))
    assert got == (pytest.approx(want) if want is not None else None)


def test_code_blocks_paired_fences(spark):
    text = f"{FENCE}py\na\n{FENCE}\nx\n{FENCE}py\nb\n{FENCE}"
    assert one(spark, text, lambda t: structure.tagged_ratio(structure.code_blocks(t, compat=False))) == 1.0


@pytest.mark.parametrize("line,want", list(zip(["# ok", "#  two", "#Bad", "#T", "##T", "#!/bin/sh", "#Bad ", "x\r", "#######"], [0, 0, 1, 0, 1, 1, 2, 1, 1])))
def test_spacing(spark, line, want):
    assert one(spark, line, structure.spacing_issues) == want


@pytest.mark.parametrize("text,want", [("was a test", [r"As a \w+"]), ("IN THE STYLE OF", ["In the style of"]), ("", [])])
def test_prompts(spark, text, want):
    assert one(spark, text, artifacts.prompt_leakage) == want


@pytest.mark.parametrize("text,want", [("<|im_end|>", [r"\|>"]), ("<[im_end]>", [r"<\[im_end\]>", r"<\["]), ("a || b", [r"\|\|"]), ("p\n\n<div>", [r"\n\n<"]), ("<END>", ["<END>"]), ("<end>", [])])
def test_end_tokens(spark, text, want):
    assert one(spark, text, artifacts.end_tokens) == want


def test_end_tokens_pipe_forms(spark):
    assert one(spark, "<|im_end|>", lambda t: artifacts.end_tokens(t, compat=False)) == [r"<\|im_end\|>", r"<\|", r"\|>"]


def test_namespace_and_structure(spark):
    text = 'xmlns:c2pa="http://c2pa.org/manifest"'
    assert one(spark, text, provenance.namespaces) == ["namespace:http://c2pa.org/"]
    assert "pattern:" + chars.STRUCTURAL[0] not in one(spark, text, provenance.structural)


def test_sentences(spark):
    stats = lambda t: one(spark, t, lambda c: lexical.sentence_stats(lexical.sentence_lengths(c)))
    same = stats("a b c d. e f g h. i j k l.")
    assert (same["sd"], same["mean"], same["spread"]) == (0.0, 4.0, 0)
    assert stats("a b c d.")["mean"] is None
    mixed = stats("a b c d e f g h. a b c d e. a b c d e f g h i j! a b c d e?")
    assert (mixed["mean"], mixed["median"]) == (7.0, 6.5) and mixed["sd"] == pytest.approx(2.449490, abs=1e-6)


def test_mattr_is_the_naive_one(spark):
    r = random.Random(1)
    for n in (1, 99, 100, 101, 350):
        w = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 4) for _ in range(n)]
        naive = sum(len(set(w[i : i + 100])) / 100 for i in range(n - 99)) / (n - 99) if n >= 100 else len(set(w)) / n
        got = spark.createDataFrame([(w,)], "w array<string>").select(lexical.mattr(F.col("w"))).first()[0]
        assert got == pytest.approx(naive)


def test_repeats_in_order_of_first_sight(spark):
    got = one(spark, "x a b c a b c z q a b c z q", lambda t: lexical.repeated_ngrams(F.split(t, " ")))
    assert [(g["ngram"], g["count"], g["first"]) for g in got] == [("a b c", 3, 1), ("b c z", 2, 5), ("c z q", 2, 6)]


def brute_suspicious(text):
    table, out = chars.homoglyphs(), []
    latin = lambda c: c.isascii() and c.isalnum()
    for p, c in enumerate(text):
        if c not in table:
            continue
        ctx = text[max(0, p - 100) : p + 101]
        la, hg = sum(map(latin, ctx)), sum(0x370 <= ord(x) <= 0x4FF for x in ctx)
        near = (p > 0 and latin(text[p - 1])) or (p + 1 < len(text) and latin(text[p + 1]))
        out.append((p, bool(la and hg / (la + hg) < 0.3 and re.search("[a-zA-Z0-9]{3}", ctx) and near)))
    return out


def test_homoglyph_context_over_blocks(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdef ghij  аоеαω.,") for _ in range(9000)) + "ы" * 300
    got = homoglyph.hits(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id long, t string"), "id", "t").select("position", "suspicious").collect()
    assert sorted(map(tuple, got)) == brute_suspicious(text)


def test_clustering_and_drift(spark):
    rows = [("a", [1.0, 0.0])] * 6 + [("b", [1.0, 2.0])] * 7 + [("c", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    got = {r["k"]: r["embedding_clustering"] for r in advanced.clustering(df, "k", "v").collect()}
    assert got["a"] == pytest.approx(0.8333, abs=1e-4) and got["b"] == pytest.approx(0.8571, abs=1e-4) and got["c"] is None
    fixed = {r["k"]: r["embedding_clustering"] for r in advanced.clustering(df, "k", "v", compat=False).collect()}
    assert fixed["a"] == pytest.approx(1.0)


def test_advanced_plug_ins(spark):
    def _tagger():
        return lambda text: [("NOUN" if w[0] < "m" else "VERB", "auxpass" if w == "was" else "x") for w in text.split()]

    def _embedder():
        return lambda texts: [[float(len(t) % 7 + 1), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "alpha beta was zebra. " * 60), (2, "short")], "id long, t string")
    got = advanced.measures(docs, "id", "t", _tagger, _embedder).collect()
    assert len(got) == 1 and 0 < got[0]["pos_ngrams"]["nn_ratio"] < 1 and got[0]["pos_ngrams"]["passive_ratio"] > 0 and got[0]["advanced_notes"] != list(advanced.MISSING.values())
    bare = advanced.measures(docs, "id", "t").first()
    assert bare["advanced_notes"] == list(advanced.MISSING.values()) and not bare["has_advanced_watermark"]


def test_foreign_text_notes(spark):
    rows = from_table(spark.createDataFrame([(1, RUSSIAN), (2, None), (3, "")], "id long, t string"), "id", "t")
    got = {r["file"]: r for r in scan.scan_texts(rows).collect()}
    assert got["1"]["suspicious_homoglyphs"] == [] and any("legitimate" in n for n in got["1"]["notes"]) and got["1"]["unicode_normalization"] == "non_nfd"
    assert got["3"]["has_watermark"] is False and got["2"]["has_watermark"] is None or got["2"]["has_watermark"] is False
    mended = scan.scan_texts(rows, replace(DEFAULT, compat=False)).where("file = '1'").first()
    assert not any("Unicode" in n for n in mended["notes"])


def test_repeated_and_null_names_keep_their_own_letters(spark):
    latin = "A perfectly plain text in which one l\u043etter is not what it seems to be at all, and that is that. " * 2
    df = spark.createDataFrame([(1, RUSSIAN), (1, latin), (None, latin), (None, RUSSIAN)], "id long, t string")
    got = [(r["file"], len(r["homoglyphs"]) > 50, len(r["suspicious_homoglyphs"])) for r in scan.scan_texts(from_table(df, "id", "t")).collect()]
    assert sorted(got, key=str) == sorted([("1", True, 0), ("1", False, 2), (None, False, 2), (None, True, 0)], key=str)


def test_notes_in_the_published_form(spark):
    text = "You are a cat. " + "don't do it now \u202e x \U0001d400 \U000e0041 y " * 2 + "a || b\n\n<p>" + " z" * 40
    notes = scan.scan_texts(from_table(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")).first()["notes"]
    assert notes[:4] == ["Bidi override chars: ['\\u202e']", "Math alphabetic chars: ['U+1D400', 'U+1D400']", "Tag characters: ['U+0E0041', 'U+0E0041']", "Prompt leakage: ['You are a \\\\w+']"]
    assert notes[4].startswith("""Unusual token repetition: ["don't do it", 'do it now', """) and notes[5] == "EOS patterns: ['\\\\n\\\\n<', '\\\\|\\\\|']"


def test_common_phrases_of_the_fixed_mode(spark):
    text = "part of the one part of the two in the end we saw in the end we left " + "and here are many other words that stand once only in all of these lines so nothing else comes back"
    rows = from_table(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    note = lambda c: [n for n in scan.scan_texts(rows, c).first()["notes"] if n.startswith("Unusual")]
    assert note(DEFAULT) == ["Unusual token repetition: ['part of the', 'in the end', 'the end we']"]
    assert note(replace(DEFAULT, compat=False)) == ["Unusual token repetition: ['the end we']"]


def test_unreadable_files_are_found(spark):
    rows = [("x.png", None, None, "no access"), ("y.txt", None, None, "no access"), ("z.txt", 5, bytearray(b"clean"), None)]
    got = {r["file"]: r for r in scan.findings(scan.scan_files(spark.createDataFrame(rows, "path string, length long, content binary, error string"))).collect()}
    assert set(got) == {"x.png", "y.txt"} and all(r["error"] == "no access" and r["notes"] == [scan.FAILED] and not r["has_watermark"] for r in got.values())
    assert got["x.png"]["binary_error"] == "no access" and got["y.txt"]["binary_error"] is None


def test_files_by_time_and_cells_of_the_report(spark, tmp_path):
    import os

    from glyphtrace.report import cell
    from glyphtrace.sources.files import files

    for name, at in (("old.txt", 1_000_000_000), ("new.txt", 1_900_000_000)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (at, at))
    for hidden in (False, True):
        assert [r["path"].rsplit("/", 1)[1] for r in files(spark, str(tmp_path), hidden, "2026-08-02").collect()] == ["new.txt"]
    assert cell("a|b\nc\\") == "a\\|b c\\\\" and cell(None) == ""


def test_bytes(spark):
    got = {r["file"]: r for r in scan.scan_files(catalogue.literal_files(spark)).collect()}
    kinds = {k: v["file_type"] for k, v in got.items()}
    assert kinds == {"png_min.png": "png", "png_bad.png": "png", "png_fixed.png": "png", "jumbf_c2pa": "jpg", "jumbf_tail": "jpg", "jumbf_only": "jpg", "c2pa_only": "jpg", "nul_text": "binary", "bom_text": "text", "empty": "text", "latin.txt": "text"}
    hit = {k for k, v in got.items() if v["binary_c2pa_detected"]}
    assert hit == {"png_bad.png", "jumbf_c2pa"}
    assert got["jumbf_tail"]["jumbf_found"] and not got["jumbf_tail"]["c2pa_brand_found"] and got["jumbf_only"]["notes"] == ["JUMBF container detected"]
    assert got["bom_text"]["zero_width"] == {"U+FEFF": 1}
    fixed = {r["file"]: r["binary_c2pa_detected"] for r in scan.scan_files(catalogue.literal_files(spark), replace(DEFAULT, compat=False)).collect()}
    assert fixed["png_fixed.png"] and fixed["jumbf_tail"]
    assert scan.exit_code(scan.scan_files(catalogue.literal_files(spark))) == 1


def test_cli_stream_and_report(spark, tmp_path, capsys):
    from glyphtrace.cli import main
    from glyphtrace.streaming.files import scan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello\u200b world")
    (tmp_path / "in" / "_b.txt").write_text("clean")
    (tmp_path / "in" / ".c.txt").write_text("\u200b")
    assert main([str(tmp_path / "in")], spark) == 1
    assert "U+200B" in (out := capsys.readouterr().out) and ".c.txt" not in out
    assert main([str(tmp_path / "in" / "_b.txt"), "--json"], spark) == 0
    assert '"has_watermark":false' in capsys.readouterr().out
    assert main([str(tmp_path / "nothing")], spark) == 0
    scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("has_watermark").count() == 1


def test_sql_functions(spark):
    assert len(sql.register(spark)) > 8
    row = spark.sql("SELECT zero_width_count('a\u200bb'), type_token_ratio('a b a'), has_prompt_leakage('please compose it'), line_count('a\nb')").first()
    assert tuple(row) == (1, pytest.approx(2 / 3), True, 2)


@pytest.mark.parametrize("name", ["zero_width_counts", "homoglyph_suspicious", "mattr", "repeated_trigrams", "heading_issues", "statistical_rollup", "ngram_kl_vs_baseline", "surrounding_context", "binary_jumbf", "png_chunks", "decode_fallback"])
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({catalogue.ORACLE[name]})").fetchall()
    form = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert form(got.select(*(F.col(f"`{c}`") for c in cols)).collect()) == form(want)
