"""The marked corpus: documents rewritten by ``doc_id % 16`` so that every mark occurs, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
#: doc_id % 16: ("replace", from, to), ("before", text) and ("after", text), in order.
REWRITES: dict[int, list[tuple[str, ...]]] = {
    0: [("replace", "a", "а")],
    1: [("replace", " th", " тh")],
    2: [("replace", "o", "о x")],
    3: [("before", "привет мир " * 12)],
    4: [("replace", ". ", ". ​"), ("before", "﻿")],
    5: [("replace", ",", ",️")],
    6: [("before", "‮"), ("after", "‬")],
    7: [("after", "\U0001d400\U000e0041")],
    8: [("before", "# A\n\n## B\n\n### C\n\n## D\n\n")],
    9: [("before", "## A\n#### B\n")],
    10: [("before", "- a\n- b\n")],
    11: [("before", "- a\n* b\n")],
    12: [("before", f"{FENCE}py\nx = 1\n{FENCE}\ntext\n{FENCE}\ny\n{FENCE}\n")],
    13: [("before", '<x xmlns:c2pa="http://c2pa.org/"><c2pa:manifest/>')],
    14: [("replace", "\n", "  \n"), ("after", "<|im_end|> a || b\n\n<p> Generated by hand")],
}


def text_column(doc_id: Column, text: Column) -> Column:
    out = None
    for k, steps in REWRITES.items():
        t = text
        for kind, *args in steps:
            t = F.replace(t, F.lit(args[0]), F.lit(args[1])) if kind == "replace" else F.concat(F.lit(args[0]), t) if kind == "before" else F.concat(t, F.lit(args[0]))
        out = F.when(doc_id % 16 == k, t) if out is None else out.when(doc_id % 16 == k, t)
    return out.otherwise(text)


def text_sql(doc_id: str = "doc_id", text: str = "text") -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = []
    for k, steps in REWRITES.items():
        t = text
        for kind, *args in steps:
            t = f"replace({t}, {q(args[0])}, {q(args[1])})" if kind == "replace" else f"({q(args[0])} || {t})" if kind == "before" else f"({t} || {q(args[0])})"
        cases.append(f"WHEN {k} THEN {t}")
    return f"CASE {doc_id} % 16 " + " ".join(cases) + f" ELSE {text} END"
