"""Character sets and patterns. Every pattern stays within what Java and RE2 both read."""

from __future__ import annotations

import unicodedata

# The published sets and patterns, in their published order.
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
VARIATION_SELECTORS = (0xFE00, 0xFE0F)
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
MATH_ALPHANUMERIC = (0x1D400, 0x1D7FF)
TAG_CHARACTERS = (0xE0000, 0xE007F)
HOMOGLYPH_RANGES = [(0x0400, 0x04FF), (0x0370, 0x03FF)]
HOMOGLYPHS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch",
    "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "h", "θ": "th",
    "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "f", "χ": "ch", "ψ": "ps",
    "ω": "w",
}
NAMESPACE_URLS = ["http://c2pa.org/", "https://c2pa.org/", "http://ns.c2pa.org/", "https://ns.c2pa.org/"]
STRUCTURAL = [
    r'xmlns\s*:\s*c2pa\s*=\s*["\']http[s]?://(ns\.)?c2pa\.org/["\']',
    r'xmlns\s*=\s*["\']http[s]?://(ns\.)?c2pa\.org/["\']',
    "c2pa:manifest",
    "c2pa:assertion",
    "c2pa:signature",
    "c2pa:claim",
    "c2pa:generator",
    "c2pa:action",
    "c2pa:relationship",
    "<manifest[^>]*xmlns[^>]*c2pa",
    "<c2pa:manifest",
    r"c2pa\.hash",
    r"c2pa\.signature",
    "c2pa:hash",
    "c2pa:signature",
]
LEGACY = ["c2pa:", "provenance", "xmp:"]
PNG_CHUNKS = ["c2pa", "prvn", "meta"]
PROMPTS = [
    r"As a \w+",
    r"Write a \w+",
    "Please compose",
    r"Create a \w+",
    r"You are a \w+",
    r"Act as a \w+",
    "I need you to",
    "Your task is to",
    "In the style of",
    "Using the following",
    "Based on the",
    "Given the",
    "Make sure to",
    "Ensure that",
    "The following is",
]
END_TOKENS = [r"<\[im_end\]>", r"<\[im_start\]>", "<EOS>", "<END>", r"\n\n<", r"\|\|", r"<\[", r"\|>"]
END_TOKENS_FIXED = [r"<\|im_end\|>", r"<\|im_start\|>", "<EOS>", "<END>", r"\n\n<", r"\|\|", r"<\|", r"\|>"]
COMMON_PHRASES = ["of the", "in the", "to the", "with the", "for the"]
ATTRIBUTION = ["Generated by", "Created by", "Model:", "AI-generated", "X-Generated-By"]
TEXT_EXTENSIONS = ["txt", "md", "html", "htm", "json", "xml", "yaml", "yml", "css", "js"]

#: White space as Python's ``str.split`` takes it, the inside of a class.
WS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}_]"


def homoglyphs() -> dict[str, str]:
    """Look-alike letter to its Latin value."""
    return HOMOGLYPHS


def class_of(points) -> str:
    """The inside of a character class for sorted code points."""
    out, points = [], sorted(points)
    start = end = None
    for p in [*points, None]:
        if end is not None and p == end + 1:
            end = p
            continue
        if start is not None:
            out.append(f"\\x{{{start:X}}}" + (f"-\\x{{{end:X}}}" if end > start else ""))
        start = end = p
    return "".join(out)


def _canonical(c: int) -> bool:
    return bool(unicodedata.decomposition(chr(c))) and not unicodedata.decomposition(chr(c)).startswith("<") or 0xAC00 <= c <= 0xD7A3


_POINTS = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
#: Characters that NFD takes apart.
DECOMPOSABLE = class_of(c for c in _POINTS if _canonical(c))
#: Characters without which a text is in NFC for certain.
NFC_DOUBT = class_of(c for c in _POINTS if unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c) or 0x1160 <= c <= 0x11FF)


def java(pattern: str) -> str:
    """A published pattern for Spark: Python's white space and word characters spelt out."""
    return pattern.replace("[^\\s]", f"[^{WS}]").replace("\\s", f"[{WS}]").replace("\\w", WORD)
