"""Canonical words of a text: the unit that every comparison of texts here counts in.

A word is a run of letters and digits. Case, punctuation, spacing, markup, invisible characters
and look-alike letters never make a difference.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "А": "a", "в": "b", "В": "b", "е": "e", "Е": "e", "ё": "e", "к": "k", "К": "k", "м": "m", "М": "m",
    "н": "h", "Н": "h", "о": "o", "О": "o", "р": "p", "Р": "p", "с": "c", "С": "c", "т": "t", "Т": "t",
    "у": "y", "У": "y", "х": "x", "Х": "x", "ѕ": "s", "Ѕ": "s", "і": "i", "І": "i", "ї": "i", "ј": "j", "Ј": "j",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
    "α": "a", "Α": "a", "Β": "b", "ε": "e", "Ε": "e", "Η": "h", "ι": "i", "Ι": "i", "κ": "k", "Κ": "k", "Μ": "m",
    "ν": "v", "Ν": "n", "ο": "o", "Ο": "o", "ρ": "p", "Ρ": "p", "τ": "t", "Τ": "t", "υ": "u", "Υ": "y", "χ": "x", "Χ": "x", "Ζ": "z",
}
# Characters that show nothing, as the inside of a character class.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻"

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_TABLE = str.maketrans(LOOKALIKES)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]{2,8});")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]*)\)")
_WORD = re.compile(r"[^\W_]+")


def visible(text: str) -> str:
    """``text`` without invisible characters and markup, with look-alike letters made Latin; case is kept."""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _LOOKALIKE.search(text):
            text = _lookalike(text)
    if "<" in text:
        if "<!--" in text:
            text = _uncommented(text)
        text = _TAG.sub(" ", text)
    if "&" in text and ";" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    return text


def _uncommented(text: str) -> str:
    """``text`` with a space for each comment; one without an end stays."""
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = end + 3
    return " ".join([*out, text[at:]])


def _lookalike(text: str) -> str:
    """Only words that also hold Latin letters are mapped, unless no Latin letter is in the text at all."""
    if not re.search("[A-Za-z]", text):
        return text
    return text.translate(_TABLE)


def words(text: str | None) -> list[str]:
    """The canonical words of ``text``; an empty list for null, blank and wordless texts."""
    if not text:
        return []
    return _WORD.findall(visible(text).lower())
