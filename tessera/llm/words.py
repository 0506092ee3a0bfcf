"""Normalised words of a text, with their places in the original."""

from __future__ import annotations

import re
import sys
import unicodedata

WORD = re.compile(r"[^\W_]+")
#: characters without a visible form: format characters, joiners, variation selectors
_INVISIBLE = {c: None for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"} | {0x034F: None} | {c: None for c in range(0xFE00, 0xFE10)}
_BREAK = re.compile(r"(?<=[^\W_])[-­‐‑](?:\r\n|\n|\r| |\u0085)[ \t]*(?=[^\W_])")


def normalized(text: str) -> str:
    """Case, width and invisible characters taken away; words divided at a line end joined."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", text).casefold().replace("­", "-" if "­\n" in text or "­\r" in text else "").translate(_INVISIBLE)
    return _BREAK.sub("", text) if "\n" in text or "\r" in text or " " in text or "\u0085" in text else text


def words(text: str | None) -> list[str]:
    return WORD.findall(normalized(text or ""))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Each normalised word with the half-open range of original characters it came from.

    Characters are normalised in clusters of a base and its marks, so that a
    range never ends within one.
    """
    out, place = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFKC", text[i:j]).casefold()
        if piece == "­":
            piece = "-" if text[j : j + 1] in ("\n", "\r") else ""
        piece = piece.translate(_INVISIBLE)
        out.append(piece)
        place += [(i, j)] * len(piece)
        i = j
    flat = "".join(out)
    keep, last = [], 0
    for hit in _BREAK.finditer(flat):
        keep += range(last, hit.start())
        last = hit.end()
    keep += range(last, len(flat))
    joined = "".join(flat[k] for k in keep)
    return [(m.group(0), place[keep[m.start()]][0], place[keep[m.end() - 1]][1]) for m in WORD.finditer(joined)]
