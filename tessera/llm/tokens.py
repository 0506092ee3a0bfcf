"""Tokens of a public tokenizer: byte-level BPE, loaded once a Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: where the vocabulary files lie; a parameter of every operator that counts tokens
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    widths = np.zeros(max(ranks.values()) + 1, np.int32)
    for piece, rank in ranks.items():
        widths[rank] = len(piece)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def count(text: str, path: str = VOCABULARY) -> int:
    """Number of tokens; a lone surrogate counts as a replacement character."""
    return len(ids(text, path))


def ids(text: str, path: str = VOCABULARY) -> list[int]:
    return _encoding(path)[0].encode_ordinary(text)


def byte_ends(tokens: list[int], path: str = VOCABULARY) -> np.ndarray:
    """The byte of the UTF-8 text after each token."""
    return np.cumsum(_encoding(path)[1][np.asarray(tokens, np.int64)])


def char_starts(text: str) -> np.ndarray | None:
    """Byte at which each character begins, and the end; None where a character is a byte."""
    if text.isascii():
        return None
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.append(np.nonzero((raw & 0xC0) != 0x80)[0], len(raw))


@lru_cache(maxsize=4)
def word_starts(path: str = VOCABULARY) -> np.ndarray:
    """For each token whether it begins with white space, so that a cut before it divides no word."""
    encoding, widths = _encoding(path)
    out = np.zeros(len(widths), bool)
    for token in range(len(widths)):
        if widths[token]:
            out[token] = encoding.decode_single_token_bytes(token)[:1] in (b" ", b"\n", b"\t", b"\r")
    return out
