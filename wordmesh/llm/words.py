"""Normalized words and hashes of word n-grams, a slice of texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from wordmesh.llm.common import mix

WORD = re.compile(r"\w+")
_known: dict[str, int] = {}
_KNOWN_MOST = 100_000


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) >= _KNOWN_MOST:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word.encode())
    return h


def lower(text: str) -> str:
    """A text in lower case, character by character, so that it stays as long as it was.

    Only the dotted capital I grows by Python's rules, and only a capital sigma depends on what stands around it.
    """
    if "\u0130" in text or "\u03a3" in text:
        text = text.replace("\u0130", "i").replace("\u03a3", "\u03c3")
    return text.lower()


def split(text: str | None) -> list[str]:
    """The words of a text in lower case; none for null."""
    return WORD.findall(lower(text)) if text else []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text after another, and the number of words of each text."""
    n, parts = np.zeros(len(texts), np.int64), []
    get = _known.get
    for i, t in enumerate(texts):
        w = split(t)
        n[i] = len(w)
        if w:
            h = list(map(get, w))
            if None in h:
                h = [_hash(x) if y is None else y for x, y in zip(w, h)]
            parts.append(np.array(h, dtype=np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), n


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    m = max(0, len(h) - n + 1)
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g = mix(g + h[k : k + m] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
    return g
