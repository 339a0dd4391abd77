"""Texts of an Arrow batch as word hashes, computed on the batch's bytes."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np

SLICE_CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
# A tag opens with a letter, a slash or a declaration sign; it may be of any length.
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&#?\w+;")


def _ascii_table() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


_TABLE = _ascii_table()


@lru_cache(maxsize=100_000)
def _plain(run: str) -> str:
    """A run of non-ASCII characters: width and accents gone, signs as blanks."""
    out = []
    for ch in unicodedata.normalize("NFKD", run).casefold():
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me", "Cf"):
            continue
        out.append(ch if kind[0] in "LNM" or ch.isascii() else " ")
    return "".join(out)


def plain_bytes(text: str) -> bytes:
    """Lower-case words separated by blanks: no markup, accents or punctuation."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: _plain(m[0]), text)
    return text.encode("utf-8", "replace").translate(_TABLE)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
                cls.down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        return cls.up, cls.down


def hashed_words(plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds of each text's words).

    Equal words have equal hashes.  Long texts are hashed in parts, so what is
    held beside the hashes stays bounded.
    """
    if sum(map(len, plain)) <= 4 * SLICE_CHARS:
        return _hashed(plain)
    words, counts = [], []
    for text in plain:
        count, at = 0, 0
        while at < len(text):
            end = text.find(b" ", at + SLICE_CHARS)
            end = len(text) if end < 0 else end
            part, _ = _hashed([text[at:end]])
            words.append(part)
            count, at = count + len(part), end
        counts.append(count)
    return np.concatenate([np.zeros(0, dtype=np.uint64), *words]), np.cumsum([0, *counts])


def _hashed(plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for one slice.  The hash is a polynomial one, taken from prefix
    sums, so a slice costs a few passes over its bytes."""
    joined = b" " + b" ".join(plain) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = _Powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)])])
        words = (sums[ends] - sums[starts]) * down[starts]
        words ^= words >> np.uint64(32)
        words *= np.uint64(0xD6E8FEB86659FD93)
        words ^= words >> np.uint64(32)
    first = np.cumsum([0, *(len(p) + 1 for p in plain)]) + 1
    return words, np.searchsorted(starts, first)


def text_slices(texts: list[str | None]) -> list[tuple[int, int]]:
    """Ranges of texts of some two million characters each, at least one text."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            out.append((start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out
