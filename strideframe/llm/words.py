"""Word splitting on UTF-8 bytes, and stable 64-bit word hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z; every byte that is no ASCII letter or digit to a space; bytes of other characters stay.
ALNUM = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return raw(text).translate(ALNUM).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; null has none."""
    return raw(text).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, alike in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
