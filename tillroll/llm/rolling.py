"""Word spans and rolling hashes of byte texts by prefix polynomials."""

from __future__ import annotations

import numpy as np

from .common import U64, mix

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; longer ones are computed for the call.
_KEPT = 1 << 20


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` modulo 2 ** 64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        held = _POWERS.get(b, np.empty(0, U64))
        if len(held) < n:
            with np.errstate(over="ignore"):
                held = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n + n // 8, b, U64))])
            if n <= _KEPT:
                _POWERS[b] = held
        out.append(held[:n])
    return out[0], out[1]


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value[i] * base ** i, and the inverse powers that shift them back."""
    up, down = powers(len(values) + 1, base)
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:-1], out=out[1:])
    return out, down


def span_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of buf[lo:hi] for every span."""
    total, down = _prefix(buf.astype(U64) + U64(1), base)
    with np.errstate(over="ignore"):
        return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of every n neighbouring word hashes (not mixed)."""
    if len(words) < n:
        return np.empty(0, U64)
    total, down = _prefix(words, base)
    with np.errstate(over="ignore"):
        return (total[n:] - total[:-n]) * down[: len(words) - n + 1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the words of a text whose words are joined by one space."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return np.concatenate([[0], blank + 1]), np.append(blank, len(data))


def words_of(text: str | None, hashes: bool = True) -> tuple[bytes, np.ndarray]:
    """The text's words joined by one space, and their hashes.

    Long texts are hashed in slices that end at a space, so arrays stay small.
    """
    data = b" ".join((text or "").encode().split())
    if not hashes or not data:
        return data, np.empty(0, U64)
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + (1 << 20)) if len(data) - at > 1 << 20 else -1
        piece = data[at:end] if end > 0 else data[at:]
        lo, hi = word_spans(piece)
        parts.append(span_hashes(np.frombuffer(piece, np.uint8), lo, hi))
        at = end + 1 if end > 0 else len(data)
    return data, np.concatenate(parts)
