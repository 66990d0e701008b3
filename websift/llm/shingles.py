"""Word shingles and MinHash signatures of a batch of texts, vectorised with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: 36 bands of 5 values: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**36 < 1e-6.
BANDS, BAND_ROWS = 36, 5
HASHES = BANDS * BAND_ROWS

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_K = np.uint64(0xD6E8FEB86659FD93)


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(32))) * _K
    x = (x ^ (x >> np.uint64(32))) * _K
    return x ^ (x >> np.uint64(32))


def shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingle hashes of text i are hashes[offsets[i]:offsets[i + 1]], in text order.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``; a shingle is five words in a row.  A text of one to
    four words has one shingle of all its words; null, empty and blank texts have none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    blank = _BLANK[buf]
    change = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start, end = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    # a word's hash: its bytes as a polynomial modulo 2**64, from running sums over the whole buffer
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(buf)), dtype=np.uint64)))
    back = _powers(pow(_P, -1, 1 << 64), len(buf))
    word = mix((running[end] - running[start]) * back[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(ends_of_text, start, side="right")
    counts = np.bincount(text, minlength=len(raw))
    n = len(word) - WORDS + 1
    if n > 0:
        h = word[:n].copy()
        for k in range(1, WORDS):
            h = mix(h) * _K + word[k:k + n]
        whole = text[:n] == text[WORDS - 1:]
        h, of = mix(h[whole]), text[:n][whole]
    else:
        h, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))
        extra = []
        for i in short:
            x = np.array([counts[i]], dtype=np.uint64)
            for w in word[first[i]:first[i + 1]]:
                x = mix(x) * _K + w
            extra.append(x)
        h, of = np.concatenate((h, mix(np.concatenate(extra)))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(raw)))))


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits of each minimum), one row of ``HASHES`` per text; texts without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    starts = offsets[:-1][full]
    multipliers = np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k, a in enumerate(multipliers):
        out[full, k] = (mix(np.minimum.reduceat(h * a, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and text."""
    parts = sigs.reshape(len(sigs), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix(key) * _K + parts[:, :, k]
    return mix(key).view(np.int64)
