"""Word shingles of many texts at once, hashed to 64 bits, in numpy."""

from __future__ import annotations

import numpy as np

from charlspark.llm.suffix_dedup import BASE, ODD, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """text number and hash of each word, A-Z lower-cased."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    s = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    gap = np.concatenate([[True], GAP[s], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    a, b = edges[::2], edges[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(s)), dtype=np.uint64)])
    inverse = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(s) + 1)
    return np.searchsorted(np.cumsum(lengths), a, "right"), mixed((total[b] - total[a]) * inverse[a])


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """counts, hashes: for each text its distinct shingles of width words, ascending, one text after the other. A text of
    fewer words has its whole sequence as one; one without words has none."""
    text, w = word_hashes(texts)
    n_words = np.bincount(text, minlength=len(texts))
    factor = [mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(width)]
    padded = np.concatenate([w, np.zeros(width, np.uint64)])
    owner = np.concatenate([text, np.full(width, -1)])
    h = np.zeros(len(w), np.uint64)
    whole = np.ones(len(w), bool)
    for k in range(width):
        own = owner[k : k + len(w)] == text
        h += np.where(own, padded[k : k + len(w)] * factor[k], np.uint64(k + 1))
        whole &= own
    first = np.zeros(len(w), bool)
    first[np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(w) else []] = True
    used = whole | (first & (n_words[text] < width))
    h, text = mixed(h[used]), text[used]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=len(texts)), h[new]
