"""Word and n-gram hashes of many texts at once, over their UTF-8 bytes.

A word is a run of ASCII letters and digits and of characters outside ASCII, in lower case.
"""

from __future__ import annotations

import re

import numpy as np

#: Characters hashed at once: the working arrays take some 50 bytes for each.
AT_ONCE = 1 << 20
BETWEEN = re.compile("[^A-Za-z0-9\\u0080-\\U0010ffff]")

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A number of its own for each byte that words may have; 0 for the others.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
IN_WORD[128:] = True
BYTES = np.where(IN_WORD, BYTES, np.uint64(0))
STEPS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds: text k has words bounds[k]:bounds[k + 1])"""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]
    powers = np.full(len(data) + 1, BASE)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers[:-1], out=sums[1:])
    powers[1:] = BACK
    np.cumprod(powers, out=powers)
    words = mixed((sums[stops] - sums[starts]) * powers[starts])
    ends = np.cumsum([len(r) + 1 for r in raw])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; a text of fewer words is one run."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * STEPS[k]
    return mixed(out)


def portions(texts: list[str]) -> list[list[str]]:
    """texts in runs of at most AT_ONCE characters; a longer text is a run of its own."""
    out, size = [], 0
    for t in texts:
        if not out or size + len(t) > AT_ONCE:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def long_words(text: str) -> np.ndarray:
    """The word hashes of a text of any length, by stretches that end between words."""
    out, at = [], 0
    while at < len(text):
        m = BETWEEN.search(text, at + AT_ONCE)
        stop = m.end() if m else len(text)
        out.append(word_hashes([text[at:stop]])[0])
        at = stop
    return np.concatenate(out)


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's set of n-gram hashes, ascending."""
    out = []
    for own in portions(texts):
        if len(own[0]) > AT_ONCE:
            out.append(np.unique(ngram_hashes(long_words(own[0]), n)))
            continue
        words, bounds = word_hashes(own)
        out += [np.unique(ngram_hashes(words[a:b], n)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out
