"""Words and letter n-grams of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = 32


def _fold(keep_digits: bool) -> np.ndarray:
    """ASCII letters in lower case, bytes of other scripts as they are, all else a space."""
    out = np.full(256, SPACE, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalpha() or (keep_digits and chr(c).isdigit()):
            out[c] = ord(chr(c).lower()) if c < 128 else c
    return out


def _plain() -> np.ndarray:
    """A-Z in lower case, ASCII white space a space, every other byte as it is."""
    out = np.arange(256, dtype=np.uint8)
    out[9:14] = SPACE
    out[ord("A") : ord("Z") + 1] += 32
    return out


_WORDS, _LETTERS, _PLAIN = _fold(True), _fold(False), _plain()
#: As the plain table, but capitals stay.
EXACT = np.where(_PLAIN == SPACE, np.uint8(SPACE), np.arange(256, dtype=np.uint8))
#: Bytes worked on at once; the arrays of a longer text are made piece by piece.
_PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; those of a piece are kept, those of a longer word are not."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _PIECE + 2), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= _PIECE + 2:
            _powers[base] = have
    return have[:n]


def joined(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts, each between spaces, and where each text begins (one more: the end).

    In lower case, but for the plain tables.
    """
    raw = [t.encode() for t in texts] if table is _PLAIN or table is EXACT else [t.lower().encode() for t in texts]
    starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    x = table[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)] if raw else np.full(1, SPACE, np.uint8)
    return x, starts


def parts(texts: list[str], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text is a range of its own."""
    out, first, n = [], 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            out.append((first, i))
            first, n = i, 0
        n += len(t)
    return [*out, (first, len(texts))] if texts else []


def pieces(x: np.ndarray, most: int = _PIECE) -> list[tuple[int, int]]:
    """Ranges of folded bytes of at most `most` where words allow it; each begins and ends with a space, that of its neighbour."""
    out, first = [], 0
    while len(x) - first > most:
        back = np.flatnonzero(x[first + 1 : first + most] == SPACE)
        if len(back):
            last = first + 1 + int(back[-1])
        else:  # a longer word
            last = first + most
            while last < len(x) - 1 and not len(ahead := np.flatnonzero(x[last : last + most] == SPACE)):
                last += most
            last = min(len(x) - 1, last + int(ahead[0]))
        out.append((first, last + 1))
        first = last
        if first >= len(x) - 1:
            return out
    return [*out, (first, len(x))]


def word_hashes(texts: list[str], prefixes: tuple[int, ...] = (), table: np.ndarray = _WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word of every text, and where each text's words begin (one more: the end).

    Of each word the first column has the whole, the others its first so many bytes; 0 where it isn't longer than that.
    """
    _, begin, _, out, starts = located_words(texts, prefixes, table)
    return out, np.searchsorted(begin, starts)


def located_words(texts: list[str], prefixes: tuple[int, ...], table: np.ndarray) -> tuple[np.ndarray, ...]:
    """The folded bytes of texts, where words begin and end in them, their hashes, and where texts begin."""
    x, starts = joined(texts, table)
    found = [(a, *_hashes_of(x[a:b], prefixes)) for a, b in pieces(x)]
    begin, end = (np.concatenate([f[k] + f[0] for f in found]) for k in (1, 2))
    return x, begin, end, np.concatenate([f[3] for f in found]), starts


def _hashes_of(x: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a piece begin and end, and their hashes."""
    inside = x != SPACE
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = change[::2], change[1::2]
    if len(begin) > len(end):
        end = np.append(end, len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(x)), out=total[1:])
    inverse = _power(_INVERSE, len(x))[begin]
    out = np.zeros((len(begin), 1 + len(prefixes)), np.uint64)
    for c, most in enumerate((0, *prefixes)):
        to = np.minimum(begin + most, end) if most else end
        h = (total[to] - total[begin]) * inverse + np.uint64(c)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[:, c] = np.where(end - begin > most, h, np.uint64(0))
    return begin, end, out


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's shingles of `width` words, repeats included, and where each text's begin (one more: the end).

    Words are what ASCII white space separates, A-Z lower-cased. A text of fewer words is one shingle, one without words has none.
    """
    words, first = word_hashes(texts, (), _PLAIN)
    h, n = words[:, 0], np.diff(first)
    by = [np.uint64(pow(_BASE, j + 1, 1 << 64)) for j in range(width)]
    out = np.zeros(len(h), np.uint64)
    for j in range(min(width, len(h))):
        out[: len(h) - j] += h[j:] * by[j]
    short = np.flatnonzero((n > 0) & (n < width))
    at = first[:-1][short]
    alone = np.zeros(len(short), np.uint64)
    for j in range(width):
        alone += np.where(j < n[short], h[np.minimum(at + j, len(h) - 1)] * by[j], np.uint64(0)) if len(h) else np.uint64(0)
    out[at] = alone
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = out[np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out, bounds


def letter_trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of byte trigrams within words and across their edges, the word number of each, the first word of each text.

    The last has one more entry, the number of words.
    """
    x, starts = joined(texts, _LETTERS)
    found, words = [], 0
    for a, b in pieces(x):
        bucket, word, n = _trigrams_of(x[a:b], buckets)
        found.append((bucket, word + words))
        words += n
    inside = x != SPACE
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.searchsorted(first, starts)


def _trigrams_of(x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a piece's trigrams, the word number of each, and the number of words."""
    inside = x != SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word = np.cumsum(first, dtype=np.int32) - np.int32(1)
    y = x.astype(np.uint32)
    gram = (y[:-2] << np.uint32(16)) | (y[1:-1] << np.uint32(8)) | y[2:]
    keep = inside[1:-1]  # the middle byte is a letter: a word of n bytes has n trigrams
    h = gram[keep] * np.uint32(2654435761)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32), word[1:-1][keep], int(first.sum())
