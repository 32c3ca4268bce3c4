"""Sets of 5-word shingles as sorted 64-bit hashes, and an exact bound on how far two sets differ."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(WORDS)]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first bytes of a little-endian number of 8, by their count.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _mixed(x):
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _word_hashes(text: bytes):
    """Where the words of a text begin, and their hashes: of a word's length and, 8 bytes at a time, of all of it."""
    text = b" " + text + b" " * 8
    space = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, length = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    out = _mixed((eights[begin] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * _PLACES[0])
    at, more = 8, np.flatnonzero(length > 8)
    while len(more):
        left = length[more] - at
        out[more] = _mixed(out[more] * _PLACES[1] + (eights[begin[more] + at] & _FIRST[np.minimum(left, 8)]))
        at, more = at + 8, more[left > 8]
    return begin - 1, out


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashes of each whole UTF-8 text's 5-word shingles, told apart; of fewer words, one hash of them all."""
    texts = [t or b"" for t in texts]
    begin, words = _word_hashes(b" ".join(texts).translate(_LOWER))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(begin, ends).tolist()
    # shingles of each place, those across two texts included
    every = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        every = sum(words[i : len(words) - WORDS + 1 + i] * p for i, p in enumerate(_PLACES))
        every = _mixed(every)
    out, lo = [], 0
    for hi in last:
        n = hi - lo
        if n >= WORDS:
            s = np.sort(every[lo : hi - WORDS + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = words[lo:hi]
            if n:
                s = _mixed(np.sum(s * _PLACES[:n], keepdims=True) + np.uint64(n))
        out.append(s)
        lo = hi
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([(text or "").encode("utf-8", "surrogatepass")])[0]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit name of the set."""
    name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def odd_sketch(s: np.ndarray) -> bytes:
    """For each of 2^k >= |s| classes of hashes, whether the set holds an odd number of them."""
    bits = max(64, 1 << max(0, int(len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the size of the symmetric difference: classes whose parities differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _folded(m: np.ndarray) -> np.ndarray:
    half = m.shape[1] // 2
    return m[:, :half] ^ m[:, half:]


def differences_within(sketches: list[bytes], sizes: np.ndarray, of: np.ndarray):
    """(i, others, lower bounds on the symmetric differences) for each i in ``of`` and the sets whose sizes are within 4 to 5 of its.

    A sketch is compared with those of its own length, and of half and twice the length, as rows of a matrix;
    the longer one is folded first.
    """
    lengths = np.array([len(x) for x in sketches])
    rows = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    whole = {n: np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), -1) for n, own in rows.items()}
    for i in of:
        n, mine = int(lengths[i]), np.frombuffer(sketches[i], np.uint64)[None, :]
        for m in (n // 2, n, 2 * n):
            if m not in rows:
                continue
            j = rows[m]
            close = (5 * np.minimum(sizes[i], sizes[j]) >= 4 * np.maximum(sizes[i], sizes[j])) & (j != i)
            if close.any():
                theirs = whole[m][close]
                a, b = (_folded(mine), theirs) if m < n else (mine, _folded(theirs) if m > n else theirs)
                yield i, j[close], np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
