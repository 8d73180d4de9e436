"""64-bit hashes of words, word shingles and sequences of words of whole texts, a slice of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time (a longer text is hashed alone).
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.array([pow(0xD6E8FEB86659FD93, k + 3, 1 << 64) for k in range(256)], np.uint64)
_LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)
_SPACE = np.array([k == 32 or 9 <= k <= 13 for k in range(256)])
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, SLICE + (SLICE >> 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


#: Words up to so many bytes are hashed together, eight bytes of each at a time; longer ones one by one.
_CHUNKED = 64
_STEP = np.uint64(0x632BE59BD9B4E019)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and where each text's words begin (one more entry than texts).

    Words are runs of bytes other than ASCII white space; bytes count from the beginning of ``texts`` joined by one byte. With
    ``lower``, A-Z count as a-z. Every eight bytes are mixed into what came before, so no hash is a sum of its bytes' parts.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.insert(edge, 0, 0)
    start, end = edge[0::2], edge[1::2]
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))
    size = end - start
    hashes = mixed(size.astype(np.uint64) + _STEP)
    at = np.arange(len(start))
    for k in range(0, _CHUNKED, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left = size[at] - k
        chunk = eight[start[at] + k]
        cut = left < 8
        chunk[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        hashes[at] = mixed((hashes[at] ^ chunk) * np.uint64(_BASE) + _STEP)
    for i in np.flatnonzero(size > _CHUNKED).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    begins = np.cumsum(np.array([0, *(len(t) + 1 for t in texts)], np.int64))
    return hashes, start, end, np.searchsorted(start, begins)


#: Two prime moduli; pairs of bases for hashes that have nothing to do with each other.
_PRIMES = (2147483647, 2147483629)
_BASES = ((1103515245, 1664525), (1566083941, 1812433253))
_FIELD: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def field_powers(modulus: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo a prime below 2**31, for i < n at least."""
    have = _FIELD.get((modulus, base))
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, modulus)):
            up = np.ones(max(n, SLICE >> 2), np.uint64)
            done = 1
            while done < len(up):
                more = min(done, len(up) - done)
                up[done : done + more] = up[:more] * np.uint64(pow(b, done, modulus)) % np.uint64(modulus)
                done += more
            made.append(up)
        have = _FIELD[modulus, base] = (made[0], made[1])
    return have


class Sequences:
    """Hashes of any stretches of a sequence of word hashes, from running sums of polynomials over two prime fields.

    Sums modulo a power of two would make some long stretches alike by construction, whatever the base.
    """

    def __init__(self, words: np.ndarray, which: int = 0) -> None:
        self.lanes = []
        for k, (modulus, base) in enumerate(zip(_PRIMES, _BASES[which], strict=True)):
            up, down = field_powers(modulus, base, len(words) + 1)
            m = np.uint64(modulus)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum((words >> np.uint64(32 * k)) % m * up[: len(words)] % m, out=total[1:])
            self.lanes.append((m, total, down))

    def of(self, a: np.ndarray, b: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Hash of words a..b-1 of each stretch, together with a number."""
        x, y = ((total[b] - total[a]) % m * down[a] % m for m, total, down in self.lanes)
        return tagged(x, y, tag)

    def without_each(self, tag: np.ndarray) -> np.ndarray:
        """Hashes of the whole sequence without each of its words."""
        x, y = ((total[:-1] + (total[-1] - total[1:]) % m * down[1]) % m for m, total, down in self.lanes)
        return tagged(x, y, tag)


def tagged(x: np.ndarray, y: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mixed((x << np.uint64(32) | y) ^ mixed(tag + _STEP))


def _sequence(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0] * _C2
    for p in parts[1:]:
        h = mixed(h + np.uint64(0x632BE59BD9B4E019)) * np.uint64(_BASE) + p
    return mixed(h)


def slices(sizes: list[int], limit: int = SLICE) -> Iterator[slice]:
    """Slices of consecutive texts of about ``limit`` bytes."""
    at, size = 0, 0
    for k, n in enumerate(sizes):
        size += n + 1
        if size >= limit or k == len(sizes) - 1:
            yield slice(at, k + 1)
            at, size = k + 1, 0


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words; of fewer words the one hash of all; none without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for part in slices([len(t) for t in raw]):
        words, _, _, first = word_hashes(raw[part])
        n = max(0, len(words) - width + 1)
        grams = _sequence([words[k : k + n] for k in range(width)]) if n else words[:0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield _sequence([words[k : k + 1] for k in range(a, b)])
            else:
                yield words[:0]
