"""Sets of word shingles as 64-bit hashes, made for many texts at once with numpy.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A set holds the
distinct runs of `words` words; a shorter text is one shingle of all its words, and a text without
words has the empty set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on every bit of h."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word: a polynomial in the bytes, from running sums."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1  # a word is not cut
        raw = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate([[True], _SPACE[raw], [True]])
        first = np.flatnonzero(space[:-1] & ~space[1:])
        last = np.flatnonzero(~space[:-1] & space[1:])
        if len(first):
            with np.errstate(over="ignore"):
                power = np.full(len(raw) + 1, _BASE)
                back = np.full(len(raw) + 1, _INVERSE)
                power[0] = back[0] = 1
                np.multiply.accumulate(power, out=power)
                np.multiply.accumulate(back, out=back)
                total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * power[:-1], dtype=np.uint64)])
                hashes.append(mixed((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64)))
            starts.append(first + at)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: Sequence[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts, hashes = _word_hashes(b"\n".join(raw))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, begins)
    with np.errstate(over="ignore"):
        combined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            combined = mixed(combined * np.uint64(3) + hashes[k : k + len(combined)])
        sets = []
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - first >= words:
                sets.append(np.unique(combined[first : end - words + 1]))
            elif end > first:
                one = np.uint64(end - first)
                for h in hashes[first:end]:
                    one = mixed(np.array([one * np.uint64(5) + h]))[0]
                sets.append(np.array([one], np.uint64))
            else:
                sets.append(np.empty(0, np.uint64))
    return sets


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    import hashlib

    digest = hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class MinHash:
    """`size` minwise values of 32 bits for each set."""

    def __init__(self, size: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.flips = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64) * np.uint64(2)

    def __call__(self, sets: Sequence[np.ndarray]) -> np.ndarray:
        """(sets, size); empty sets get zeros."""
        out = np.zeros((len(sets), len(self.factors)), np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            return out
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        with np.errstate(over="ignore"):
            for k, (factor, flip) in enumerate(zip(self.factors, self.flips)):
                least = np.minimum.reduceat((values ^ flip) * factor, starts)
                out[full, k] = (mixed(least) >> np.uint64(32)).astype(np.uint32)
        return out
