"""64-bit hashes of the words of a text and of runs of words, whole arrays at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers and byte values of the word hash: any fixed numbers do.
_RNG = np.random.default_rng(20)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED_VALUE = _BYTE_VALUE[np.frombuffer(LOWER, np.uint8)]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1], done = 1, 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


#: Bytes of texts that are hashed at once, one text more at most.
_PIECE = 1 << 18


class _Powers:
    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 12), _powers(_BASE_INVERSE, 1 << 12)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BASE_INVERSE, 2 * n)
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """Of each word between white space, A-Z lowered, in order of the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(LOWER), np.uint8)
    space = np.concatenate([[True], _IS_SPACE[raw], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[0::2], turns[1::2]
    # The hash of a word is a difference of running sums, moved to the text's beginning.
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def many_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all ``texts``, one after another, and how many words each has; a null is an empty text."""
    held = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(held):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, places, data = held.buffers()
    offsets = np.frombuffer(places, np.int64)[held.offset : held.offset + len(held) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    hashes, counts, at = [], [], 0
    while at < len(held):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        found = _piece_hashes(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        hashes.append(found[0])
        counts.append(found[1])
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def _piece_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    is_word = ~_IS_SPACE[raw]
    before, after = np.concatenate([[False], is_word]), np.concatenate([is_word, [False]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWERED_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.diff(np.searchsorted(starts, offsets))


def window_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Of each run of ``n`` words."""
    m = max(0, len(word) - n + 1)
    return run_hashes([word[k : k + m] for k in range(n)])


def run_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Of runs whose first words are ``words[0]``, whose second ones ``words[1]`` and so on."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for word in words:
        out = out * np.uint64(0xD6E8FEB86659FD93) + word
    return mix(out)
