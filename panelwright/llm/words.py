"""64-bit hashes of the words of many texts at once, without a loop over words."""

from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.Philox(key=20))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a longer text is cut at its white space, so memory follows the longest word, not the longest text.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""

    def unshift(y, s):
        z = y
        for _ in range(64 // s):
            z = y ^ (z >> np.uint64(s))
        return z

    x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(x, 30)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(n, factor, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


_TABLE = _powers(2 * BLOCK)


def _cut(raw: bytes):
    """Pieces of about ``BLOCK`` bytes, each but the last ending before white space."""
    at = 0
    while len(raw) - at > BLOCK:
        near = np.flatnonzero(_SPACES[np.frombuffer(raw, np.uint8, BLOCK, at)])
        if len(near) and near[-1]:
            end = at + int(near[-1])
        else:  # one word fills the block: up to its end, wherever that is
            end = at + BLOCK
            while end < len(raw) and not _SPACES[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _blocks(texts: list[str]):
    """(pieces, row of each piece) of at most about ``BLOCK`` bytes together."""
    pieces, rows, held = [], [], 0
    for r, t in enumerate(texts):
        for piece in _cut(t.encode("utf-8", "replace")):
            if held and held + len(piece) > BLOCK:
                yield pieces, rows
                pieces, rows, held = [], [], 0
            pieces.append(piece), rows.append(r)
            held += len(piece) + 1
    yield pieces, rows


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of every text, in order. Words are runs of anything but ASCII white space; ``lower`` reads A-Z as a-z.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from prefix sums over a block of texts, then scrambled.
    """
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for pieces, row in _blocks(texts):
        buffer = np.frombuffer(b"\n".join(pieces), dtype=np.uint8)
        n = len(buffer)
        if not n:
            continue
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACES[buffer]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _TABLE if n <= len(_TABLE[0]) else _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[buffer] * up[:n], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        stops = np.cumsum(np.fromiter((len(p) + 1 for p in pieces), dtype=np.int64, count=len(pieces)))
        rows.append(np.array(row, dtype=np.int64)[np.searchsorted(stops, starts, side="right")])
    return np.concatenate(hashes), np.concatenate(rows)


def slices(texts, limit: int = 500_000, rows: int = 2000):
    """(start, length) of runs of an Arrow string array that hold at most about ``limit`` characters (a longer text is alone)."""
    at = 0
    while at < len(texts):
        k = held = 0
        while at + k < len(texts) and k < rows and held < limit:
            held += len(texts[at + k].as_py() or "")
            k += 1
        yield at, k
        at += k


def slices_of(batches, column: str, limit: int = 500_000):
    """The batches cut into such runs."""
    for batch in batches:
        for at, k in slices(batch.column(column), limit):
            yield batch.slice(at, k)
