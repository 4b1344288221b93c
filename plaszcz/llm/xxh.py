"""XXH64 of many byte ranges of one buffer at once (the public algorithm by Yann Collet)."""

from __future__ import annotations

import numpy as np

# The algorithm's fixed values.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _by_step(h: np.ndarray, rest: np.ndarray, need: int, mix) -> None:
    """Apply mix to the rows that still have `need` bytes, until none has."""
    rows = np.flatnonzero(rest >= need)
    while rows.size:
        h[rows] = mix(h[rows], rows)
        rest[rows] -= need
        rows = rows[rest[rows] >= need]


def xxh64_ranges(data: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Digest of data[start[i] : start[i] + size[i]] for each i."""
    raw = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    words = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, strides=(1,))
    halves = np.ndarray((len(raw) - 3,), np.dtype("<u4"), raw, strides=(1,))
    at, rest, seed64 = start.astype(np.int64), size.astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed64 + _P5, np.uint64)
        long = np.flatnonzero(rest >= 32)
        if long.size:
            acc = [np.full(long.size, s, np.uint64) for s in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            live = np.arange(long.size)
            while live.size:
                where = long[live]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], words[at[where] + 8 * k])
                at[where] += 32
                rest[where] -= 32
                live = live[rest[long[live]] >= 32]
            out = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                out = (out ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[long] = out
        h += size.astype(np.uint64)

        def eight(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            lane = words[at[rows]]
            at[rows] += 8
            return _rotl(x ^ _rotl(lane * _P2, 31) * _P1, 27) * _P1 + _P4

        def four(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            lane = halves[at[rows]].astype(np.uint64)
            at[rows] += 4
            return _rotl(x ^ lane * _P1, 23) * _P2 + _P3

        def one(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            lane = raw[at[rows]].astype(np.uint64)
            at[rows] += 1
            return _rotl(x ^ lane * _P5, 11) * _P1

        _by_step(h, rest, 8, eight)
        _by_step(h, rest, 4, four)
        _by_step(h, rest, 1, one)
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
