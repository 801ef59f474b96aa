"""Arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finalizer of splitmix64)."""
    out = x >> U64(30)
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    high = out >> U64(27)
    out ^= high
    out *= U64(0x94D049BB133111EB)
    np.right_shift(out, U64(31), out=high)
    out ^= high
    return out


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of every k successive entries, by doubling: about 2 log k operations on the array."""
    return rollings(h, (k,), base)[0]


def rollings(h: np.ndarray, sizes: tuple[int, ...], base: int) -> list[np.ndarray]:
    """``rolling`` for several k, which share the doubling. A k that is one more than another takes a single step from that."""
    out = {k: np.zeros(0, U64) for k in sizes if len(h) < k}
    power = lambda n: U64(pow(base, n, 1 << 64))
    todo = sorted(k for k in set(sizes) - set(out))
    halves = [k for k in todo if k - 1 not in todo]
    wholes: dict[int, np.ndarray] = {}
    part, size, width = h, 1, dict.fromkeys(halves, 0)
    while any(n < k for k, n in width.items()):
        for k in halves:
            if k & size:
                if not width[k]:
                    wholes[k] = part
                else:
                    n = len(h) - (width[k] + size) + 1
                    step = wholes[k][:n] * power(size)
                    step += part[width[k] : width[k] + n]
                    wholes[k] = step
                width[k] += size
        if any(n < k for k, n in width.items()):
            n = len(part) - size
            double = part[:n] * power(size)
            double += part[size : size + n]
            part, size = double, 2 * size
    for k in todo:
        if k not in wholes:
            n = len(h) - k + 1
            step = wholes[k - 1][:n] * power(1)
            step += h[k - 1 : k - 1 + n]
            wholes[k] = step
        out[k] = wholes[k]
    return [out[k] for k in sizes]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k successive entries."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[k - size : k - size + n])


def is_in(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which values are members. A table of low bits settles most before the search; hashes are expected."""
    out = np.zeros(len(values), bool)
    if not len(members) or not len(values):
        return out
    bits = max(10, int(len(members)).bit_length() + 3)
    mask = U64((1 << bits) - 1)
    table = np.zeros(1 << bits, bool)
    table[members & mask] = True
    maybe = np.flatnonzero(table[values & mask])
    members = np.sort(members)
    found = values[maybe]
    at = np.minimum(np.searchsorted(members, found), len(members) - 1)
    out[maybe[members[at] == found]] = True
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(column) -> np.ndarray:
    """A column of longs of an Arrow table as unsigned numbers."""
    return np.ascontiguousarray(column.to_numpy()).view(U64)
