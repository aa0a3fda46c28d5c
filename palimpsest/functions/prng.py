"""Seeds and random numbers of keyed and random replacements, over arrays of rows.

Keyed mode: xoshiro256** seeded with an HMAC-SHA256. Random mode: MT19937. Both draw integers of a range by rejection
from 32 bits, or 64 where the range is wider.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import numpy as np

#: The separator and prefixes of the messages that are signed.
SEPARATOR = "\x1f"
VALUE_PREFIX = "pii-keyed/v1"
DIGEST_PREFIX = "pii-keyed/v1/id"
RANDOM_PREFIX = "palimpsest-random/v1"


def keyed_seed(key: bytes, namespace: str, canonical: str, probe: int = 0) -> bytes:
    message = SEPARATOR.join((VALUE_PREFIX, namespace, canonical, str(probe)))
    return hmac.digest(key, message.encode("utf-8", "surrogatepass"), hashlib.sha256)


def keyed_digest(key: bytes, namespace: str, canonical: str) -> bytes:
    """What stands for an input in mapping tables."""
    return hmac.digest(key, SEPARATOR.join((DIGEST_PREFIX, namespace, canonical)).encode("utf-8", "surrogatepass"), hashlib.sha256)[:16]


def cell_seed(run_seed: bytes, *parts: object) -> int:
    """Seed of random mode, 0 to 2147483647: the same cell and attempt of a run always gets the same."""
    message = SEPARATOR.join((RANDOM_PREFIX, *map(str, parts)))
    return int.from_bytes(hmac.digest(run_seed, message.encode("utf-8", "surrogatepass"), hashlib.sha256)[:4], "little") & 0x7FFFFFFF


class Draws:
    """Generators of many rows. ``rows`` always names the rows that draw; the others stay as they are."""

    bits = 32
    size = 0

    def next(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def wide(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def integers(self, low: int, high: int, rows: np.ndarray | None = None) -> np.ndarray:
        """One integer of [low, high] for each row."""
        rows = np.arange(self.size) if rows is None else rows
        span = high - low
        wide = span > 0xFFFFFFFF
        full = 0xFFFFFFFFFFFFFFFF if wide else 0xFFFFFFFF
        draw = self.wide if wide else self.next
        got = draw(rows)
        if span == full:
            return got.astype(np.int64) + low if not wide else got
        n = span + 1
        if n & (n - 1) == 0:
            return (got & np.uint64(n - 1)).astype(np.int64) + low
        limit = np.uint64(full - full % n - 1)
        again = np.flatnonzero(got > limit)
        while len(again):
            got[again] = draw(rows[again])
            again = again[got[again] > limit]
        return (got % np.uint64(n)).astype(np.int64) + low


class Xoshiro(Draws):
    def __init__(self, seeds: Sequence[bytes]) -> None:
        self.size = len(seeds)
        self.state = np.frombuffer(b"".join(seeds), "<u8").reshape(-1, 4).T.copy() if len(seeds) else np.zeros((4, 0), np.uint64)

    def wide(self, rows: np.ndarray) -> np.ndarray:
        a, b, c, d = self.state[:, rows]

        def rotate(x: np.ndarray, k: int) -> np.ndarray:
            return x << np.uint64(k) | x >> np.uint64(64 - k)

        with np.errstate(over="ignore"):
            out = rotate(b * np.uint64(5), 7) * np.uint64(9)
        shifted = b << np.uint64(17)
        c, d = c ^ a, d ^ b
        b, a = b ^ c, a ^ d
        self.state[:, rows] = a, b, c ^ shifted, rotate(d, 45)
        return out

    def next(self, rows: np.ndarray) -> np.ndarray:
        return self.wide(rows) & np.uint64(0xFFFFFFFF)


class Mersenne(Draws):
    """Each row's state is twisted one word at a time, as it is needed."""

    def __init__(self, seeds: Sequence[int]) -> None:
        self.size = len(seeds)
        words = np.zeros((624, self.size), np.uint64)
        if self.size:
            words[0] = np.array(seeds, np.uint64)
            for i in range(1, 624):
                words[i] = ((words[i - 1] ^ words[i - 1] >> np.uint64(30)) * np.uint64(1812433253) + np.uint64(i)) & np.uint64(0xFFFFFFFF)
        self.words, self.at = words, np.zeros(self.size, np.int64)

    def next(self, rows: np.ndarray) -> np.ndarray:
        k = self.at[rows] % 624
        y = self.words[k, rows] & np.uint64(0x80000000) | self.words[(k + 1) % 624, rows] & np.uint64(0x7FFFFFFF)
        x = self.words[(k + 397) % 624, rows] ^ y >> np.uint64(1) ^ (y & np.uint64(1)) * np.uint64(0x9908B0DF)
        self.words[k, rows] = x
        self.at[rows] += 1
        x = x ^ x >> np.uint64(11)
        x = x ^ x << np.uint64(7) & np.uint64(0x9D2C5680)
        x = x ^ x << np.uint64(15) & np.uint64(0xEFC60000)
        return (x ^ x >> np.uint64(18)) & np.uint64(0xFFFFFFFF)

    def wide(self, rows: np.ndarray) -> np.ndarray:
        low = self.next(rows)
        return low | self.next(rows) << np.uint64(32)
