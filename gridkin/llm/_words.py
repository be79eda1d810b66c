"""Words of many texts at once, as array operations over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: UTF-8 bytes of text taken at a time; a longer text is taken alone.
BLOCK = 1_000_000
#: Texts taken at a time.
BLOCK_TEXTS = 1024

#: Bytes over which a span's hash is a digest.
DIGEST_OVER = 1024

_ODD = 0x9E3779B97F4A7C15
#: The lowest bytes of eight, for each number of bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(texts: list[bytes], size: int = BLOCK, count: int = BLOCK_TEXTS) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) in parts of bounded size."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if i > first and (n + len(t) > size or i - first >= count):
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t)
    if texts:
        yield first, texts[first:]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight at a time, each eight mixed into what came before;
    that of a very long span is a digest's. Spans of one length up to eight bytes never collide. Hashes
    of different salts are independent."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    h = n.astype(np.uint64) * np.uint64(_ODD)
    if salt:
        h = mixed(h, salt)
    live = np.flatnonzero(n <= DIGEST_OVER)
    at, left = starts[live], n[live]
    while len(live):
        h[live] = mixed(h[live] ^ (eights[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > DIGEST_OVER):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return h
