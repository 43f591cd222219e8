"""Texts as flat numpy buffers: words and windows of words over all texts of an Arrow array at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Fixed values of the hashes.
BASE, STEP, FULL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(2**64 - 1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def trimmed(run):
    """A function over Arrow batches whose worker hands its free memory back to the system when it ends."""

    @functools.wraps(run)
    def wrap(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrap


def buffers(arr):
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa

    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(offs, most: int = 1_000_000):
    """(first, end) of runs of texts with about `most` bytes; a longer text is a run of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end
        at = end


def mixed(x):
    """Spread 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Texts are cut into words in stretches of about this many bytes; longer words than LONG bytes are hashed one by one.
STRETCH, LONG = 1 << 20, 64


def words(data, offs):
    """(starts, ends) of all words."""
    solid = ~SPACES[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = offs[1:] > offs[:-1]
    before[offs[:-1][filled]] = False
    after[offs[1:][filled] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _named(data, starts, ends):
    """Two 64-bit hashes of each word: its bytes are mixed in eight at a time, by steps that are not linear modulo 2**64."""
    lens = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h, h2 = lens.astype(np.uint64) * BASE, lens.astype(np.uint64) * STEP
        at = np.arange(len(starts))
        for k in range(0, LONG, 8):
            at = at[lens[at] > k] if k else at
            if not len(at):
                break
            left = np.minimum(lens[at] - k, 8).astype(np.uint64)
            x = lanes[starts[at] + k] & (FULL >> (np.uint64(64) - np.uint64(8) * left))
            h[at], h2[at] = mixed(h[at] ^ x) + BASE, mixed((h2[at] + x) * STEP) + BASE
    for k in np.flatnonzero(lens > LONG).tolist():
        raw = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        h[k], h2[k] = np.frombuffer(raw, np.uint64)
    return h, h2


def named_words(data, offs):
    """(first, second half of the 128-bit name, words of each text) of all words in order, a stretch of text at a time."""
    n, total = len(offs) - 1, int(offs[-1])
    first, second, sizes, a = [], [], np.zeros(n, np.int64), 0
    while a < total:
        e = _cut(data, a, total)
        inner = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, e, "left")]
        starts, ends = words(data[a:e], np.concatenate([[a], inner, [e]]) - a)
        h, h2 = _named(data[a:e], starts, ends)
        first.append(h), second.append(h2)
        sizes += np.bincount(np.searchsorted(offs, starts + a, "right") - 1, minlength=n)
        a = e
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(first or none), np.concatenate(second or none), sizes


def _cut(data, a: int, e: int) -> int:
    """Where the stretch from a on ends: at e, or at the first white space beyond its length."""
    at = a + STRETCH
    while at < e:
        blank = np.flatnonzero(SPACES[data[at : at + STRETCH]])
        if len(blank):
            return at + int(blank[0])
        at += STRETCH
    return e


def windows(hashes, owner, size: int):
    """(hash of `size` words from each word on, whether they are all of one text).

    Words are folded in by a step that is not linear modulo 2**64, so that no pattern of words cancels out.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        acc = hashes[:n].copy()
        for k in range(1, size):
            acc ^= acc >> np.uint64(29)
            acc *= STEP
            acc += hashes[k : n + k]
        return mixed(acc), owner[:n] == owner[size - 1 :]


def ragged(starts, lengths):
    """Indices of all items of the spans, span after span."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, ln = starts[full], lengths[full]
    first = np.zeros(len(s), np.int64)
    np.cumsum(ln[:-1], out=first[1:])
    out[first] = s
    out[first[1:]] -= s[:-1] + ln[:-1] - 1
    return np.cumsum(out)
