"""An adaptive context-mixing range coder for token ids, over many blocks at once.

The probability of an id is a mixture: order 2 says the id that last followed the two ids before, order 1 the one that last
followed the id before, and order 0 gives every id of the vocabulary one share and a number of shares more for each time
it has occurred in the block. The weights of the three are learned per block, as counts by the confidence of the two contexts and their
agreement; the shares of an occurrence follow how many ids of late were new. An arithmetic coder with 64-bit low and range
codes the id once, by its share of the mixture: the ids that the contexts say lie first, then all others in order. Every
block starts anew, has its own checksum and can be decoded alone.

Blocks are lanes of numpy arrays that step together, one id of every block at a time. The encoder knows all ids, so its
predictions are computed ahead for whole blocks; only the coder's own state steps.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, blocks of a group, ids between two updates of order 0 and of the weights, bits of the context tables.
BLOCK, LANES, EPOCH, REFRESH, TABLE = 16_384, 512, 2_048, 64, 13
#: Ids of a block at least, where a group has too few for so many full ones: many short lanes step faster than a few long ones.
SHORT, LEAST_LANES = 2_048, 128
K1, K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Bits of a weight and of the shares of order 0; the mixture's shares add up to a power of two times the latter.
WEIGHT, SHARES = 10, 20
LOW32 = np.uint64(0xFFFFFFFF)
S32 = np.uint64(32)
#: Confidence in order 2 (8 each), in order 1 (2 each), and whether they say the same: cells of weights.
CELLS = 32


def _hash1(p):
    return (p.astype(np.uint32) * K1) >> np.uint32(32 - TABLE)


def _hash2(p, q):
    return (p.astype(np.uint32) * K1 + (q.astype(np.uint32) + np.uint32(1)) * K2) * K1 >> np.uint32(32 - TABLE)


def _weights(counts):
    """Counts [..., CELLS, 3] of what would have said the id -> weights that add up to 2**WEIGHT; a context that is new has none."""
    width = 1 + counts * ((1 << WEIGHT) - 3) // counts.sum(-1, keepdims=True)
    cell = np.arange(CELLS)
    width[..., cell < 8, 0] = 0
    width[..., cell % 8 < 2, 1] = 0
    width[..., 2] = (1 << WEIGHT) - width[..., 0] - width[..., 1]
    # contexts that agree are one
    both = (cell >= 8) & (cell % 8 >= 3) & (cell % 2 == 1)
    width[..., both, 0] += width[..., both, 1]
    width[..., both, 1] = 0
    return width


class Order0:
    """For lanes of ids: `before[lane, x]`, how often ids below x have occurred, `share`, the shares of an occurrence, and `total`."""

    def __init__(self, lanes: int, vocab: int):
        self.vocab = vocab
        self.before = np.zeros((lanes, vocab + 1), np.int16)
        self.share, self.total = np.zeros(lanes, np.int64), np.full(lanes, vocab, np.int64)
        self.distinct, self.at = np.zeros(lanes, np.int64), 0

    def learn(self, ids, t: int):
        """From the first t ids of the lanes."""
        for lane in range(len(ids)):
            n = np.bincount(ids[lane, :t], minlength=self.vocab)
            np.cumsum(n, dtype=np.int16, out=self.before[lane, 1:])
            now = int(np.count_nonzero(n))
            new = (now - self.distinct[lane]) / (t - self.at)
            self.distinct[lane] = now
            most = ((1 << SHARES) - self.vocab) // t
            self.share[lane] = min(most, max(1, round(self.vocab * (1 - new) / (t * max(new, 1 / 64)))))
        self.total = self.share * t + self.vocab
        self.at = t


def _steps(n: int) -> list[int]:
    """The positions at which order 0 learns: powers of two from REFRESH up to EPOCH, then multiples of it."""
    return [t for t in range(REFRESH, n, REFRESH) if t & (t - 1) == 0 and t < EPOCH or t % EPOCH == 0]


def _followers(ids, h):
    """(prediction, confidence 0..3) before each id: the last id in the same context and how often it came in a row."""
    order = np.argsort(h.astype(np.uint16), axis=1, kind="stable")
    hs, f = np.take_along_axis(h, order, 1), np.take_along_axis(ids, order, 1)
    chain = np.zeros(h.shape, bool)
    chain[:, 1:] = hs[:, 1:] == hs[:, :-1]
    same = np.zeros(h.shape, bool)
    same[:, 1:] = chain[:, 1:] & (f[:, 1:] == f[:, :-1])
    run = 1 + same.astype(np.uint8)
    run[:, 1:] += same[:, 1:] & same[:, :-1]
    pred, conf = np.zeros(h.shape, ids.dtype), np.zeros(h.shape, np.uint8)
    pred[:, 1:], conf[:, 1:] = f[:, :-1] * chain[:, 1:], run[:, :-1] * chain[:, 1:]
    out_p, out_c = np.empty_like(pred), np.empty_like(conf)
    np.put_along_axis(out_p, order, pred, 1)
    np.put_along_axis(out_c, order, conf, 1)
    return out_p, out_c


def _predicted(ids):
    """ids [lanes, n] -> what order 1 and order 2 say (-1 where order 2 says the same or a context is new), the cell of each id."""
    lanes, n = ids.shape
    prev = np.zeros((lanes, n + 2), ids.dtype)
    prev[:, 2:] = ids
    p1, p2 = prev[:, 1:-1], prev[:, :-2]
    c1, k1 = _followers(ids, _hash1(p1))
    c2, k2 = _followers(ids, _hash2(p1, p2))
    same = c1 == c2
    cell = k2 * 8 + k1 * 2 + same
    c1, c2 = c1.astype(np.int32), c2.astype(np.int32)
    c1[(k1 == 0) | same & (k2 > 0)] = -1
    c2[k2 == 0] = -1
    return c1, c2, cell


def _encode_group(blocks, vocab: int) -> list[bytes]:
    """Blocks in order of falling length -> their codes."""
    lens = np.array([len(b) for b in blocks])
    lanes, n = len(blocks), int(lens[0])
    ids = np.zeros((lanes, n), np.uint16)
    for lane, b in enumerate(blocks):
        ids[lane, : len(b)] = b
    parts = [_predicted(ids[k : k + 64]) for k in range(0, lanes, 64)]
    said1, said2, cells = (np.concatenate(x) for x in zip(*parts))
    del parts
    order0, rows = Order0(lanes, vocab), np.arange(lanes)[:, None]
    counts = np.ones((lanes, CELLS, 3), np.int64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, used = np.zeros((lanes, n + 2), np.uint32), np.zeros(lanes, np.int64)
    top, one = np.uint64(1) << S32, np.uint64(1)
    learns = set(_steps(n))
    for t0 in range(0, n, REFRESH):
        t1 = min(n, t0 + REFRESH)
        if t0 in learns:
            order0.learn(ids, t0)
        x, c1, c2, cell = ids[:, t0:t1].astype(np.int32), said1[:, t0:t1], said2[:, t0:t1], cells[:, t0:t1]
        share = order0.share[:, None]

        def held(c):
            """Shares of order 0 that lie before c and those of c itself; none for -1."""
            a = order0.before[rows, c].astype(np.int64)
            f = order0.before[rows, c + 1] - a
            return share * a + c, np.where(c >= 0, share * f + 1, 0)

        w = _weights(counts)[rows, cell]
        total = order0.total.view(np.uint64)
        at, own = held(x)
        (_, b1), (_, b2) = held(c1), held(c2)
        at = at - np.where(c1 < x, b1, 0) - np.where(c2 < x, b2, 0)
        wide2, wide1 = order0.total[:, None] * w[..., 0] + w[..., 2] * b2, order0.total[:, None] * w[..., 1] + w[..., 2] * b1
        hit2, hit1 = x == c2, x == c1
        start = np.where(hit2, 0, np.where(hit1, wide2, wide2 + wide1 + w[..., 2] * at))
        width = np.where(hit2, wide2, np.where(hit1, wide1, w[..., 2] * own))
        start, width = np.ascontiguousarray(start.T).view(np.uint64), np.ascontiguousarray(width.T).view(np.uint64)
        for t in range(t0, t1):
            m = int(np.searchsorted(-lens, -t, "left")) if lens[-1] <= t else lanes
            lo, r = low[:m], rng[:m]
            r >>= np.uint64(WEIGHT)
            r //= total[:m]
            lo += r * start[t - t0, :m]
            r *= width[t - t0, :m]
            full = np.flatnonzero(r < top)
            if len(full):
                l, s = lo[full], r[full]
                over = (l ^ (l + s - one)) >> S32 != 0
                s[over] = (top - (l & LOW32))[over]
                out[full, used[full]] = l >> S32
                used[full] += 1
                lo[full], r[full] = l << S32, s << S32
        m = int((lens > t0).sum())
        pick = (rows * CELLS + cell) * 3 + np.where(hit2, 0, np.where(hit1, 1, 2))
        live = pick[:m]
        if lens[m - 1] < t1:
            live = live[np.arange(t0, t1)[None, :] < lens[:m, None]]
        counts.reshape(-1)[:] += np.bincount(live.ravel(), minlength=counts.size)
    every = np.arange(lanes)
    out[every, used] = low >> S32
    out[every, used + 1] = low & LOW32
    return [out[k, : used[k] + 2].astype("<u4").tobytes() for k in range(lanes)]


#: Shares of order 0 that one entry of the decoder's table stands for.
STEP = 5


class Inverse:
    """Finds the id that a share of order 0 belongs to: a table of every 2**STEP-th share, then a search between two entries."""

    def __init__(self, order0: Order0):
        self.of, self.ids = order0, np.arange(order0.vocab, dtype=np.int32)

    def learn(self):
        lanes = len(self.of.share)
        self.size = (int(self.of.total.max()) >> STEP) + 2
        last, ids = np.zeros((lanes, self.size), np.uint16), self.ids.astype(np.uint16)
        for lane in range(lanes):
            begin = self.of.before[lane, :-1] * np.int32(self.of.share[lane])
            begin += self.ids
            begin >>= STEP
            begin += 1
            last[lane, begin] = ids
        np.maximum.accumulate(last, axis=1, out=last)
        self.flat, self.before = last.reshape(-1), self.of.before.reshape(-1)

    def __call__(self, lanes, home, share, w):
        """The id of share w of each lane; home: where the lane's counts begin, share: the shares of an occurrence."""
        j = lanes * self.size + (w >> STEP)
        lo = self.flat.take(j).astype(np.int64)
        j += 1
        hi = self.flat.take(j).astype(np.int64)
        far = (lo < hi).nonzero()[0]
        if len(far):
            # counts lie between those at the ends, which bounds the id; without an id that has occurred in between, to itself
            a, b, at, by, most = lo.take(far), hi.take(far), home.take(far), share.take(far), w.take(far)
            lo[far] = np.maximum(a, np.minimum(b, most - by * self.before.take(at + b)))
            at += a
            at += 1
            hi[far] = np.maximum(a, np.minimum(b, most - by * self.before.take(at)))
            far = far.compress(lo.take(far) < hi.take(far))
        while len(far):
            a, b = lo.take(far), hi.take(far)
            mid = (a + b + 1) >> 1
            ok = share.take(far) * self.before.take(home.take(far) + mid) + mid <= w.take(far)
            a, b = np.where(ok, mid, a), np.where(ok, b, mid - 1)
            lo[far], hi[far] = a, b
            far = far.compress(a < b)
        return lo


def _decode_group(codes, lens, vocab: int):
    """The inverse: list of arrays of ids."""
    lens = np.array(lens)
    lanes, n = len(codes), int(lens[0])
    size = max(len(c) for c in codes) // 4 + 2
    words = np.zeros((lanes, size), np.uint64)
    for k, c in enumerate(codes):
        words[k, : len(c) // 4] = np.frombuffer(c, "<u4")
    words = words.reshape(-1)
    at = np.arange(lanes) * size + 2
    off = (words[at - 2] << S32) | words[at - 1]  # the code less `low`
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    # what followed a context, and 2**16 times how often in a row, up to 3
    told1, told2 = np.zeros(lanes << TABLE, np.int32), np.zeros(lanes << TABLE, np.int32)
    after = np.array([1, 1, 1, 1, 1, 2, 3, 3], np.int32) << 16
    home, cells = np.arange(lanes) << TABLE, np.arange(lanes) * CELLS
    counts = np.ones((lanes, CELLS, 3), np.int64)
    tally = counts.reshape(-1)
    ids = np.zeros((n, lanes), np.uint16)
    p1, p2 = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
    order0 = Order0(lanes, vocab)
    inverse = Inverse(order0)
    inverse.learn()
    before, row = order0.before.reshape(-1), np.arange(lanes) * (vocab + 1)
    top, one = np.uint64(1) << S32, np.uint64(1)
    learns, m = set(_steps(n)), lanes
    for t in range(n):
        if lens[-1] <= t:
            m = int(np.searchsorted(-lens, -t, "left"))
        if t % REFRESH == 0:
            weights = _weights(counts)
            w2, w1, w0 = (np.ascontiguousarray(weights[..., k]).reshape(-1) for k in range(3))
            if t in learns:
                order0.learn(ids[:t].T, t)
                inverse.learn()
            total, share = order0.total, order0.share
        o, l, r, a, b, by = off[:m], low[:m], rng[:m], p1[:m], p2[:m], share[:m]
        i1, i2 = home[:m] + _hash1(a), home[:m] + _hash2(a, b)
        k1, k2 = told1.take(i1), told2.take(i2)
        c1, c2 = k1 & 0xFFFF, k2 & 0xFFFF
        k1 >>= 16
        k2 >>= 16
        same = c1 == c2
        cell = cells[:m] + (k2 * 8 + k1 * 2 + same)
        has2 = k2 > 0
        has1 = (k1 > 0) & ~(same & has2)
        x1, x2 = row[:m] + c1, row[:m] + c2
        a1, a2 = before.take(x1), before.take(x2)
        b1, b2 = before.take(x1 + 1) - a1, before.take(x2 + 1) - a2
        b1, b2 = (by * b1 + 1) * has1, (by * b2 + 1) * has2
        v0, tot = w0.take(cell), total[:m]
        wide2 = tot * w2.take(cell) + v0 * b2
        wide1 = tot * w1.take(cell) + v0 * b1
        both = wide2 + wide1
        r >>= np.uint64(WEIGHT)
        r //= tot.view(np.uint64)
        v = (o // r).view(np.int64)
        hit2 = v < wide2
        miss2 = ~hit2
        got = np.where(hit2, c2, c1)
        start, width = wide2 * miss2, np.where(hit2, wide2, wide1)
        pick = miss2.view(np.int8)
        rest = (v >= both).nonzero()[0]
        if len(rest):
            pick[rest] = 2
            f, by, end = v0.take(rest), by.take(rest), both.take(rest)
            s = (v.take(rest) - end) // f
            d1, d2, e1, e2 = c1.take(rest), c2.take(rest), b1.take(rest), b2.take(rest)
            g1, g2 = by * a1.take(rest) + d1, by * a2.take(rest) + d2
            # step over the shares of the two ids that lie elsewhere, the smaller id first
            swap = d1 > d2
            s += np.where(s >= np.where(swap, g2, g1), np.where(swap, e2, e1), 0)
            s += np.where(s >= np.where(swap, g1, g2), np.where(swap, e1, e2), 0)
            s = np.minimum(s, tot.take(rest) - 1)
            z = row.take(rest)
            x = inverse(rest, z, by, s)
            z += x
            first = before.take(z)
            z += 1
            start[rest] = end + f * (by * first + x - (d1 < x) * e1 - (d2 < x) * e2)
            width[rest] = f * (by * (before.take(z) - first) + 1)
            got[rest] = x
        start, width = start.view(np.uint64), width.view(np.uint64)
        step = r * start
        o -= step
        l += step
        r *= width
        full = (r < top).nonzero()[0]
        if len(full):
            x, s = l[full], r[full]
            over = (x ^ (x + s - one)) >> S32 != 0
            s[over] = (top - (x & LOW32))[over]
            l[full], r[full] = x << S32, s << S32
            o[full] = (o[full] << S32) | words[at[full]]
            at[full] += 1
        told1[i1] = after.take((c1 == got) * 4 + k1) | got
        told2[i2] = after.take((c2 == got) * 4 + k2) | got
        tally[cell * 3 + pick] += 1
        b[:] = a
        a[:] = got
        ids[t, :m] = got
    return [ids[: lens[k], k].copy() for k in range(lanes)]


def encode(ids, vocab: int) -> list[tuple[int, int, bytes]]:
    """ids (below vocab, at most 2**16) -> blocks: number of ids, crc32 of the ids as little-endian 32 bits, code."""
    if vocab > 1 << 16 or (len(ids) and int(ids.max()) >= vocab):
        raise ValueError("ids must be below the vocabulary's size, and that at most 65536")
    out = []
    size = min(BLOCK, max(SHORT, -(-len(ids) // (LEAST_LANES * REFRESH)) * REFRESH))
    blocks = [ids[k : k + size] for k in range(0, len(ids), size)]
    for k in range(0, len(blocks), LANES):
        group = blocks[k : k + LANES]
        for b, code in zip(group, _encode_group(group, vocab)):
            out.append((len(b), zlib.crc32(b.astype("<u4").tobytes()), code))
    return out


def decode(blocks, vocab: int):
    """Blocks of encode() -> ids; a block that does not agree with its checksum is an error."""
    out = []
    for k in range(0, len(blocks), LANES):
        group = blocks[k : k + LANES]
        for (n, crc, _), ids in zip(group, _decode_group([b[2] for b in group], [b[0] for b in group], vocab)):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block differs from its checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint16)
