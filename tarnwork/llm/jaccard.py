"""Exact n-gram Jaccard join with set-relation skipping.

A document is the set of fingerprints of its shingles; documents with one set are one set from the first step on.

1. Index. Every chunk of documents sends its sorted fingerprints, packed, to the token bucket they lie in, together with
   the 128-bit names of its sets. A bucket is read in PARTS ranges of tokens, one at a time, and learns which sets hold each
   token. Tokens of one set only are dropped: they can join nothing.
2. Sets. The rest returns to the sets. In order of frequency the tokens of one set come first, so they fill a set's
   prefix; a set whose prefix holds no shared token has no partner and is gone. That is most of a clean corpus. What is left
   gets a number of its own.
3. Similar sets. Sets that agree in a minimum hash are compared with one centre (the set with the largest share of shared
   tokens). A verified link puts a set into the centre's cluster, at a known distance.
4. Block-skipping. The prefix index is read list by list, sorted by size; within a list, whole clusters are skipped that
   are connected already, or whose sizes and positions cannot reach the overlap. What is left are pairs of clusters.
5. Derived answers. Jaccard distance is a metric: from the distance of two centres and the members' distances
   to them, almost all pairs of members are decided without looking at them; the rest are compared.

Sets have 128-bit names, fingerprints 52 bits: a shingle of one document agrees
with another shingle of a document it is compared with, of a thousand shingles each, with a chance of 2e-10.
Results are the classes of the links (components). A task holds one range of a bucket's tokens and what it shares; the number of
buckets is spark.sql.shuffle.partitions, so that setting sizes them. A group of copies or of near copies, however large, is a
star and never all its pairs, and the rows of a centre are dealt over as many tasks as they need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import drop_written, free, may_be_in, partitions, salted, written
from .components import components

#: Bits of a packed token that number the document within its chunk; ranges of tokens in which a bucket is read.
OWNER, PARTS = 12, 8
#: Least and largest bytes of a chunk.
CHUNK = (2_000_000, 8_000_000)
HASHES = 3
#: Kinds of rows, in the order in which a bucket reads them. `number` is a chunk's, a document's id or a set's.
NAMES, TOKENS, MEMBER, HEADER, SET = 0, 1, 2, 3, 4
FIELDS = "kind int, bucket int, part int, blob binary, number long, n int, hi long, lo long"


def shingle_keys(data, offs, size: int):
    """(hash, text number) of all shingles: `size` words each; a text with fewer has its whole sequence as one."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    h, _, n_words = flat.named_words(data, offs)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    shingle, whole = flat.windows(h, owner, size)
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    with np.errstate(over="ignore"):
        acc = n_words[short].astype(np.uint64) * flat.BASE
        for k in range(size - 1):
            more = n_words[short] > k
            at = np.minimum(first[short] + k, max(len(h) - 1, 0))
            acc = np.where(more, (acc ^ (acc >> np.uint64(29))) * flat.STEP + h[at] if len(h) else acc, acc)
    return np.concatenate([shingle[whole], flat.mixed(acc)]), np.concatenate([owner[: len(whole)][whole], short])


def pack(keys):
    """Sorted 64-bit values as differences in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps[0] = steps[0], 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return np.array([len(keys), width, first], np.uint64).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob):
    """(values, what follows them)."""
    n, width, first = (int(x) for x in np.frombuffer(blob, np.uint64, 3))
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, 24).reshape(n, width)
    steps = wide.view(np.uint64).ravel()
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64), blob[24 + n * width :]


def _rows(kind, bucket, part=None, blob=None, number=None, n=None, hi=None, lo=None):
    import pyarrow as pa

    size = len(bucket)
    cols = [np.full(size, kind, np.int32), np.asarray(bucket, np.int32), np.zeros(size, np.int32) if part is None else part, blob, number, n, hi, lo]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    cols = [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in FIELDS.split(", ")])


def _unique(hi, lo):
    """(distinct names hi, lo in order, the place of each name among them)."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    place = np.empty(len(hi), np.int32)
    place[order] = np.cumsum(new) - 1
    return hi[new], lo[new], place


def _index(size: int, buckets: int):
    """Documents -> packed tokens by token bucket and range, names of sets, a member row per document, a header row per set of a chunk."""
    ranges = buckets * PARTS
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    chunk = min(CHUNK[1], max(CHUNK[0], CHUNK[0] * buckets // 64))

    @flat.trimmed
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, data, offs = b.column(0), *flat.buffers(b.column(1))
            for a, e in flat.pieces(offs, chunk):
                for a in range(a, e, 1 << OWNER):
                    end = min(e, a + (1 << OWNER))
                    yield from one(pa, number, ids.slice(a, end - a), data[offs[a] : offs[end]], offs[a : end + 1] - offs[a])
                    number += 1

    def one(pa, number, ids, data, offs):
        docs = len(offs) - 1
        h, owner = shingle_keys(data, offs, size)
        low = np.uint64((1 << OWNER) - 1)
        keys = np.sort((h & ~low) | owner.astype(np.uint64))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        owner = (keys & low).astype(np.uint16)
        n = np.bincount(owner, minlength=docs)
        filled = np.flatnonzero(n)
        hi, lo = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        if len(filled):
            by_doc = np.argsort(owner, kind="stable")
            token, first = (keys >> np.uint64(OWNER))[by_doc], (np.cumsum(n) - n)[filled]
            count = n[filled].astype(np.uint64)
            with np.errstate(over="ignore"):  # two independent sums name a set, with its size
                hi[filled] = flat.mixed(np.add.reduceat(flat.mixed(token * flat.STEP), first) + count * flat.BASE).view(np.int64)
                lo[filled] = flat.mixed(np.add.reduceat(flat.mixed(token * flat.BASE + flat.STEP), first) + count * flat.STEP).view(np.int64)
        no_set = n == 0
        yield _rows(MEMBER, np.arange(docs) % buckets, number=ids, n=n.astype(np.int32), hi=pa.array(hi, mask=no_set), lo=pa.array(lo, mask=no_set))
        if not len(filled):
            return
        # one document stands for the copies of the chunk; the chunk's sets are numbered anew
        _, _, place = _unique(hi[filled], lo[filled])
        stands = np.sort(filled[np.unique(place, return_index=True)[1]])
        yield _rows(HEADER, hi[stands].view(np.uint64) % np.uint64(buckets), n=n[stands].astype(np.int32), hi=hi[stands], lo=lo[stands])
        local = np.full(docs, -1, np.int64)
        local[stands] = np.arange(len(stands))
        keys = keys[local[owner] >= 0]
        cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        hi, lo = hi[stands], lo[stands]
        for bucket in range(buckets):
            at = cuts[bucket * PARTS : (bucket + 1) * PARTS + 1]
            if at[0] == at[-1]:
                continue
            part = keys[at[0] : at[-1]]
            own = local[(part & low).astype(np.int64)]
            used = np.unique(own)
            again = np.zeros(len(stands), np.uint64)
            again[used] = np.arange(len(used), dtype=np.uint64)
            part = (part & ~low) | again[own]
            held = np.flatnonzero(np.diff(at))
            blobs = [pack(part[at[k] - at[0] : at[k + 1] - at[0]]) for k in held]
            yield _rows(NAMES, [bucket], blob=[hi[used].tobytes() + lo[used].tobytes()], number=[number])
            yield _rows(TOKENS, np.full(len(held), bucket), part=held.astype(np.int32), blob=blobs, number=np.full(len(held), number))

    return run


def _runs(batches, held_kinds):
    """Sorted batches -> (None, rows) to pass on at once, and (bucket, kind, part), rows once per run of rows of `held_kinds`."""
    import pyarrow as pa
    import pyarrow.compute as pc

    now, held = None, []
    for b in batches:
        t = pa.table({c: b.column(c) for c in b.schema.names})
        mine = pc.is_in(t["kind"], pa.array(held_kinds, pa.int32()))
        other = t.filter(pc.invert(mine))
        if other.num_rows:
            yield None, other
        t = t.filter(mine)
        if not t.num_rows:
            continue
        keys = np.stack([t[c].to_numpy() for c in ("bucket", "kind", "part")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[s].tolist())
            if now is not None and key != now:
                yield now, pa.concat_tables(held)
                held = []
            now = key
            held.append(t.slice(s, e - s))
    if held:
        yield now, pa.concat_tables(held)


def _blobs(rows):
    for blob in rows["blob"]:
        yield blob.as_buffer().to_pybytes()


def _shared_tokens(rows, first_of: dict, place):
    """One range of a bucket's tokens -> (token, set, frequency) of those that two sets hold, or None."""
    token, sets = [], []
    for number, blob in zip(rows["number"].to_pylist(), _blobs(rows)):
        k, _ = unpack(blob)
        token.append(k >> np.uint64(OWNER))
        sets.append(place[first_of[number] + (k & np.uint64((1 << OWNER) - 1)).astype(np.int64)])
    token, sets = np.concatenate(token), np.concatenate(sets)
    order = np.argsort(token)
    token, sets = token[order], sets[order]
    same = token[1:] == token[:-1]
    more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    token, sets = token[more], sets[more]
    if not len(token):
        return None
    order = np.lexsort((sets, token))
    token, sets = token[order], sets[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])])
    token, sets = token[new], sets[new]
    run_at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    df = np.diff(np.append(run_at, len(token)))
    df = np.repeat(df, df)
    more = df > 1
    return (token[more], sets[more], df[more].astype(np.int32)) if more.any() else None


def _shared(buckets: int):
    """Token buckets -> the shared tokens and their frequencies, packed by set bucket."""

    @flat.trimmed
    def run(batches):
        at, found = None, []
        hi = lo = place = first_of = None

        def told():
            token, sets, df = (np.concatenate(x) for x in zip(*found))
            to = (hi.view(np.uint64) % np.uint64(buckets)).astype(np.int32)[sets]
            order = np.lexsort((sets, to))
            token, sets, df, to = token[order], sets[order], df[order], to[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            blobs = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                own, counts = np.unique(sets[s:e], return_counts=True)
                head = np.array([len(own), e - s], np.int64).tobytes()
                blobs.append(head + hi[own].tobytes() + lo[own].tobytes() + token[s:e].tobytes() + counts.astype(np.int32).tobytes() + df[s:e].tobytes())
            yield _rows(TOKENS, to[cuts[:-1]], blob=blobs)

        for key, rows in _runs(batches, [NAMES, TOKENS]):
            if key is None:
                yield from rows.to_batches()
                continue
            if key[0] != at and found:
                yield from told()
                found = []
            at = key[0]
            if key[1] == NAMES:  # comes before the tokens of its bucket
                names = [np.frombuffer(x, np.int64).reshape(2, -1) for x in _blobs(rows)]
                sizes = np.array([x.shape[1] for x in names])
                first_of = dict(zip(rows["number"].to_pylist(), (np.cumsum(sizes) - sizes).tolist()))
                hi, lo, place = _unique(*np.concatenate(names, 1))
            elif (got := _shared_tokens(rows, first_of, place)) is not None:
                found.append(got)
        if found:
            yield from told()

    return run


def _alive(percent: int):
    """Set buckets -> the sets whose prefix holds a shared token, numbered, with all their shared tokens, the rarest first."""

    def sets_of(rows, header):
        his, los, counts, tokens, dfs = [header["hi"].to_numpy()], [header["lo"].to_numpy()], [], [], []
        for raw in _blobs(rows):
            n_sets, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
            his.append(np.frombuffer(raw, np.int64, n_sets, 16))
            los.append(np.frombuffer(raw, np.int64, n_sets, 16 + 8 * n_sets))
            tokens.append(np.frombuffer(raw, np.uint64, n, 16 + 16 * n_sets))
            counts.append(np.frombuffer(raw, np.int32, n_sets, 16 + 16 * n_sets + 8 * n))
            dfs.append(np.frombuffer(raw, np.int32, n, 16 + 20 * n_sets + 8 * n))
        hi, lo, place = _unique(np.concatenate(his), np.concatenate(los))
        n_of = np.zeros(len(hi), np.int64)
        n_of[place[: header.num_rows]] = header["n"].to_numpy()
        sets, tokens, dfs = np.repeat(place[header.num_rows :], np.concatenate(counts)), np.concatenate(tokens), np.concatenate(dfs)
        order = np.lexsort((tokens, dfs, sets))
        sets, tokens = sets[order], tokens[order]
        at = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
        own, k = sets[at], np.diff(np.append(at, len(sets)))
        live = np.flatnonzero(k >= least_overlap(n_of[own], percent))
        return tokens, at[live], k[live], n_of[own[live]], hi[own[live]], lo[own[live]]

    @flat.trimmed
    def run(batches):
        from pyspark import TaskContext

        number, waiting = TaskContext.get().partitionId() << 36, {}

        def told(number):
            tokens, at, k, n, hi, lo = sets_of(waiting[TOKENS], waiting[HEADER])
            for part in np.array_split(np.arange(len(at)), len(at) // 2000 + 1):
                if len(part):
                    yield _rows(SET, np.zeros(len(part)), blob=[tokens[at[x] : at[x] + k[x]].tobytes() for x in part], n=n[part].astype(np.int32), number=number + part, hi=hi[part], lo=lo[part])

        for key, rows in _runs(batches, [TOKENS, HEADER]):
            if key is None:
                yield from rows.to_batches()
            elif key[1] == TOKENS:
                waiting = {"bucket": key[0], TOKENS: rows}
            elif waiting.get("bucket") == key[0]:  # a bucket without shared tokens has headers only
                waiting[HEADER] = rows
                yield from told(number)
                number += rows.num_rows
                waiting = {}

    return run


def least_overlap(n, percent: int):
    """Tokens that a set of n shares with any partner at least."""
    return (n * percent + 99) // 100


def _slots(batches):
    """Sets -> HASHES rows each: the minimum of the hashed shared tokens."""
    import pyarrow as pa

    for b in batches:
        sets, n, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for s, size, blob in zip(sets, n, b.column(2)):
            t = np.frombuffer(blob.as_buffer(), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(HASHES):
                    low = flat.mixed(t * flat.STEP + np.uint64(j + 1) * flat.BASE).min()
                    out.append((int(flat.mixed(low + np.uint64(j)).view(np.int64)), s, len(t) / size))
        slot, s, share = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(s, pa.int64()), pa.array(share, pa.float64())], names=["slot", "set_id", "share"])


def _overlaps(batches):
    """Pairs with both token lists -> the size of the intersection."""
    import pyarrow as pa

    held = (None, None)
    for b in batches:
        a, x, y = b.column(0).to_pylist(), b.column(4), b.column(5)
        inter = []
        for k, i in enumerate(a):
            if held[0] != i:  # the pairs of a centre lie together
                held = (i, np.sort(np.frombuffer(x[k].as_buffer(), np.uint64)))
            t = np.frombuffer(y[k].as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(held[1], t), len(held[1]) - 1)
            inter.append(int((held[1][at] == t).sum()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(inter, pa.int32())], names=["a", "b", "n_a", "n_b", "inter"])


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """written pairs a, b -> a, b, distance, link. The pairs of one a are dealt over as many tasks as their number asks for."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("blob").alias("t_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("blob").alias("t_b"))
    dealt, left = salted(pairs, left, "a", "b")
    both = dealt.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "n_a", "n_b", "t_a", "t_b")
    got = both.mapInArrow(_overlaps, "a long, b long, n_a int, n_b int, inter int")
    union = F.col("n_a") + F.col("n_b") - F.col("inter")
    return got.select("a", "b", (1 - F.col("inter") / union).alias("distance"), (F.col("inter").cast("long") * 100 >= union.cast("long") * percent).alias("link"))


def _prefixes(buckets: int, percent: int):
    """Sets with cluster and class -> their prefixes, packed by token bucket."""

    @flat.trimmed
    def run(batches):
        for b in batches:
            cols = []
            for k in range(b.num_rows):
                s, n, centre, root = (b.column(c)[k].as_py() for c in (0, 1, 3, 4))
                t = np.frombuffer(b.column(2)[k].as_buffer(), np.uint64)
                q = len(t) - int(least_overlap(n, percent)) + 1
                row = np.empty((q, 5), np.int64)
                row[:, 0], row[:, 1], row[:, 2], row[:, 3], row[:, 4] = t[:q].view(np.int64), centre, root, n, len(t) - 1 - np.arange(q)
                cols.append(row)
            if not cols:
                continue
            every = np.concatenate(cols)
            to = (flat.mixed(every[:, 0].view(np.uint64) * flat.STEP) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            every, to = every[order], to[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            yield _rows(TOKENS, to[cuts[:-1]], blob=[every[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])])

    return run


def _cluster_pairs(percent: int):
    """Token buckets of the prefix index -> pairs of clusters of different classes that may hold a link."""

    @flat.trimmed
    def run(batches):
        import pyarrow as pa

        for _, rows in _runs(batches, [TOKENS]):
            e = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for x in rows["blob"]])
            token, centre, root, n, rest = e.T
            order = np.lexsort((n, centre, token))
            token, centre, root, n, rest = (x[order] for x in (token, centre, root, n, rest))
            # a cluster's entry in a list: its smallest and largest set, and the most tokens behind this one
            at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (centre[1:] != centre[:-1])]))
            last = np.append(at[1:], len(token)) - 1
            token, centre, root, small, large, rest = token[at], centre[at], root[at], n[at], n[last], np.maximum.reduceat(rest, at)
            order = np.lexsort((small, token))
            token, centre, root, small, large, rest = (x[order] for x in (token, centre, root, small, large, rest))
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            found, waiting = [], 0
            for s, t in zip(cuts[:-1], cuts[1:]):
                if t - s < 2 or (root[s:t] == root[s]).all():
                    continue
                for i in range(s, t - 1):
                    # sizes ascend: the list ends where even the largest set here is too small
                    j = slice(i + 1, i + 1 + int(np.searchsorted(small[i + 1 : t] * percent, large[i] * 100, "right")))
                    ok = (root[j] != root[i]) & ((1 + np.minimum(rest[i], rest[j])) * (100 + percent) >= percent * (small[i] + small[j]))
                    k = np.flatnonzero(ok) + i + 1
                    if len(k):
                        found.append(np.stack([np.minimum(centre[i], centre[k]), np.maximum(centre[i], centre[k])], 1))
                        waiting += len(k)
                    if waiting > 200_000:
                        found = [np.unique(np.concatenate(found), axis=0)]
                        if len(found[0]) > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0].T], names=["a", "b"])
                            found = []
                        waiting = sum(map(len, found))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.unique(np.concatenate(found), axis=0).T], names=["a", "b"])

    return run


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "part")


def ngram_jaccard(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of anything but white space, A-Z lower-cased; the set of a document are its distinct shingles of `size`
    words, or its whole sequence if it has fewer. Two documents link when intersection / union is at least
    `percent` / 100; component_id is the smallest doc_id reachable by links, itself included. A null, empty or blank text has
    no shingles and is linked with nothing (component_id is its own doc_id). Null ids are never the smallest; a component of
    null ids only has a null one. Repeated rows link with each other. An empty table gives an empty result; other columns
    are ignored. doc_id is returned as long. A text of any length is one set of all its shingles; it takes about ten times its
    size of a worker's memory.
    """
    buckets = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = rows.mapInArrow(_index(size, buckets), FIELDS)
    shared = _dealt(index, buckets).mapInArrow(_shared(buckets), FIELDS)
    base = written(_dealt(shared, buckets).mapInArrow(_alive(percent), FIELDS), "jaccard-sets")
    members = base.where(F.col("kind") == MEMBER).select(F.col("number").alias("doc_id"), "n", "hi", "lo")
    sets = base.where(F.col("kind") == SET).select(F.col("number").alias("set_id"), "n", "blob")
    names = base.where(F.col("kind") == SET).select(F.col("number").alias("set_id"), "hi", "lo")

    # similar sets meet at a centre
    slots = written(sets.mapInArrow(_slots, "slot long, set_id long, share double"), "jaccard-slots")
    centre = slots.groupBy("slot").agg(F.max(F.struct("share", "set_id"))["set_id"].alias("a"))
    stars = written(slots.join(centre, "slot").where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct(), "jaccard-pairs")
    links = written(_compared(stars, sets, percent).where("link"), "jaccard-stars")
    drop_written(slots), drop_written(stars)
    forest = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nearest = links.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("x")).select(F.col("b").alias("set_id"), F.col("x.a").alias("centre"), F.col("x.distance").alias("far"))
    common = (F.octet_length("blob") / 8).cast("int").alias("k")
    placed = sets.select("set_id", "n", common).join(nearest, "set_id", "left").join(forest.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = written(placed.select("set_id", "n", "k", F.coalesce("centre", "set_id").alias("centre"), F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("root", "set_id").alias("root")), "jaccard-placed")

    # clusters of different classes that share a token of their prefixes
    lists = sets.join(placed.drop("n", "k"), "set_id").select("set_id", "n", "blob", "centre", "root").mapInArrow(_prefixes(buckets, percent), FIELDS)
    clusters = written(_dealt(lists, buckets).mapInArrow(_cluster_pairs(percent), "a long, b long").distinct(), "jaccard-pairs")
    near = written(_compared(clusters, sets, percent), "jaccard-near")
    drop_written(clusters)
    edges = forest.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(near.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")))
    if not near.where("link").isEmpty():
        old, forest = forest, components(edges)
        drop_written(old)

    # members that the centres' distances leave open
    limit = 1 - percent / 100 + 1e-9
    radius = placed.groupBy(F.col("centre").alias("c")).agg(F.max("far").alias("radius"))
    of = lambda d, name: d.select(*(F.col(c).alias(f"{c}_{name}") for c in d.columns))
    now = forest.select(F.col("node"), F.col("root").alias("class"))
    unsure = near.where("not link").join(of(radius, "a"), F.col("a") == F.col("c_a")).join(of(radius, "b"), F.col("b") == F.col("c_b"))
    unsure = unsure.where((F.col("radius_a") + F.col("radius_b") > 0) & (F.col("distance") - F.col("radius_a") - F.col("radius_b") <= limit))
    unsure = unsure.join(of(now, "a"), F.col("a") == F.col("node_a"), "left").join(of(now, "b"), F.col("b") == F.col("node_b"), "left")
    unsure = unsure.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b", "distance")
    inside = placed.select("centre", "set_id", "far", "n", "k")
    pairs = unsure.join(of(inside, "a"), F.col("a") == F.col("centre_a")).join(of(inside, "b"), F.col("b") == F.col("centre_b"))
    fits = (F.col("distance") - F.col("far_a") - F.col("far_b") <= limit) & (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    # two sets have no more in common than the shared tokens of either
    fits &= F.least("k_a", "k_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    pairs = pairs.where(fits & (F.col("far_a") + F.col("far_b") > 0)).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))
    pairs = written(pairs, "jaccard-pairs")
    late = pairs if pairs.isEmpty() else written(_compared(pairs, sets, percent).where("link"), "jaccard-late")
    if not late.isEmpty():
        old, forest = forest, components(forest.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(late.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        drop_written(old)

    # the smallest id of each class of sets; sets of one document and no link need none
    own = members.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = names.join(forest.withColumnRenamed("node", "set_id"), "set_id").select("hi", "lo", "root")
    own = own.join(linked, ["hi", "lo"], "left").where("copies > 1 or root is not null")
    own = written(own, "jaccard-classes")
    for spent in (links, placed, near, pairs, late, forest):
        drop_written(spent)
    class_id = own.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    # a set without a link is a class of its own copies
    label = own.join(class_id, "root", "left").select("hi", "lo", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("known"))
    members, label = salted(members, label, ("hi", "lo"), "doc_id")
    out = members.join(label, ["hi", "lo", "salt"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("known").isNull(), F.col("doc_id"))).alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of linked ones, the one with the smallest id; all columns as they came.

    Rows that share the smallest id of their group all stay, and so do rows with a null id and null, empty or blank texts. An
    empty table gives an empty one. Only rows whose id may be one of those that go (see may_be_in) are shuffled.
    """
    gone = free(docs, "__gone")
    found = ngram_jaccard(docs, size, percent, id_col, text_col)
    lost = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct(), "jaccard-gone")
    sure, doubtful = may_be_in(docs, F.col(id_col).cast("long"), lost, F.col(gone))
    return sure.unionByName(doubtful.join(lost, doubtful[id_col].cast("long") == lost[gone], "left_anti"))
