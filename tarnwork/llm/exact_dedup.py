"""Exact dedup as a tree-merge of sorted digest runs.

Every partition of the input is sorted by itself into a run of (digest, smallest id) records, packed in blocks. The runs meet in
rounds of a binomial (radix `fan_in`) exchange: in round j, node i receives from the `fan_in` nodes that differ from it in
digit j those blocks of their runs whose digests i will own. Blocks come in order of their first digest, so a node merges the
runs as they arrive: what lies before the first digest of the block to come is final, and only blocks that overlap are held.
It passes on one record per text: the smallest identifier and the number of rows. After log_fan_in(partitions) rounds every
node owns the finished run of its digest range; no node ever owns all, and no round sorts records anew. A group of copies shrinks
to one record per node in every round, so that its size never matters.

Two records are of the same text only if SHA-256, length and an independent 64-bit hash all agree; this is
verified at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, may_be_in, partitions, text_of, written

KEYS = ["digest", "n_bytes", "check"]
#: A group is hot with more than 1/HOT of all rows; so there are fewer than HOT hot groups, whatever the data.
HOT = 1000


def leaf_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (unique), doc_id, digest, n_bytes, check."""
    norm = F.regexp_replace(text_of(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )


#: Records of a block.
BLOCK = 4_096
ORDER = [(c, "ascending") for c in (*KEYS, "anon", "keep_id", "keep_row")]


def _collapsed(t):
    """A sorted table of records -> one record per verified text, with the first identifier and the number of rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if t.num_rows < 2:
        return t
    new = None
    for c in KEYS:
        a = t.column(c).combine_chunks()
        d = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1))
        new = d if new is None else pc.or_(new, d)
    starts = np.concatenate([[0], np.flatnonzero(np.asarray(new)) + 1])
    if len(starts) == t.num_rows:
        return t
    n = np.add.reduceat(t.column("n").to_numpy(), starts)
    return t.take(pa.array(starts)).set_column(t.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))


def _packer(kind, target):
    """Sorted, distinct records of a run -> rows (node, first, block): blocks of at most BLOCK records for one node."""
    import numpy as np
    import pyarrow as pa

    def pack(t, run):
        t = t.combine_chunks()
        owner = t.column("owner").to_numpy()
        to = target(owner, run)
        cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            offs = [*range(s, e, BLOCK), e]
            part = t.slice(s, e - s)
            records = pa.StructArray.from_arrays([part.column(f.name).combine_chunks() if part.num_rows else pa.array([], f.type) for f in kind], fields=list(kind))
            blocks = pa.ListArray.from_arrays(pa.array([o - s for o in offs], pa.int32()), records)
            first = part.column("digest").take(pa.array([o - s for o in offs[:-1]]))
            node = pa.array(np.full(len(offs) - 1, to[s], np.int32))
            yield pa.RecordBatch.from_arrays([node, first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first, blocks], names=["node", "first", "block"])

    return pack


def _fields(t):
    """A table with the columns of records -> its fields without marks of columns that are never null."""
    import pyarrow as pa

    return [pa.field(f.name, f.type) for f in t]


def _leaf(target, size: int):
    """Records of a partition, sorted -> the blocks of its run for the first round."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, held = TaskContext.get().partitionId() % size, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_arrays(list(b.columns), schema=pa.schema(_fields(b.schema)))
            t = _collapsed(t if held is None else pa.concat_tables([held, t]).combine_chunks())
            # the last record may go on in the next batch
            held, t = t.slice(t.num_rows - 1), t.slice(0, t.num_rows - 1)
            if t.num_rows:
                yield from _packer(t.schema, target)(t, own)
        if held is not None:
            yield from _packer(held.schema, target)(held, own)

    return run


def _merge(target):
    """Blocks of several runs for one node, in order of their first digest -> the merged run, in blocks for the next round."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        node, held, kind = None, None, None

        def final(t, before=None):
            """(records that no block to come can precede or repeat, the others)."""
            t = t.sort_by(ORDER).combine_chunks()
            if before is None:
                return _collapsed(t), None
            n = pc.sum(pc.less(t.column("digest"), before)).as_py() or 0
            return _collapsed(t.slice(0, n)), _collapsed(t.slice(n))

        for b in batches:
            for k in range(b.num_rows):
                at, first, block = b.column(0)[k].as_py(), b.column(1)[k], b.column(2)[k].values
                kind = kind or [pa.field(f.name, f.type) for f in block.type]
                t = pa.Table.from_arrays(block.flatten(), schema=pa.schema(kind))
                if at != node and held is not None:
                    yield from _packer(held.schema, target)(final(held)[0], node)
                    held = None
                node = at
                if held is not None and held.num_rows >= BLOCK:
                    done, held = final(held, first)
                    if done.num_rows:
                        yield from _packer(done.schema, target)(done, node)
                held = t if held is None else pa.concat_tables([held, t])
        if held is not None and held.num_rows:
            yield from _packer(held.schema, target)(final(held)[0], node)

    return run


def tree_merge(leaf: DataFrame, fan_in: int = 4) -> DataFrame:
    """leaf runs -> digest, n_bytes, check, keep_row, keep_id, n: the finished runs, one record per text."""
    spark = leaf.sparkSession
    rounds = 1
    while fan_in**rounds < partitions(spark):
        rounds += 1
    size = fan_in**rounds

    def node_of(round_: int):
        """The node that a run sends records of an owner to in a round; after the last it is the owner."""
        low = fan_in ** (rounds - round_) if round_ <= rounds else 1
        return lambda owner, run: owner // low * low + run % low

    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    records = leaf.select(
        F.shiftright(head * size, 32).cast("int").alias("owner"), *KEYS, F.col("doc_id").isNull().alias("anon"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n")
    )
    kind = "struct<" + ",".join(f"{c}:{k}" for c, k in records.dtypes) + ">"
    out = f"node int, first binary, block array<{kind}>"
    # each partition is sorted where it is
    runs = records.sortWithinPartitions(*KEYS, F.col("keep_id").asc_nulls_last(), "keep_row").mapInArrow(_leaf(node_of(1), size), out)
    for j in range(1, rounds + 1):
        dealt = runs.repartition(size, "node").sortWithinPartitions("node", "first")
        runs = dealt.mapInArrow(_merge(node_of(j + 1)), out)
    return runs.select(F.explode("block").alias("r")).select("r.digest", "r.n_bytes", "r.check", "r.keep_id", "r.keep_row", "r.n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space is replaced by one space; a null text
    counts as empty. Of equal texts the row with the smallest id stays; a null id is larger than every other
    one; of repeated rows with one id, exactly one stays. An empty table gives an empty result. A text of any length is hashed
    whole in the JVM. Other columns of docs are ignored, whatever their names.
    """
    leaf = written(leaf_runs(docs, id_col, text_col), "dedup-leaf")
    groups = written(tree_merge(leaf, fan_in).where("n > 1").withColumnsRenamed({"digest": "g_digest", "n_bytes": "g_bytes", "check": "g_check"}), "dedup-groups")
    bar = leaf.count() / HOT
    hot, cold = groups.where(F.col("n") > bar), groups.where(F.col("n") <= bar)

    def on(d, g):
        return (d["digest"] == g["g_digest"]) & (d["n_bytes"] == g["g_bytes"]) & (d["check"] == g["g_check"])

    def out(joined):
        single = F.col("n").isNull()
        return joined.select(
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    # fewer than HOT rows are broadcast; all other groups are small and meet their rows in a shuffle join
    few = F.broadcast(hot)
    rest = leaf.join(few, on(leaf, few), "left_anti")
    return out(leaf.join(few, on(leaf, few))).unionByName(out(rest.join(cold, on(rest, cold), "left")))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the later copies, all columns as they came. Rows that repeat an id and its text shrink to one.

    Null and empty texts are copies of each other, a null id is larger than every other one; an empty table gives an empty one. Only rows whose id may be one of those that go (see may_be_in) are hashed again and shuffled.
    """
    of, sha, n = free(docs, "__id"), free(docs, "__sha"), free(docs, "__n")
    seen = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha))
    seen = seen.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias(n))
    seen = written(seen.where(f"not kept or `{n}` > 1"), "dedup-seen")
    sure, doubtful = may_be_in(docs, F.col(id_col), seen, F.col(of))

    digest = F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256)
    match = doubtful[id_col].eqNullSafe(seen[of]) & (digest == seen[sha])
    out = sure.unionByName(doubtful.join(seen, match, "left_anti"))
    again = seen.where("kept")
    if again.isEmpty():
        return out
    match = doubtful[id_col].eqNullSafe(again[of]) & (digest == again[sha])
    once = doubtful.join(again, match, "left_semi").withColumn(sha, digest).dropDuplicates([id_col, sha]).drop(sha)
    return out.unionByName(once)
